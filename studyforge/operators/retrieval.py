"""Evidence retrieval: an inverted index of grams with rarity weights, candidates, ranking and screening.

The tokeniser is a parameter: character grams suit Chinese text, word grams Latin text.
Frequent grams weigh less and are never dropped; a unit's matches are summed in its row (see matching.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import gram_weight, norm_gram, squeeze, words
from .folds import stored
from .matching import FEW, best, summed
from .terms import contained

POWER = 1.6
MISSING = 0.05


def word_grams(c):
    """Distinct words of four letters or more."""
    return F.array_distinct(words(c, 4))


def char_grams(c):
    from ..functions.text import grams

    return grams(norm_gram(c), 2)


def postings(units: DataFrame, tokens=word_grams) -> DataFrame:
    """gram, unit."""
    return units.select("unit", F.explode(tokens(F.col("sentence"))).alias("gram"))


def weights(postings_: DataFrame, units: DataFrame, power: float = POWER) -> DataFrame:
    """gram, df (share of the units that have it), weight; postings name a gram once for each unit."""
    total = units.agg(F.count(F.lit(1)).alias("total"))
    df = postings_.groupBy("gram").agg(F.count(F.lit(1)).alias("hits"))
    share = F.col("hits") / F.col("total")
    return df.join(F.broadcast(total)).select("gram", "hits", share.alias("df"), gram_weight(share, power).alias("weight"))


def candidates(queries: DataFrame, units: DataFrame, most: int = 200, tokens=word_grams) -> DataFrame:
    """query, unit, hits, place: the units (unit, sentence) that share most grams with a query (query, text), ties by unit."""
    one = F.lit(1.0)
    wants = queries.select(F.col("query").alias("key"), F.explode(tokens(F.col("text"))).alias("gram"), one.alias("weight"), one.alias("least"))
    pairs = summed(units.select("unit", tokens(F.col("sentence")).alias("grams")), wants, most=most)
    return best(pairs, most).select(F.col("key").alias("query"), "unit", F.col("have").cast("long").alias("hits"), "place")


def weighted_coverage(queries: DataFrame, units: DataFrame, weights_: DataFrame, most: int = 400, tokens=word_grams) -> DataFrame:
    """query, unit, cover, place: weight of the query's grams that a unit has over the weight of all of them."""
    q = queries.select(F.col("query").alias("key"), F.explode(tokens(F.col("text"))).alias("gram")).join(weights_.select("gram", "weight"), "gram", "left").withColumn("weight", F.coalesce("weight", F.lit(MISSING)))
    q = stored(q.select("key", "gram", "weight"), "coverage-wants")
    whole = q.groupBy("key").agg(F.sum("weight").alias("whole"))
    wants = q.join(whole, "key").select("key", "gram", (F.col("weight") / F.col("whole")).alias("weight"), F.lit(0.0).alias("least"))
    pairs = summed(units.select("unit", tokens(F.col("sentence")).alias("grams")), wants, most=most)
    return best(pairs.select("key", "unit", F.round("have", 9).alias("cover")), most, "cover").withColumnRenamed("key", "query")


def screen(evidence: DataFrame, least_run: int = 4, least_cover: float = 0.55) -> DataFrame:
    """evidence (query, answer, sentence) with keep: a shared run or character coverage that is large enough."""
    from ..functions.spans import longest_run
    from ..functions.text import characters, coverage

    run = longest_run(squeeze(F.col("answer")), squeeze(F.col("sentence")))
    return evidence.withColumn("run", run).withColumn("cover", coverage(characters(F.col("answer")), characters(F.col("sentence")))).withColumn("keep", (F.col("run") >= least_run) | (F.col("cover") >= least_cover))


def containing(left: DataFrame, units: DataFrame) -> DataFrame:
    """query, term, unit, sentence: every unit that contains the query's term (query, term), in letters of any case.

    The units are read once by an automaton of all terms (see terms.py), whose hits leave with their sentence; neither
    texts nor grams are shuffled. The empty term is in every unit.
    """
    low = left.where("term IS NOT NULL").withColumn("low", F.lower("term"))
    texts = units.where("sentence IS NOT NULL").select("unit", "sentence", F.lower("sentence").alias("text"))
    hits = contained(texts, low.select(F.col("low").alias("term")), "unit", "text", ["sentence"])
    found = hits.select(F.col("term").alias("low"), F.col("id").alias("unit"), "sentence")
    pairs = found.join(F.broadcast(low), "low") if low.count() <= FEW else found.join(low, "low")
    empty = low.where("low = ''").limit(1).count()
    if empty:
        pairs = pairs.unionByName(texts.select("unit", "sentence").join(F.broadcast(low.where("low = ''"))))
    return pairs.select("query", "term", "unit", "sentence")


def first_units(pairs: DataFrame, most: int = 4) -> DataFrame:
    """query, unit, place: each query's first units by number."""
    return pairs.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("unit"))).where(F.col("place") <= most).select("query", "unit", "place")


def first_matches(left: DataFrame, units: DataFrame, most: int = 4) -> DataFrame:
    """query, unit, place: the first units, by number, that contain the query's term (query, term)."""
    return first_units(containing(left, units), most)


def hit_rates(options: DataFrame, postings_: DataFrame) -> DataFrame:
    """chosen, options, hits, rate of options (query, option, term, chosen) whose term is in the corpus."""
    known = postings_.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))  # a gram once for each unit
    j = options.join(known, F.col("term") == F.col("gram"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.groupBy("chosen").agg(F.count(F.lit(1)).alias("options"), F.count_if(F.col("n") > 0).alias("hits"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("rate"))


def suspicious(options: DataFrame, postings_: DataFrame, least: int = 2) -> DataFrame:
    """Queries whose best unchosen option occurs more often than their worst chosen one, and `least` times at least."""
    known = postings_.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))  # a gram once for each unit
    j = options.join(known, F.col("term") == F.col("gram"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    g = j.groupBy("query").agg(F.min(F.when(F.col("chosen"), F.col("n"))).alias("worst_chosen"), F.max(F.when(~F.col("chosen"), F.col("n"))).alias("best_other"))
    return g.where((F.col("best_other") > F.col("worst_chosen")) & (F.col("best_other") >= least))
