"""Sharding by balanced label propagation, in DataFrame operations only.

Documents that share a hub (here: equal texts) are linked. Labels start from a hash of
doc_id; in each round a cluster's documents that sit in other shards ask to move to the
shard where most of their neighbours are, and moves are granted by descending gain as far
as the target's capacity quota goes. After the last round surplus rows and all unlinked
documents fill the room that is left, so that the counts differ by one at most (law `rows`).

A hub too large for a shard is dealt into chunks by hash, each a cluster of its own. State
is kept per (cluster, first label), never per link; only quotas (shards x priorities, a
fixed number of rows) are broadcast. Rows are numbered in blocks, so no task sees a shard.

Defined results: null text has size 1 and is linked with the empty texts; null doc_ids and
repeated rows are ordinary rows; an empty table gives no rows; fewer rows than shards
leave the last shards empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, dense_slots

#: Slices of equal gain that a quota can cut between.
SLICES = 64
#: Rows that one numbering block is meant to hold.
BLOCK_ROWS = 5_000


def _pick(values: list, index: Column) -> Column:
    """values[index] for a short list known on the driver."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def propagate(cells: DataFrame, shards: int, capacity: float, rounds: int) -> DataFrame:
    """Final shard of each cell (hub, chunk, label, n), where label is the first shard."""
    state = cells.withColumn("shard", F.col("label"))
    for k in range(rounds):
        by_shard = state.groupBy("hub", "chunk", "shard").agg(F.sum("n").alias("n"))
        target = by_shard.groupBy("hub", "chunk").agg(F.max(F.struct("n", F.xxhash64("hub", "chunk", "shard").alias("tie"), "shard")).alias("best"))
        asked = state.join(target, ["hub", "chunk"]).select("hub", "chunk", "label", "n", "shard", F.col("best.shard").alias("target"), F.col("best.n").alias("pull"))
        # descending gain first, then slices of a hash
        prio = (F.lit(64) - F.floor(F.log2(F.col("pull"))).cast("int")) * SLICES + F.pmod(F.xxhash64("hub", "chunk", F.lit(k)), F.lit(SLICES)).cast("int")
        asked = cut(asked.withColumn("prio", prio), "lp-asked")
        loads = state.groupBy("shard").agg(F.sum("n").alias("load")).select(F.col("shard").alias("target"), "load")
        wants = asked.where("shard != target").groupBy("target", "prio").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("target").orderBy("prio"))
        fits = F.col("upto") + F.coalesce("load", F.lit(0)) <= capacity
        quota = wants.withColumn("upto", upto).join(F.broadcast(loads), "target", "left").where(fits).select("target", "prio", F.lit(True).alias("ok"))
        moved = asked.join(F.broadcast(quota), ["target", "prio"], "left")
        state = cut(moved.select("hub", "chunk", "label", "n", F.when(F.col("ok"), F.col("target")).otherwise(F.col("shard")).alias("shard")), "lp-state")
        if state.where("shard != label").limit(1).count() == 0 or asked.where("shard != target").limit(1).count() == 0:
            break
    return state.select("hub", "chunk", "label", "shard")


def balanced_shards(rows: DataFrame, hub: str, key: str = "doc_id", shards: int = 16, rounds: int = 4, slack: float = 0.05) -> DataFrame:
    """rows with shard int, slot long and linked boolean; counts differ by one at most.

    slack: by how much of its even share a shard may be overfull between rounds.
    """
    cols = rows.columns
    base = rows.withColumnRenamed(hub, "hub") if hub != "hub" else rows
    total = base.count()
    if total == 0:
        return rows.select(*cols, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(False).alias("linked"))
    share = total / shards
    blocks = max(shards, -(-total // BLOCK_ROWS))
    hubs = base.groupBy("hub").agg(F.count(F.lit(1)).alias("hub_rows")).where("hub_rows > 1")
    h = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))
    chunks = F.when(F.col("hub_rows") <= share, F.lit(1)).otherwise(F.ceil(F.col("hub_rows") / F.lit(max(1.0, share / 4)))).cast("long")
    with_hub = base.join(hubs, "hub", "left")
    known = with_hub.select(
        "*",
        F.pmod(h, chunks).alias("chunk"),
        F.pmod(F.xxhash64(h, F.lit(1)), F.lit(shards)).cast("int").alias("label"),
        # numbering blocks keep the rows of a hub together as long as it is no larger than a block
        F.pmod(F.xxhash64("hub", F.coalesce(F.pmod(h, chunks), F.lit(0)), F.pmod(F.xxhash64(h, F.lit(2)), F.coalesce(F.ceil(F.col("hub_rows") / BLOCK_ROWS), F.lit(1)))), F.lit(blocks)).alias("block"),
    )
    known = cut(known, "lp-rows")
    linked = known.where(F.col("hub_rows").isNotNull())
    cells = cut(linked.groupBy("hub", "chunk", "label").agg(F.count(F.lit(1)).alias("n")), "lp-cells")
    final = propagate(cells, shards, share * (1 + slack), rounds)
    placed = linked.join(final, ["hub", "chunk", "label"])
    placed = cut(dense_slots(placed, ["shard"], ["hub", key], F.col("block"), "slot"), "lp-placed")
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    load = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
    taken = [min(load.get(k, 0), quota[k]) for k in range(shards)]
    room = [q - t for q, t in zip(quota, taken, strict=True)]
    before = [sum(room[:k]) for k in range(shards)]
    stay = placed.where(F.col("slot") < _pick(quota, F.col("shard")))
    spare = placed.where(F.col("slot") >= _pick(quota, F.col("shard"))).select(*known.columns)
    pool = dense_slots(spare.unionByName(known.where(F.col("hub_rows").isNull())), [], ["hub", key], F.col("block"), "turn")
    into = reduce(lambda c, k: F.when(F.col("turn") >= before[k], F.lit(k)).otherwise(c) if room[k] else c, range(shards), F.lit(0))
    filled = pool.withColumn("shard", into.cast("int")).withColumn("slot", F.col("turn") - _pick(before, F.col("shard")) + _pick(taken, F.col("shard")))
    out = [F.col("hub").alias(hub) if c == hub else F.col(c) for c in cols]
    picked = [*out, F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("hub_rows").isNotNull().alias("linked")]
    return stay.select(*picked).unionByName(filled.select(*picked))


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, linked for every row of docs."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("text_key"))
    out = balanced_shards(cut(rows, "lp-docs"), "text_key", "doc_id", shards, rounds)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")
