"""The numbered queries and the pipeline, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .byte_bpe import round_trip
from .common import table, tokenizer_path
from .exact_dedup import exact_groups
from .fingerprints import compare_with_next
from .html_text import main_text
from .jaccard_join import similarity_classes
from .language_id import language_of
from .merkle_manifest import verify_tampered
from .mixing import mix
from .packing import pack
from .quality import quality_scores
from .secrets import secret_report
from .sharding import shard_documents
from .whitening import whiten

OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS kept,
       text_sha256
FROM t
"""


def _levels(name: str, keys: str, most: int) -> str:
    """Levels 1 to `most` of trees over `name`0 (keys, idx, d), and of each level but the last what stands in its run before (pre) and after (suf) a node."""
    out = []
    for k in range(most):
        run = f"PARTITION BY {keys}, idx // 16 ORDER BY idx ROWS BETWEEN"
        out.append(f"""{name}s{k} AS (SELECT {keys}, idx, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS suf
  FROM {name}{k} WHERE {keys} IN (SELECT {keys} FROM {name}{k} GROUP BY {keys} HAVING count(*) > 1))""")
        out.append(f"{name}{k + 1} AS (SELECT {keys}, idx // 16 AS idx, sha256(string_agg(d, '' ORDER BY idx)) AS d FROM {name}{k} WHERE {keys} IN (SELECT {keys} FROM {name}{k} GROUP BY {keys} HAVING count(*) > 1) GROUP BY {keys}, idx // 16)")
    tops = " UNION ALL ".join(f"SELECT {keys}, d FROM {name}{k} WHERE {keys} IN (SELECT {keys} FROM {name}{k} GROUP BY {keys} HAVING count(*) = 1)" for k in range(most + 1))
    return ", ".join([*out, f"{name}top AS ({tops})"])


def _folds(first: str, steps: list[str], name: str) -> str:
    """A digest folded step by step, where a step's row is there."""
    at, out = first, []
    for k, s in enumerate(steps):
        out.append(f"{name}{k} AS (SELECT *, CASE WHEN {s}pre IS NULL THEN {at} ELSE sha256({s}pre || {at} || {s}suf) END AS f{k} FROM {'paths' if not k else name + str(k - 1)})")
        at = f"f{k}"
    return ", ".join(out)


#: Trees of up to 16**6 leaves a source and 16**3 sources; the crc32 is worked bit by bit.
LEAF_LEVELS, SOURCE_LEVELS = 6, 3
CRC = "(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(1, 9) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))))"
NETTED = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "TEXT"))
STEPS = [f"a{k}_" for k in range(LEAF_LEVELS)] + [f"b{k}_" for k in range(SOURCE_LEVELS)]
OP13_SQL = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('+' || source, '') AS k, sha256({NETTED.replace("TEXT", "text")}) AS leaf,
    sha256({NETTED.replace("TEXT", "CASE WHEN doc_id IS NOT NULL AND " + CRC + " % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS changed FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
a0 AS (SELECT k, idx, leaf AS d FROM placed), {_levels("a", "k", LEAF_LEVELS)},
b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY k) - 1 AS idx, d, k FROM atop), {_levels("b", "g", SOURCE_LEVELS)},
paths AS (SELECT p.doc_id, p.leaf, p.changed, atop.d AS subroot, (SELECT d FROM btop) AS root, {", ".join(f"{n}{k}_.{c} AS {n}{k}_{c}" for n, m in (("a", LEAF_LEVELS), ("b", SOURCE_LEVELS)) for k in range(m) for c in ("pre", "suf"))}
  FROM placed p JOIN atop USING (k) JOIN b0 ON b0.k = p.k
  {" ".join(f"LEFT JOIN as{k} a{k}_ ON a{k}_.k = p.k AND a{k}_.idx = p.idx // {16**k}" for k in range(LEAF_LEVELS))}
  {" ".join(f"LEFT JOIN bs{k} b{k}_ ON b{k}_.idx = b0.idx // {16**k}" for k in range(SOURCE_LEVELS))}),
{_folds("changed", STEPS, "fold")}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"coalesce({s}pre || {s}suf, '')" for s in STEPS)}) AS proof_sha256, f{len(STEPS) - 1} AS folded_root, f{len(STEPS) - 1} = root AS verified FROM fold{len(STEPS) - 1}
"""


def op8_exact_dedup(spark, sf_dir):
    """Owner of every document's text, over all of `documents`."""
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_packing(spark, sf_dir):
    """All of `documents` packed into windows of 2048 tokens that each hold the corpus mixture."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_html_text(spark, sf_dir):
    """Main text of all of `pages` by their hosts' winning paths."""
    return main_text(table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark, sf_dir):
    """Similarity classes of all of `documents` by 5-word shingles, Jaccard 0.75 or more."""
    return similarity_classes(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    """Quality score of every text of `documents`, learned from `labels` outside the held-out fold."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark, sf_dir):
    """Secrets in every text of `documents`."""
    return secret_report(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    """All of `documents` mixed by weights 5, 2, 1 over the sources in code-point order."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_sharding(spark, sf_dir):
    """Shards 0 to 15 for all of `documents`, equal texts together, counts at most one apart."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark, sf_dir):
    """Merkle fingerprints of all of `documents`, against their edited texts and the next documents."""
    return compare_with_next(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    """Language of all of `documents`, learned from those outside the held-out fold."""
    return language_of(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark, sf_dir):
    """Byte-level BPE ids of all of `documents`, and the bytes decoded from them."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_whitening(spark, sf_dir):
    """First four whitened components of all of `embeddings`."""
    whole = whiten(table(spark, sf_dir, "embeddings"))
    return whole.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_merkle_manifest(spark, sf_dir):
    """Manifest of all of `documents`: proofs, and rows that no longer fold to the root once tampered with."""
    return verify_tampered(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    """All stages of corpus_pipeline.py over `documents`."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "pipeline": pipeline,
        "op1_packing": op1_packing,
        "op2_html_text": op2_html_text,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_quality": op4_quality,
        "op5_secrets": op5_secrets,
        "op6_mixing": op6_mixing,
        "op7_sharding": op7_sharding,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_fingerprints": op9_fingerprints,
        "op10_language_id": op10_language_id,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_whitening": op12_whitening,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql():
    return {"op8_exact_dedup": OP8_SQL, "op13_merkle_manifest": OP13_SQL}
