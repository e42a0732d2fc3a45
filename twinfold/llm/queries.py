"""The operators of this subpackage applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .link_graph import judge

    return judge(_table(spark, sf_dir, "pages"))


def op2_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrappers import extract

    return extract(_table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf_langid import fit, identify

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op4_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flat_graph import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import digests

    return digests(_table(spark, sf_dir, "documents"))


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .image_copies import copies, rendered

    return copies(rendered(_table(spark, sf_dir, "embeddings")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_link_graph, op2_wrappers, op3_language, op4_flat_graph, op5_pack, op6_substring, op7_image_copies, op8_bpe, op9_toxicity, op10_simhash)}


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi FROM s WINDOW o AS (PARTITION BY k ORDER BY doc_id, i)),
g AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS p FROM f WHERE NOT (fd = doc_id AND fi = i)),
e AS (SELECT d.doc_id, d.w, unnest(range(0, greatest(len(d.w), 1))) AS p FROM d),
k AS (SELECT e.doc_id, count(*) FILTER (g.p IS NOT NULL) AS n_removed, coalesce(string_agg(CASE WHEN g.p IS NULL THEN e.w[e.p + 1] END, ' ' ORDER BY e.p), '') AS kept FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, k.n_removed, sha256(k.kept) AS kept_sha256 FROM d JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; the others learn, iterate or use a tokenizer or hash that it lacks, and are tested by brute force."""
    return {"op6_substring": OP6_SQL}
