"""The queries that apply each operator to its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm import (
    ann, bloomrank, bm25, htmltext, langid, licenses, mixing, neardup, packing, quality, secretscan, tokenalign, warc)
from tallybook.llm.common import held_out, table

MIX_TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    taught = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    forest = quality.train(docs, taught)
    return quality.score(docs, forest).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= quality.KEEP_AT).cast("int").alias("predicted"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).drop("node")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_up = packing.pieces(table(spark, sf_dir, "documents"))
    return packing.pack(packing.digests(cut_up))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(table(spark, sf_dir, "documents"))


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.model_of(langid.profiles(docs.where(~held_out("doc_id"))))
    return langid.identify(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains are the languages; rows of the held-out fold don't teach the classifier."""
    return mixing.mix(table(spark, sf_dir, "documents"), "lang", MIX_TARGETS, ~held_out("doc_id"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.align(table(spark, sf_dir, "documents"))


def op13_bloomrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomrank.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality, op2_neardup, op3_packing, op4_licenses, op5_htmltext, op6_warc, op7_bm25, op8_hilbert, op9_langid, op10_mixing,
        op11_secrets, op12_alignment, op13_bloomrank)} | {
        "pipeline": corpus_pipeline.run}


ORACLES = {
    "op6_warc": f"""WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN n >= {warc.LEAST_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {warc.LEAST_REVISIT} AND page_id <> first THEN first END AS refers_to FROM f""",
    "op13_bloomrank": r"""WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark),
p AS (SELECT row, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT row, sum(tf)::BIGINT AS n FROM p GROUP BY row),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM p, s GROUP BY term, docs),
m AS (SELECT row, 25 + (75 * n * docs) // total AS m FROM n, s),
c AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY ALL),
r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
