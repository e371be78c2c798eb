"""Registered queries of the operators, each over its whole table, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontam, lines, lm, manifest, maxscore, oracle, periodic, pieces, quality, secrets, shards, simhash, toxicity, warc
from lectern.llm.common import id_bucket

PIECE_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = lm.fit(docs.where(~lm.held_out(F.col("doc_id"))))
    scored = lm.score(docs, model)
    return scored.select(
        "doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeats(table(spark, folder, "documents"), copies="cut").drop("key")


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.assign(table(spark, folder, "documents"), 40)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_warc_audit(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    records = warc.layout(pages)
    found = warc.audit(records, warc.damaged(pages, records))
    return found.join(records.select("archive", "offset", "page_id"), ["archive", "offset"], "left").select("page_id", *found.columns)


def op7_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    vectors = maxscore.integer_vectors(table(spark, folder, "embeddings"), 256)
    return maxscore.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    done = pieces.digest(table(spark, folder, "documents"), public_tokenizers.path(PIECE_MODEL))
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    proved = manifest.verify(manifest.manifest(table(spark, folder, "documents"), manifest.without_line_breaks()))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("steps")).cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).drop("cleaned")


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.runs(periodic.repeated_tails(table(spark, folder, "documents")))
    lines_ = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period",
        F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(lines_.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_lm_scoring, op2_secret_scan, op3_line_dedup, op4_sharding, op5_simhash, op6_warc_audit, op7_maxscore, op8_sentencepiece,
        op9_decontamination, op10_toxicity, op11_merkle_manifest, op12_quality_rules, op13_periodic_runs)
}

ORACLES: dict[str, str] = {
    "op7_maxscore": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_merkle_manifest": oracle.MANIFEST,
    "op12_quality_rules": oracle.QUALITY,
    "op13_periodic_runs": oracle.PERIODIC,
}
