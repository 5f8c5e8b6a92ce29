"""The training-data queries, one per operator, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, chunks, hosts, languages, leaks, lines, neardup, periods, phrases, pieces, secrets, toxicity, vectors

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.repeat_report(_table(spark, folder, "documents"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(_table(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    merged = archives.capture_history(_table(spark, folder, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op4_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.self_search(_table(spark, folder, "embeddings"), every=20, k=20)


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(_table(spark, folder, "documents"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(_table(spark, folder, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"), shingle=2, percent=80)


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages.language_report(_table(spark, folder, "documents"))


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return hosts.judge(_table(spark, folder, "pages"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.run_report(_table(spark, folder, "documents"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"), longest=5, least=100, top=2000)


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc": op3_warc,
    "op4_nearest_vectors": op4_nearest_vectors,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_line_dedup": op6_line_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_language_id": op9_language_id,
    "op10_url_filters": op10_url_filters,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_toxicity": op12_toxicity,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op3_warc": archives.CAPTURE_SQL,
    "op6_line_dedup": lines.LINE_SQL,
    "op8_benchmark_decontamination": leaks.LEAK_SQL,
    "op13_collocations": phrases.COLLOCATION_SQL,
}
