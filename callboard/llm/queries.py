"""The named queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    chat_format,
    decontamination,
    language_id,
    lexical_search,
    line_dedup,
    quality_ledger,
    run_detection,
    simhash,
    suffix_dedup,
    toxicity,
    url_filter,
    warc,
)
from .common import table


def repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, folder, "documents"))


def byte_bpe_coding(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digests(table(spark, folder, "documents"), keep=["doc_id"])


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and documents share their ids: a page is to be blocked where its document is of low quality."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    labelled = pages.select("page_id", "url").join(labels, F.col("page_id") == F.col("doc_id"))
    return url_filter.verdicts(pages, labelled.select("url", (F.col("quality") == 0).alias("block")))


def line_runs(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digests(table(spark, folder, "documents"))


def quality_bits(spark: SparkSession, folder: str) -> DataFrame:
    return quality_ledger.judged(table(spark, folder, "documents"), keep=["doc_id"])


def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])


def languages(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identified(table(spark, folder, "documents"))


def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.records(spark, warc.write(table(spark, folder, "pages")))


def chat_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one of two turns that quote the template's own marks."""
    quoted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"),
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(quoted)
    return chat_format.digests(chat_format.formatted(turns))


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the documents, a tenth of them made periodic from some word on, as the contract of op11 has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = documents.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"))
    words = F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.expr("IF(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.expr("array_join(transform(sequence(0L, n - 1L), i -> words[IF(i < a, i, a + (i - a) % p)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def word_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_detection.digests(planted(table(spark, folder, "documents")))


def toxic_texts(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def benchmark_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    "op1_suffix_dedup": repeated_bytes,
    "op2_byte_bpe": byte_bpe_coding,
    "op3_url_filter": url_verdicts,
    "op4_line_dedup": line_runs,
    "op5_quality_ledger": quality_bits,
    "op6_simhash": simhash_groups,
    "op7_decontamination": benchmark_hits,
    "op8_language_id": languages,
    "op9_warc": warc_round_trip,
    "op10_chat_format": chat_round_trip,
    "op11_run_detection": word_runs,
    "op12_toxicity": toxic_texts,
    "op13_lexical_search": benchmark_search,
}
