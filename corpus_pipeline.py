"""From raw documents to token ids, in five stages that each call one operator of ``callboard.llm``.

Every stage takes the rows that the one before has kept, written as Parquet and read again. All but
the last return the columns of ``documents``.

Defined results: null, empty and blank texts have no words and go at the first stage. Very long texts are worked on whole.
Of rows equal in id and text one stays, of other ties the least doc_id (one without an id after all others). Other columns are
carried along whatever their names, and no operator sees them. Without documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callboard.llm import byte_bpe, decontamination, line_dedup, quality_ledger, simhash
from callboard.llm.common import table, written

# Columns that the operators look at.
OPEN = ["doc_id", "text"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, where no operator's own columns replace them."""
    rest = [name for name in docs.columns if name not in OPEN]
    return docs.select(*OPEN, F.struct(*(rest or [F.lit(0)])).alias("rest"))


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, from rows that :func:`carried` made."""
    return rows.select(*(F.col(name) if name in OPEN else F.col("rest")[name].alias(name) for name in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    entries = quality_ledger.ledger(quality_ledger.measured(carried(docs)))
    return restored(entries.where(quality_ledger.passes(quality_ledger.CURRENT)), docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand in an earlier document too are taken out of the text; ``n_chars`` follows it."""
    left = restored(line_dedup.without_repeats(carried(docs)), docs)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id."""
    return simhash.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return restored(decontamination.clean(carried(docs), table(spark, sf_dir, "benchmark")), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every document that is left; its ids decode to its text."""
    return byte_bpe.digests(docs, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the stages of fingerprints and of tokens; tests/llm compares run() with a plain version.
ORACLE_SQL = None
