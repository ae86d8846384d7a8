"""What the operators of this subpackage share: reading, writing between passes, Arrow text."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import materialize

# Python workers look at this many bytes of text at a time (at least one row).
PORTION_BYTES = 1 << 20
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within this, the shuffle files of a write are removed when it ends, since nothing reads them any more."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 200) -> Iterator[None]:
    """Within this, Python workers of passes that run get texts in batches of this many rows.

    Arrow keeps a batch outside the heap, twice while it grows, so with whole texts in them a thousand times
    as many rows take hundreds of megabytes of an executor.
    """
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


@contextlib.contextmanager
def byte_batches(spark: SparkSession, size: int = PORTION_BYTES) -> Iterator[None]:
    """Within this, Python workers of passes that run get a batch as soon as it holds this many bytes (at least one row)."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the table outlives lost executors."""
    with tidy(df.sparkSession):
        return materialize(df, name, **options)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`written` that nothing needs any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def others(df: DataFrame, taken: Iterable[str]) -> list[str]:
    """Columns of ``df`` that an operator hands on: all but those it makes itself."""
    own = {name.lower() for name in taken}
    return [name for name in df.columns if name.lower() not in own]


def schema(df: DataFrame, kept: list[str], made: str) -> T.StructType:
    """Kept columns of ``df`` followed by the columns written in ``made``."""
    fields = [df.schema[name] for name in kept]
    return T.StructType(fields + T.StructType.fromDDL(made).fields)


def portions(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut to at most PORTION_BYTES of text, each with its texts as bytes (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            limit = (ends[first - 1] if first else 0) + PORTION_BYTES
            last = max(first + 1, int(np.searchsorted(ends, limit, "right")))
            yield batch.slice(first, last - first), texts.slice(first, last - first).to_pylist()
            first = last


def with_columns(batch: pa.RecordBatch, kept: list[str], made: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = {name: batch.column(name) for name in kept} | made
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit hashes (multiply and shift, twice)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as far as needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte value, the same in every process."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


class Hasher:
    """Hashes of any slices of a byte string from one running sum."""

    def __init__(self, seed: int):
        self.values = byte_values(seed)
        base = int(np.random.default_rng(seed + 1).integers(1 << 61, 1 << 62)) * 4 + 3
        self.powers = Powers(base)

    def prepare(self, data: np.ndarray) -> np.ndarray:
        """Running sums, one longer than ``data``."""
        n = len(data)
        self.powers.reach(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers.up[:n], out=sums[1:])
        return sums

    def slices(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.powers.down[starts])


_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True


def word_bounds(texts: list[bytes], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where words start and stop in them, words of each text).

    Words stand between ASCII blanks; ``table`` replaces bytes by others before.
    """
    joined = b"\n".join([*texts, b""])
    data = np.frombuffer(joined.translate(table) if table else joined, np.uint8)
    change = np.diff(_BLANK[data].astype(np.int8), prepend=1)
    starts, stops = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    ends = np.cumsum([len(text) + 1 for text in texts])
    return data, starts, stops, np.diff(np.searchsorted(starts, ends), prepend=0)


def hashed_words(texts: list[bytes], hasher: Hasher, table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words of each text)."""
    data, starts, stops, counts = word_bounds(texts, table)
    return hasher.slices(hasher.prepare(data), starts, stops), counts
