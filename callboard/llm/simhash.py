"""Near-duplicate texts by SimHash.

Each text gets a 64-bit fingerprint; two are linked where few bits differ. Fingerprints are cut
into BLOCKS blocks, of which at least BLOCKS - bits are equal in a linked pair, so every choice of
that many blocks is a key and linked pairs share one. Members of a key are compared and their bits
counted. A key with more than PAIRED different fingerprints is not compared pair by pair: within
the distance of two bits, two fingerprints agree exactly if one can be reached from both by
changing at most one bit, so its members go to their own value and the 64 values next to it, and
all that meet at a value are linked to the least of them. That is as exact and grows in proportion.

Equal fingerprints are one node, so copies are never compared or expanded. Components are found by
:mod:`.components`.

Defined results: a text of fewer words than a shingle is one shingle; null, empty or blank texts
have fingerprint 0 and are linked like any other; a null doc_id is handed on with its fingerprint
but stands for nobody in a component, whose id is the least doc_id that is not null (null if none).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others, portions, schema, with_columns, written
from .components import connected

# Fixed values of the fingerprint.
BITS, SEED = 64, 42

SHINGLE = 3
DISTANCE = 2
BLOCKS = 5
PAIRED = 50
# Hashes whose bits are counted at a time.
COUNTED = 1 << 15
# Name for the hash of a text in a frame of any columns.
_PRINT = "__print"


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(word) + 1 for word in words])
        starts = np.append(0, ends[:-1])[: len(words) - shingle + 1].tolist()
        ends = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    packed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(packed), COUNTED):
        votes += np.unpackbits(packed[i : i + COUNTED], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Kept columns (default: all) and ``simhash``, the fingerprint as a signed 64-bit number."""
    made = ["simhash"]
    kept = others(df.select(*keep) if keep is not None else df, made)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, text):
            found = pa.array([fingerprint(x, shingle) for x in texts], pa.int64())
            yield with_columns(batch, kept, {"simhash": found})

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(work, schema(df, kept, "simhash long"))


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """For each choice of blocks that a linked pair can share: a mask of their bits (signed)."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(choice)) for choice in combinations(single, blocks - distance)]


def linked(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between the different fingerprints of ``nodes`` (``simhash``, each once).

    Every two fingerprints within the distance are connected by links, and only such are.
    """
    if distance not in (1, 2):
        raise ValueError("links are of one or two bits")
    masks = block_masks(blocks, distance)
    keyed = nodes.select(
        "simhash",
        F.posexplode(F.array(*(F.col("simhash").bitwiseAND(F.lit(m).cast("long")) for m in masks))).alias("choice", "key"),
    )
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(keyed.join(sizes, ["choice", "key"]), "simhash-blocks")
    small = shared.where(F.col("size") <= PAIRED)
    left, right = (small.select("choice", "key", F.col("simhash").alias(name)) for name in "ab")
    pairs = left.join(right, ["choice", "key"]).where("a < b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")

    large = shared.where(F.col("size") > PAIRED).select("simhash").distinct()
    met = large.select("simhash", F.explode(_meeting_places(distance)).alias("place"))
    least = met.groupBy("place").agg(F.min("simhash").alias("a"), F.max("simhash").alias("most")).where("a < most")
    stars = met.join(least.drop("most"), "place").where("a < simhash").select("a", F.col("simhash").alias("b"))
    return pairs.unionByName(stars)


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _meeting_places(distance: int) -> Column:
    """Places that two different fingerprints share exactly if at most ``distance`` bits differ.

    Two bits: their own value and all that differ in one bit. One bit: for each bit, the value
    without it.
    """
    value = F.col("simhash")
    if distance == 2:
        places = [(0, value)] + [(0, value.bitwiseXOR(F.lit(_signed(1 << i)).cast("long"))) for i in range(BITS)]
    else:
        every = (1 << BITS) - 1
        places = [(i, value.bitwiseAND(F.lit(_signed(every ^ 1 << i)).cast("long"))) for i in range(BITS)]
    return F.array(*(F.struct(F.lit(i).alias("bit"), v.alias("value")) for i, v in places))


def rooted(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``nodes`` (``simhash``, each once) with ``root``, the least fingerprint reachable over links."""
    reached = connected(linked(nodes, distance, blocks)).withColumnRenamed("node", "simhash")
    return nodes.join(reached, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))


def grouped(prints: DataFrame, key: str = "doc_id", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Add ``component_id`` (least key reachable over links) to rows with ``simhash``."""
    nodes = written(prints.groupBy("simhash").agg(F.min(key).alias("_least")), "simhash-nodes")
    of_nodes = rooted(nodes, distance, blocks)
    least = of_nodes.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = of_nodes.select("simhash", "root").join(least, "root").drop("root")
    return prints.select(*others(prints, ["component_id"])).join(named, "simhash")


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row."""
    prints = written(fingerprints(df, shingle=shingle, keep=["doc_id"]), "simhash")
    found = grouped(prints, distance=distance)
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: that of the least doc_id, null after all others.

    Of rows that share it, the one whose text has the least hash stays; of rows that share the text
    too, any one. Rows that share both are one before texts are moved, however many they are.
    """
    rows = df.withColumn(_PRINT, F.xxhash64("text"))
    prints = fingerprints(rows, shingle=shingle, keep=["doc_id", _PRINT])
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", _PRINT)
    nodes = written(prints.groupBy("simhash").agg(F.min(place).alias("first")), "simhash-nodes")
    first = rooted(nodes, distance).groupBy("root").agg(F.min("first").alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col(f"first.{_PRINT}").alias("_of"))
    single = rows.dropDuplicates(["doc_id", _PRINT])
    chosen = single["doc_id"].eqNullSafe(first["_id"]) & (single[_PRINT] == first["_of"])
    return single.join(first, chosen, "left_semi").select(*df.columns)
