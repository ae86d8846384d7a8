import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from callboard.llm import warc

from frames import multiset

BIG = "".join(f"<p>{i} é日\U0001f600\r\n\r\nWARC/1.1\r\n" for i in range(40_000))
ROWS = [
    (5, "http://a/", "<html>one</html>"),
    (3, "http://b/", "<html>one</html>"),
    (9, "http://c/\r\nX: y", "<html>one</html>"),
    (1, None, None),
    (2, "http://e/", ""),
    (7, "http://f/", BIG),
    (8, "http://g/", BIG),
    (8, "http://g/", BIG),
    (10, "http://h/", "\r\n\r\nWARC/1.1\r\nWARC-Archive-Boundary: x\r\n\x00"),
    (None, "http://i/", "no id"),
    (None, "http://i/", "<html>one</html>"),
    (3, "http://b/", "<html>one</html>"),
    (11, "http://j/", "a" * warc.CHUNK),
    (12, "http://k/", "é" * (warc.CHUNK // 2 + 1) + "\n"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(rows):
    least = {}
    for page_id, _, html in rows:
        if page_id is not None:
            least[html or ""] = min(page_id, least.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        first = least.get(html or "") if page_id is not None else None
        revisit = first is not None and first != page_id
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "revisit" if revisit else "response", first if revisit else None))
    return out


def test_round_trip(spark):
    got = warc.records(spark, warc.write(pages(spark))).collect()
    assert multiset(map(tuple, got)) == multiset(brute(ROWS))


def test_chunks_carry_the_payload(spark):
    archive = warc.write(pages(spark))
    chunks = warc.read(spark, archive).where("page_id = 7 AND record_type <> 'revisit'").orderBy("chunk").collect()
    assert len(chunks) > 4 and all(len(c.data) <= warc.CHUNK for c in chunks)
    assert b"".join(bytes(c.data) for c in chunks).decode() == BIG
    assert [c.chunks for c in chunks] == [None] * (len(chunks) - 1) + [len(chunks)]
    assert {c.record_id for c in chunks} == {chunks[0].record_id}


def test_reading_in_small_splits(spark):
    archive = warc.write(pages(spark).coalesce(1), compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert multiset(map(tuple, warc.records(spark, archive).collect())) == multiset(brute(ROWS))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_least_bytes(spark):
    rows = warc.records(spark, warc.write(pages(spark), least_bytes=1)).where("payload_bytes = 0").collect()
    assert {r.record_type for r in rows} == {"response"}


def test_files_are_archives(spark):
    archive = warc.write(pages(spark, ROWS[:3]).coalesce(1))
    text = "".join(r.value for r in spark.read.text(archive.folder, wholetext=True).collect())
    assert text.startswith("WARC/1.1\r\n") and text.endswith("\r\n\r\n")
    assert text.count("WARC-Type: revisit") == 2 and text.count("WARC-Type: response") == 1
    assert "http://c/%0D%0AX: y" in text


def test_damage_is_noticed(spark):
    archive = warc.write(pages(spark, ROWS[:1]))
    damaged = warc.Archive(archive.folder + "-damaged", archive.boundary)
    lines = spark.read.text(archive.folder, lineSep="\n")
    lines.select(F.regexp_replace("value", "<html>one", "<html>two")).write.text(damaged.folder, lineSep="\n")
    with pytest.raises(Exception, match="another digest"):
        warc.records(spark, damaged).collect()


def test_empty_table_and_clashing_columns(spark):
    assert warc.records(spark, warc.write(pages(spark).limit(0))).collect() == []
    df = pages(spark).selectExpr("*", "1 AS refers_to", "'p' AS payload", "2 AS _payload")
    assert warc.records(spark, warc.write(df)).count() == len(ROWS)
