import json
import os
import threading

import pytest

from callboard.sources import versions
from registry import standins

ROW = "issue_code STRING, ldap STRING, score DOUBLE"


def rows(spark, *data, extra=""):
    return spark.createDataFrame(list(data), ROW + extra)


def stored(spark, path, **options):
    return {(r.issue_code, r.ldap): r.score for r in versions.read(spark, path, **options).collect()}


def test_versions_follow_each_other_and_old_ones_stay_readable(spark, tmp_path):
    path = str(tmp_path / "card")
    assert stored(spark, path) == {} and versions.numbers(spark, path) == []
    assert versions.save(spark, path, rows(spark, ("i", "a", 1.0), ("i", "b", 2.0), ("j/ü?", "a", 3.0)), [])
    changes = rows(spark, ("i", "a", 5.0, 2), ("i", "a", 4.0, 1), ("k", "z", 9.0, 1), (None, "q", 1.0, 1), ("k", None, 1.0, 1), extra=", at INT")
    assert versions.save(spark, path, changes, ["at"])
    assert versions.numbers(spark, path) == [1, 2]
    assert stored(spark, path) == {("i", "a"): 5.0, ("i", "b"): 2.0, ("j/ü?", "a"): 3.0, ("k", "z"): 9.0}
    assert stored(spark, path, number=1) == {("i", "a"): 1.0, ("i", "b"): 2.0, ("j/ü?", "a"): 3.0}
    assert [r.ldap for r in versions.for_issue(spark, path, "i").collect()] == ["a", "b"]
    assert versions.for_issue(spark, path, "unknown").collect() == []


def test_only_issues_that_change_are_read_and_written(spark, tmp_path):
    path = str(tmp_path / "card")
    versions.save(spark, path, rows(spark, *((f"i{i}", "a", float(i)) for i in range(6))), [])
    before = versions.version(spark, path).folders
    versions.save(spark, path, rows(spark, ("i3", "b", 1.0)), [])
    after = versions.version(spark, path).folders
    assert {issue for issue in after if after[issue] != before[issue]} == {"i3"}
    assert all(f"part={versions._part('i3')}" in f for f in versions.read(spark, path, issues=["i3"]).inputFiles())


def test_a_writer_that_dies_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "card")
    versions.save(spark, path, rows(spark, ("i", "a", 1.0)), [])

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "_publish", dies)
    with pytest.raises(KeyboardInterrupt):
        versions.save(spark, path, rows(spark, ("i", "a", 7.0)), [])
    monkeypatch.undo()
    assert stored(spark, path) == {("i", "a"): 1.0} and versions.numbers(spark, path) == [1]
    versions.save(spark, path, rows(spark, ("i", "b", 2.0)), [])
    assert stored(spark, path) == {("i", "a"): 1.0, ("i", "b"): 2.0}


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "card")
    errors = []

    def write(i):
        try:
            versions.save(spark, path, rows(spark, ("i", f"w{i}", float(i)), (f"own{i}", "a", 1.0)), [])
        except Exception as error:  # noqa: BLE001 - shown below
            errors.append(error)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert errors == [] and versions.numbers(spark, path) == [1, 2, 3, 4, 5]
    found = stored(spark, path)
    assert len(found) == 10 and {ldap for issue, ldap in found if issue == "i"} == {f"w{i}" for i in range(5)}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "card")
    assert versions.save(spark, path, rows(spark, ("i", "a", 1.0)), [], "s", 0)
    assert versions.save(spark, path, rows(spark, ("i", "a", 2.0)), [], "s", 1)
    assert not versions.save(spark, path, rows(spark, ("i", "a", 1.0)), [], "s", 0)
    assert not versions.save(spark, path, rows(spark, ("i", "a", 9.0)), [], "s", 1)
    assert versions.save(spark, path, rows(spark, ("i", "b", 3.0)), [], "other", 0)
    assert stored(spark, path) == {("i", "a"): 2.0, ("i", "b"): 3.0}
    assert versions.version(spark, path).batches == {"s": 1, "other": 0}


def test_stream_of_changes(spark, tmp_path):
    path, progress, source = (str(tmp_path / n) for n in ("card", "progress", "in"))
    schema = ROW + ", at INT"

    def write(name, *data):
        (tmp_path / "in").mkdir(exist_ok=True)
        file = tmp_path / "in" / name
        file.write_text("\n".join(json.dumps(dict(zip(("issue_code", "ldap", "score", "at"), d))) for d in data))
        # Files are taken in by the time they were written.
        os.utime(file, (1_000_000 + int(name[0]),) * 2)

    def catch_up():
        changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        versions.keep_up(changes, path, progress, ["at"], "feed").awaitTermination()
        return stored(spark, path)

    write("1.json", ("i", "a", 1.0, 1), ("i", "a", 3.0, 3), ("i", "a", 2.0, 2))
    assert catch_up() == {("i", "a"): 3.0}
    write("2.json", ("i", "a", 4.0, 1), ("j", "b", 5.0, 1))
    write("3.json", ("j", "b", 6.0, 1))
    assert catch_up() == {("i", "a"): 4.0, ("j", "b"): 6.0}
    assert len(versions.numbers(spark, path)) == versions.KEPT_VERSIONS
    # The last batch is run again, as after a crash between publishing and the end of the batch.
    before = versions.numbers(spark, path)
    commits = sorted((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for file in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        file.unlink(missing_ok=True)
    assert catch_up() == {("i", "a"): 4.0, ("j", "b"): 6.0}
    assert versions.numbers(spark, path) == before


def test_old_versions_are_removed_with_their_rows(spark, tmp_path):
    path = str(tmp_path / "card")
    for i in range(5):
        versions.save(spark, path, rows(spark, ("i", "a", float(i)), ("first" if not i else "i", "b", 1.0)), [])
    versions.remove_old(spark, path, kept=1)
    assert versions.numbers(spark, path) == [5]
    assert stored(spark, path) == {("i", "a"): 4.0, ("i", "b"): 1.0, ("first", "b"): 1.0}
    assert len(list((tmp_path / "card" / "data").glob("*/part=*"))) == 2


def test_feed_has_one_file_for_each_year_all_written_at_once(spark, tmp_path):
    days = [f"{year}-03-{day:02d}" for year in range(1990, 2001) for day in (1, 20)]
    data = [("i", f"a{n}", float(n), day, n) for n, day in enumerate(days)] + [("i", "z", 1.0, None, 99)]
    rows = spark.createDataFrame(data, "issue_code STRING, ldap STRING, score DOUBLE, day STRING, l_orderkey LONG")
    rows = rows.selectExpr("issue_code", "ldap", "score", "CAST(day AS TIMESTAMP_NTZ) AS l_shipdate", "l_orderkey")
    feed = str(tmp_path / "feed")
    standins.write_by_year(rows.repartition(3), "l_shipdate", feed)
    files = sorted((tmp_path / "feed").glob("part-*"), key=lambda f: f.stat().st_mtime)
    years = [[r[0] for r in spark.read.schema(standins.WRITES).parquet(str(f)).selectExpr("year(l_shipdate)").distinct().collect()] for f in files]
    assert years == [[None], *([year] for year in range(1990, 2001))]
    assert len({f.stat().st_mtime for f in files}) == len(files)
    assert spark.read.schema(standins.WRITES).parquet(feed).exceptAll(rows).isEmpty() and len(data) == spark.read.parquet(feed).count()
    # Rows are written once: no copy by year lies beside the feed.
    assert [f.name for f in tmp_path.iterdir()] == ["feed"]
