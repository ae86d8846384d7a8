"""Snapshot files: finding the newest, repairing, availability, and the stream."""

import datetime
import json
import os

import pytest

from callboard.session import new_folder
from callboard.sources import scorecards, snapshots
from callboard.streaming import availability

AT = datetime.datetime(2022, 2, 14, 8, 30)


def record(user, status="ROUTABLE", slots=(1,), account="1"):
    return {
        "AWSAccountId": account,
        "CurrentAgentSnapshot": {
            "AgentStatus": {"Type": status},
            "Configuration": {
                "Username": user,
                "RoutingProfile": {"Concurrency": [{"AvailableSlots": s, "MaximumSlots": 5} for s in slots]},
            },
        },
    }


def write(root, name, records, when, hour="2022/02/14/08", raw=None):
    folder = root / "connect" / "AEs" / hour
    folder.mkdir(parents=True, exist_ok=True)
    text = raw if raw is not None else "".join(json.dumps(r, separators=(",", ":")) for r in records)
    (folder / name).write_text(text, encoding="utf-8")
    os.utime(folder / name, (when, when))


def now_available(spark, root):
    return sorted(r.ldap for r in snapshots.available_now(spark, str(root), AT).collect())


def test_hour_folder():
    assert snapshots.hour_folder(AT) == "connect/AEs/2022/02/14/08/"
    assert snapshots.hour_folder(AT, named=True) == "connect/AEs/year=2022/month=02/day=14/hour=08/"


def test_newest_file_decides(spark, tmp_path):
    write(tmp_path, "z", [record("u2")], 1000)
    nothing = {"AWSAccountId": "1", "CurrentAgentSnapshot": None}
    write(tmp_path, "a", [record("u1", "OFFLINE"), record("u3", slots=(2,)), record("u3", slots=(0,)), nothing], 2000)
    write(tmp_path, "x", [record("u9")], 3000, hour="2022/02/14/07")
    assert now_available(spark, tmp_path) == ["u3"]


def test_no_folder_and_no_file(spark, tmp_path):
    assert now_available(spark, tmp_path) == []
    (tmp_path / "connect/AEs/2022/02/14/08").mkdir(parents=True)
    assert now_available(spark, tmp_path) == []
    write(tmp_path, "empty", [], 1000)
    assert now_available(spark, tmp_path) == []


@pytest.mark.parametrize(
    "raw",
    [
        "not json",
        json.dumps(record("u1"), separators=(",", ":")) + '{"AWSAccountId": broken',
        json.dumps(record("u1"), separators=(",", ":")) + "\n" + json.dumps(record("u2"), separators=(",", ":")),
        json.dumps(record("u1"), separators=(",", ":")) + "]",
    ],
)
def test_malformed_file_gives_nobody(spark, tmp_path, raw):
    write(tmp_path, "f", [], 1000, raw=raw)
    assert now_available(spark, tmp_path) == []


def test_odd_records(spark, tmp_path):
    records = [record("no slots", slots=()), record('u}{"x', slots=(1, 0)), record("second only", slots=(0, 3)), record(None)]
    records += [record("größe 漢字", account=str(i)) for i in range(3)]
    write(tmp_path, "f", records, 1000)
    assert now_available(spark, tmp_path) == sorted(['u}{"x', "größe 漢字"])


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    write(tmp_path, "f", [record(f"u{i}", slots=(i % 2,)) for i in range(5000)], 1000)
    path = str(tmp_path / "connect/AEs/2022/02/14/08/f")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        pieces = snapshots.read_pieces(spark, path)
        assert pieces.rdd.getNumPartitions() > 3
        assert snapshots.available_agents(pieces).count() == 2500
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stream_keeps_the_latest_state(spark, tmp_path):
    root = tmp_path / "in"
    table, progress = str(tmp_path / "state"), str(tmp_path / "progress")

    def catch_up():
        stream = availability.arriving(spark, str(root), files_per_trigger=1)
        availability.keep_up(stream, table, progress).awaitTermination()
        return {r.ldap: r.available for r in availability.read_state(spark, table).collect()}

    write(root, "f1", [record("a"), record("b"), record("c", "OFFLINE")], 1000)
    write(root, "f2", [record("a", "OFFLINE"), record("c", slots=(0,)), record("c", slots=(2,))], 2000)
    assert catch_up() == {"a": False, "b": True, "c": True}
    # A late file of an earlier hour changes only what was not known before.
    write(root, "late", [record("a"), record("d")], 9000, hour="2022/02/14/07")
    assert catch_up() == {"a": False, "b": True, "c": True, "d": True}
    write(root, "f3", [record("a"), record("b", "OFFLINE")], 3000, hour="2022/02/14/09")
    assert catch_up() == {"a": True, "b": False, "c": True, "d": True}


def test_state_does_not_grow_with_batches(spark, tmp_path):
    root, table = tmp_path / "in", str(tmp_path / "state")
    for i in range(6):
        write(root, f"f{i}", [record("a", slots=(i % 2,)), record(f"u{i}")], 1000 + i, hour=f"2022/02/14/{i:02d}")
    stream = availability.arriving(spark, str(root), files_per_trigger=1, archive=str(tmp_path / "done"))
    availability.keep_up(stream, table, str(tmp_path / "progress")).awaitTermination()
    found = availability.versions(spark, table)
    assert found == [4, 5]
    state = availability.read_state(spark, table)
    assert state.count() == 7 and {r.ldap: r.available for r in state.collect()}["a"] is True
    # Files that are dealt with leave the folder that is listed.
    assert len(list(root.rglob("f?"))) < 6


def test_no_state_yet(spark, tmp_path):
    assert availability.read_state(spark, str(tmp_path / "none")).collect() == []


def test_run_folder_can_be_cleared(spark):
    from callboard import session

    kept = session.materialize(spark.range(3).toDF("i"), "test-clear")
    folder = session.run_folder(spark)
    assert kept.count() == 3 and os.path.isdir(folder)
    session.clear(spark)
    assert not os.path.isdir(folder)
    session.clear(spark)
    assert session.materialize(spark.range(2).toDF("i"), "test-clear").count() == 2


def test_scorecard_store(spark):
    path = new_folder(spark, "test-scorecard")
    rows = spark.createDataFrame([("i", "a", 1.0), ("i", "b", 2.0), ("j", "a", 3.0)], "issue_code STRING, ldap STRING, score DOUBLE")
    scorecards.write(rows, path)
    changes = spark.createDataFrame(
        [("i", "a", 5.0, 2), ("i", "a", 4.0, 1), ("k", "z", 9.0, 1)], "issue_code STRING, ldap STRING, score DOUBLE, at INT"
    )
    for _ in range(2):
        scorecards.save(spark, path, changes, ["at"])
        found = {(r.issue_code, r.ldap): r.score for r in scorecards.read(spark, path).collect()}
        assert found == {("i", "a"): 5.0, ("i", "b"): 2.0, ("j", "a"): 3.0, ("k", "z"): 9.0}
    touched = scorecards.of_touched_issues(scorecards.read(spark, path), changes)
    assert "dynamicpruning" in touched._jdf.queryExecution().executedPlan().toString()
    best = scorecards.for_issue(scorecards.read(spark, path), "i")
    assert [r.ldap for r in best.collect()] == ["a", "b"]
    assert "PartitionFilters: [isnotnull(issue_code" in best._jdf.queryExecution().executedPlan().toString()
