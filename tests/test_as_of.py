"""Requests as of their time, the state by hour folders, agents that are not heard of any more."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from test_snapshots import record, write

from callboard.plans import routing
from callboard.sources import snapshots
from callboard.streaming import availability, expiring

START = datetime(2022, 2, 14, 6, tzinfo=timezone.utc)


def at(hours, minutes=0):
    return START + timedelta(hours=hours, minutes=minutes)


def folder_of(when):
    return when.strftime("%Y/%m/%d/%H")


def put(root, name, records, when, hour=None, raw=None):
    write(root, name, records, int(when.timestamp()), hour=folder_of(hour or when), raw=raw)


def seen(spark, root):
    return snapshots.agents(snapshots.read_pieces(spark, str(root / "connect/AEs")))


CARD = [("i", "a", 3.0), ("i", "b", 2.0), ("i", "c", 2.0), ("i", "n", None), ("j", "b", 1.0), ("j", "ü", 9.0)]


@pytest.fixture
def card(spark):
    return spark.createDataFrame(CARD, "issue_code STRING, ldap STRING, score DOUBLE")


def asked(spark, *rows):
    return spark.createDataFrame([(i, issue, when) for i, (issue, when) in enumerate(rows)], "id INT, issue_code STRING, at TIMESTAMP")


def answers(df):
    return {r.id: r.ldap for r in df.collect()}


def test_requests_are_answered_by_the_newest_file_of_their_moment(spark, tmp_path, card):
    put(tmp_path, "f1", [record("a"), record("b")], at(0, 10))
    put(tmp_path, "f2", [record("a", "OFFLINE"), record("b"), record("ü")], at(0, 40))
    put(tmp_path, "f3", [record("c"), record("b")], at(2, 5))
    put(tmp_path, "f4", [], at(2, 30), raw="not json")
    moments = [("i", at(0, 5)), ("i", at(0, 10)), ("i", at(0, 39)), ("i", at(0, 41)), ("j", at(0, 59)), ("i", at(1, 0)), ("i", at(2, 6))]
    moments += [("i", at(2, 31)), ("unknown", at(0, 20)), (None, at(0, 20)), ("i", None), ("i", at(9))]
    requests = asked(spark, *moments)
    none = routing.NOT_FOUND
    # b and c tie; a file that does not parse has nobody; no file yet; no folder.
    want = [none, "a", "a", "b", "ü", none, "b", none, none, none, none, none]
    assert answers(routing.route_as_of(requests, card, seen(spark, tmp_path))) == dict(enumerate(want))
    back = answers(routing.route_as_of(requests, card, seen(spark, tmp_path), hours_back=1))
    assert back == dict(enumerate(want)) | {5: "b"}


def test_many_equal_requests_are_all_answered(spark, tmp_path, card):
    put(tmp_path, "f1", [record("a")], at(0, 10))
    requests = asked(spark, *[("i", at(0, 20))] * 500).drop("id")
    found = routing.route_as_of(requests, card, seen(spark, tmp_path))
    assert found.columns == ["issue_code", "at", "ldap"] and [r.ldap for r in found.collect()] == ["a"] * 500


def test_hot_hours_and_issues_are_spread(spark, tmp_path, card, monkeypatch):
    from callboard.operators import skew

    monkeypatch.setattr(skew.hot_keys, "__defaults__", (50,))
    put(tmp_path, "f1", [record("a"), record("b")], at(0, 10))
    put(tmp_path, "f2", [record("b")], at(1, 10))
    rows = [("i", at(0, 20))] * 400 + [("j", at(1, 20))] * 30 + [("i", at(1, 5))] * 5
    found = routing.route_as_of(asked(spark, *rows), card, seen(spark, tmp_path))
    want = dict(enumerate(["a"] * 400 + ["b"] * 30 + [routing.NOT_FOUND] * 5))
    assert answers(found) == want and "_place" in found._jdf.queryExecution().toString()


def test_empty_inputs(spark, tmp_path, card):
    put(tmp_path, "f1", [record("a")], at(0, 10))
    assert routing.route_as_of(asked(spark).limit(0), card, seen(spark, tmp_path)).collect() == []
    nobody = seen(spark, tmp_path).limit(0)
    assert answers(routing.route_as_of(asked(spark, ("i", at(0, 20))), card, nobody)) == {0: routing.NOT_FOUND}
    assert answers(routing.route_as_of(asked(spark, ("i", at(0, 20))), card.limit(0), seen(spark, tmp_path))) == {0: routing.NOT_FOUND}


# The state by hour folders.


def state(spark, table):
    return {r.ldap: r.available for r in availability.read_state(spark, table).collect()}


def test_state_by_hour_folders(spark, tmp_path):
    root, table = tmp_path / "in", str(tmp_path / "state")
    put(root, "f1", [record("a"), record("b")], at(0, 10))
    put(root, "f2", [record("a", "OFFLINE")], at(1, 10))
    assert availability.advance(spark, str(root), table, at(0, 30), since=at(0)) == 1
    assert state(spark, table) == {"a": True, "b": True}
    assert availability.advance(spark, str(root), table, at(1, 30), since=at(0)) == 2
    assert state(spark, table) == {"a": False, "b": True}
    # A late file of the hour before is taken in, and says nothing new about agents met since.
    put(root, "late", [record("a"), record("d")], at(1, 40), hour=at(0))
    availability.advance(spark, str(root), table, at(1, 50), since=at(0))
    assert state(spark, table) == {"a": False, "b": True, "d": True}
    before = availability.versions(spark, table)
    availability.advance(spark, str(root), table, at(1, 55), since=at(0))
    assert availability.versions(spark, table) == before


def test_listings_do_not_grow_with_history(spark, tmp_path):
    root, table = tmp_path / "in", str(tmp_path / "state")
    listed = []
    for i in range(12):
        put(root, f"f{i}", [record("a", slots=(i % 2,))], at(i, 10))
        listed.append(availability.advance(spark, str(root), table, at(i, 30), since=at(0)))
    assert max(listed) <= 3 and state(spark, table) == {"a": True}
    assert len(availability.versions(spark, table)) == availability.KEPT_VERSIONS


def test_state_by_hour_with_a_time_limit(spark, tmp_path):
    root, table = tmp_path / "in", str(tmp_path / "state")
    put(root, "f1", [record("a"), record("b")], at(0, 10))
    put(root, "f2", [record("b")], at(2, 10))
    availability.advance(spark, str(root), table, at(2, 30), since=at(0), expiry_hours=2)
    assert state(spark, table) == {"b": True}
    assert availability.advance(spark, str(root), table, at(9), since=at(0), expiry_hours=2) == 9
    assert state(spark, table) == {}
    # How far it came is kept with nobody left.
    assert availability.advance(spark, str(root), table, at(9, 30), since=at(0), expiry_hours=2) == 9
    assert availability.advance(spark, str(root), str(tmp_path / "none"), at(0, 5), since=at(0)) == 1


# Agents that are not heard of any more, as a stream.


def log_of(spark, root, folder, progress, hours=2.0, files=1):
    stream = availability.arriving(spark, str(root), files_per_trigger=files)
    query = expiring.keep_log(expiring.changes(stream, hours), folder, progress)
    query.awaitTermination()
    rows = spark.read.schema(expiring.CHANGE_SCHEMA).parquet(folder).collect()
    return query, sorted((r.ldap, r.at.astimezone(timezone.utc), r.available, r.expired) for r in rows)


@pytest.mark.parametrize("files", [1, 100])
def test_agents_expire(spark, tmp_path, files):
    root, folder, progress = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "progress")
    put(root, "f1", [record("a"), record("b"), record("c", "OFFLINE"), record(None)], at(0))
    put(root, "f2", [record("b", "OFFLINE"), record("b", slots=(1,))], at(1))
    put(root, "f3", [record("b", "OFFLINE"), record("e")], at(2, 30))
    put(root, "f4", [record("a"), record("d")], at(7))
    query, found = log_of(spark, root, folder, progress, files=files)
    want = [
        ("a", at(0), True, False), ("a", at(2), False, True), ("a", at(7), True, False), ("b", at(0), True, False),
        ("b", at(2, 30), False, False), ("d", at(7), True, False), ("e", at(2, 30), True, False), ("e", at(4, 30), False, True),
    ]
    assert found == sorted(want)
    available = {h: sorted(r.ldap for r in expiring.available_agents(spark, folder, at(h)).collect()) for h in (1, 3, 8)}
    assert available == {1: ["a", "b"], 3: ["e"], 8: ["a", "d"]}


def test_state_of_the_stream_is_bounded_and_survives_a_restart(spark, tmp_path):
    root, folder, progress = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "progress")
    rows = []
    for part in range(2):
        for i in range(6 * part, 6 * part + 6):
            put(root, f"f{i}", [record(f"u{i}"), record("steady")], at(i))
        query, rows = log_of(spark, root, folder, progress)
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        # At most three files' agents have a record and a timer each (an index of the timers beside it).
        assert max(kept) <= 4 * 4
    assert [r for r in rows if r[0] == "steady"] == [("steady", at(0), True, False)]
    assert [r for r in rows if r[0] == "u3"] == [("u3", at(3), True, False), ("u3", at(5), False, True)]


def test_the_present_hour_is_the_default(spark, tmp_path):
    """without a time, files are looked for in the folder of the present hour in UTC."""
    for when in {datetime.now(timezone.utc) + timedelta(seconds=s) for s in (0, 30)}:
        put(tmp_path, "now", [record("here")], when)
    put(tmp_path, "old", [record("gone")], datetime.now(timezone.utc) - timedelta(hours=3))
    assert [r.ldap for r in snapshots.available_now(spark, str(tmp_path)).collect()] == ["here"]
    assert os.path.isdir(tmp_path / "connect/AEs")
