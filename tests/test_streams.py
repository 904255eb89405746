"""Streams that stop and go on: late events, state that ends, merges that run again."""

import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import latest_per_key
from tidemark.streaming import logs

T0 = datetime(2024, 1, 1)
SCHEMA = "listing_id bigint, event_id bigint, observed_at timestamp, price double, inactive boolean"


@pytest.fixture
def feed(spark, tmp_path):
    """Put rows (listing, event, hours, inactive) into a folder as a file, and read the folder as a stream."""
    source = tmp_path / "in"
    source.mkdir()

    def put(name, rows):
        frame = spark.createDataFrame([(k, e, T0 + timedelta(hours=h), float(e), f) for k, e, h, f in rows], SCHEMA)
        frame.coalesce(1).write.parquet(str(tmp_path / "made" / name))
        part = next(p for p in os.listdir(tmp_path / "made" / name) if p.startswith("part"))
        shutil.move(tmp_path / "made" / name / part, source / f"{name}.parquet")

    return put, lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)), str(tmp_path / "out")


def flips(rows):
    was, out = {}, set()
    for k, e, h, f in sorted(rows, key=lambda r: (r[2], r[1])):
        if f if k not in was else f != was[k]:
            out.add((k, e, f))
        was[k] = f
    return out


def test_changes_do_not_depend_on_arrival(feed):
    put, stream, out = feed
    first = [(1, 1, 0, False), (1, 4, 9, False), (2, 5, 9, True)]
    second = [(1, 2, 5, True), (2, 3, 3, False), (1, 6, 30, True), (3, 7, 31, True)]
    third = [(1, 8, 200, False), (9, 9, 201, True)]
    put("a", first)
    logs.drained(logs.change_log(stream(), "24 hours"), rocks=True, folder=out)
    put("b", second)
    logs.drained(logs.change_log(stream(), "24 hours"), rocks=True, folder=out)
    put("c", third)
    got = {(r["listing_id"], r["event_id"], r["inactive"]) for r in logs.drained(logs.change_log(stream(), "24 hours"), rocks=True, folder=out).collect()}
    assert got == {x for x in flips(first + second + third) if x[1] < 8}
    put("d", [(1, 10, 20, False), (7, 11, 400, True)])  # the first is older than the watermark
    got = {(r["listing_id"], r["event_id"], r["inactive"]) for r in logs.drained(logs.change_log(stream(), "24 hours"), rocks=True, folder=out).collect()}
    assert got == {x for x in flips(first + second + third) if x[1] < 10}


def test_silent_keys_leave_no_state(spark, feed):
    put, stream, out = feed
    put("a", [(k, k, 0, True) for k in range(50)])
    put("b", [(99, 100, 24 * 40, True)])
    put("c", [(98, 101, 24 * 90, True), (5, 102, 24 * 90, True)])
    put("d", [(98, 103, 24 * 120, False)])
    query = logs.change_log(stream(), "1 hour", idle_days=10)
    got = [r["event_id"] for r in logs.drained(query, rocks=True, folder=out).collect()]
    assert sorted(got) == [*range(50), 100, 101, 102]  # listing 5 had been forgotten, so it starts anew
    state = spark.read.format("statestore").option("stateVarName", "was").load(f"{out}/state")
    assert state.count() <= 4


def test_merges_rewrite_touched_buckets_and_run_once(spark, feed):
    put, stream, out = feed
    newest = lambda table, batch: latest_per_key(table.unionByName(batch), ["listing_id"], [F.desc("observed_at"), F.desc("event_id")])
    put("a", [(k, k, 0, True) for k in range(500)])
    assert logs.upserted(stream(), "listing_id", newest, out).count() == 500
    table = logs.BucketTable(spark, out, stream().schema, "listing_id")
    before = table.manifest()
    put("b", [(7, 1000, 5, False), (8, 1001, -5, False)])
    again = logs.upserted(stream(), "listing_id", newest, out)  # a new query on the same folder, as after a restart
    after = table.manifest()
    assert len(before) == 64 and 1 <= sum(after[b] != before[b] for b in after) <= 2
    rows = {r["listing_id"]: r["event_id"] for r in again.collect()}
    assert len(rows) == 500 and rows[7] == 1000 and rows[8] == 8
    # the driver was lost before the last batch was noted: it runs again and changes nothing
    commits = os.path.join(out, "state", "commits")
    last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))
    logs.upserted(stream(), "listing_id", lambda table, batch: 1 / 0, out)
    assert table.manifest() == after and len(table.versions()) == 2
    put("c", [(k, 2000 + k, 9, True) for k in range(0, 500, 2)])
    logs.upserted(stream(), "listing_id", newest, out)
    table.vacuum(1)
    assert len(table.versions()) == 1 and table.read().where("event_id >= 2000").count() == 250 and table.read().count() == 500
