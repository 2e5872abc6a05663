"""Streams with state: what is stable and gone among watched files, alerts with a cooldown; state that ends."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakescreen.streaming import watch

BEGIN = datetime(2024, 1, 1, tzinfo=UTC)
LOOK = "path string, mtime double, size long, look long, at timestamp"
PASTE = "source string, ts timestamp, hash string, severe boolean"


@pytest.fixture
def own(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", watch.STATE_STORE)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


def run(session, tmp_path, schema, parts, of):
    """Rows that a stream gives for parts that come one after another, a batch each."""
    out = str(tmp_path / "out")
    for part in parts:
        session.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = of(session.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return session.read.schema(stream.schema).parquet(out).collect()


def state(session, tmp_path, name):
    return session.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", name).load()


def at(look):
    return BEGIN + timedelta(seconds=5 * look)


def test_files_are_stable_and_gone_and_leave_no_state(own, tmp_path):
    seen = {
        1: [("/a", 1.0, 5)], 2: [("/a", 1.0, 5), ("/b", 1.0, 1), ("/~$x", 1.0, 1)], 3: [("/a", 1.0, 5), ("/b", 2.0, 2), ("/~$x", 1.0, 1)], 4: [("/b", 2.0, 2)], 5: [("/b", 2.0, 2)],
        6: [("/c", 1.0, 1)], 7: [("/c", 1.0, 1)], 8: [("/c", 1.0, 1), ("/a", 1.0, 5)], 9: [("/a", 1.0, 5)], 20: [("/d", 1.0, 1)], 40: [("/e", 1.0, 1)],
    }
    looks = [[(*f, look, at(look)) for f in files] for look, files in seen.items()]
    parts = [looks[0], looks[1] + looks[2], *looks[3:9], looks[9], looks[10]]
    got = sorted((r.path, r.event, r.look) for r in run(own, tmp_path, LOOK, parts, watch.file_events))
    assert got == [("/a", "gone", 3), ("/a", "gone", 9), ("/a", "stable", 9), ("/b", "gone", 5), ("/b", "stable", 4), ("/c", "gone", 8), ("/c", "stable", 7), ("/d", "gone", 20)]
    assert [r.key.path for r in state(own, tmp_path, "seen").collect()] == ["/e"]


def plain_alerts(rows, cooldown, forgotten):
    """Alerts by the rules as they are said."""
    out, by = [], {}
    for source, ts, hash_, severe in sorted(rows, key=lambda r: (r[1], r[2])):
        last, last_at, told, told_at = by.get(source, (None,) * 4)
        if last_at is not None and (ts - last_at).total_seconds() > forgotten:
            last = told = told_at = None
        hit = severe and hash_ != last and hash_ != told and (told_at is None or (ts - told_at).total_seconds() >= cooldown)
        out += [(source, ts.replace(tzinfo=None), hash_)] * hit
        by[source] = hash_, ts, hash_ if hit else told, ts if hit else told_at
    return sorted(out)


def test_alerts_with_a_cooldown_in_a_table_and_a_stream(own, tmp_path):
    rng = random.Random(2)
    times = sorted(rng.sample(range(4000), 300))
    rows = [(rng.choice("stu"), BEGIN + timedelta(seconds=t), rng.choice("xyz"), rng.random() < 0.7) for t in times]
    rows += [("s", BEGIN + timedelta(days=9), "x", True), ("v", BEGIN + timedelta(days=9), "x", True), ("v", BEGIN + timedelta(days=9, seconds=3), "y", True), ("v", BEGIN + timedelta(days=9, seconds=8), "y", True)]
    want = plain_alerts(rows, 8, 60)
    utc = lambda r: (r.source, r.ts if isinstance(r.ts, str) else r.ts.astimezone(UTC).replace(tzinfo=None), r.hash)
    table = own.createDataFrame(rows, PASTE).repartition(3)
    assert sorted(map(utc, watch.throttled(table, 8, 60).collect())) == want and len(want) > 20
    parts = [rows[:40], rows[40:41], rows[41:200], rows[200:300], rows[300:302], rows[302:]]
    got = run(own, tmp_path, PASTE, parts, lambda s: watch.throttle(s, 8, 60))
    assert sorted(map(utc, got)) == want
    assert {r.key.source for r in state(own, tmp_path, "told").collect()} == {"s", "v"}


def test_a_look_tells_its_time(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    reader = watch.FolderReader({"path": str(tmp_path)})
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    assert [r[:1] + r[2:4] for r in rows] == [(str(tmp_path / "a.txt"), 1, 1)] and end == {"look": 1}
    assert abs((rows[0][4] - datetime.now(UTC)).total_seconds()) < 60
    assert watch.watch(spark, str(tmp_path)).where(F.col("at").isNotNull()).columns == ["path", "mtime", "size", "look", "at"]
