"""Scans whose slices follow the data: one user with all events in one hour, ties, no rows."""

import random

import pytest
from pyspark.sql import functions as F

from auditflow.operators import events as ev
from auditflow.operators.sequences import SLICE, running, sliced


@pytest.fixture
def small_partitions(spark):
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def made(n, seed=6):
    """(user, ts, seq, paused, is control): nearly all of one user and one hour, many at one time."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        second = rnd.randint(0, n // 3)
        ts = f"2024-01-01 10:{second // 60 % 60:02d}:{second % 60:02d}"
        rows.append((rnd.choice(["hot"] * 30 + ["u1", None]), ts, k, rnd.choice([True, False, None, None]), rnd.random() < 0.2))
    return rows


def expected(rows):
    state, out = {}, {}
    for user, _, seq, paused, is_control in sorted(rows, key=lambda r: (r[1], not r[4], r[2])):
        if is_control:
            state[user] = (not state.get(user, False)) if paused is None else paused
        out[seq] = state.get(user, False)
    return out


def test_hot_user(spark, small_partitions):
    rows = made(3000)
    df = spark.createDataFrame(rows, "user string, ts string, seq long, paused boolean, control boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    control = df.where("control").select("user", "ts", "seq", "paused")
    copies = df.where("NOT control").select("user", "ts", "seq")
    want = expected(rows)
    got = {r.seq: r.is_paused for r in ev.with_pause_state(copies, control, ["user"]).collect()}
    assert got == {r[2]: want[r[2]] for r in rows if not r[4]}
    states = {r.seq: r.is_paused for r in ev.pause_states(control, ["user"]).collect()}
    assert states == {r[2]: want[r[2]] for r in rows if r[4]}
    parts = sliced(copies, ["user"], ["ts", "seq"]).where("user = 'hot'").groupBy(SLICE).count().collect()
    assert len(parts) >= 10 and max(r["count"] for r in parts) < 0.3 * len(rows)


def test_no_rows_and_columns_that_stay(spark):
    events = spark.createDataFrame([("u", "2024-01-01 10:00:00", True)], "user string, ts string, paused boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    control = events.select("user", "ts", F.lit(None).cast("boolean").alias("paused"))
    assert ev.with_pause_state(events, control, ["user"]).first().asDict() == {"user": "u", "ts": events.first().ts, "paused": True, "is_paused": True}
    assert ev.with_pause_state(events, control.limit(0), ["user"]).first().is_paused is False
    assert ev.with_pause_state(events.limit(0), control, ["user"]).collect() == []


def test_running_over_slices_of_the_data(spark, small_partitions):
    rnd = random.Random(3)
    rows = [(rnd.choice("aaaaaab"), i, rnd.randint(0, 2), rnd.choice([None, f"v{i}"]), rnd.random() < 0.1) for i in range(900)]
    df = sliced(spark.createDataFrame(rows, "k string, i int, x int, v string, r boolean"), ["k"], ["i"])
    got = running(df, ["k"], ["i"], sums={"s": F.col("x")}, last={"l": F.col("v")}, before={"b": F.col("v")}, since={"z": (F.col("x"), F.col("r"))}).collect()
    state = {}
    for row in sorted(got, key=lambda r: r.i):
        s, latest, z = state.get(row.k, (0, None, 0))
        before, s, latest, z = latest, s + row.x, row.v or latest, 0 if row.r else z + row.x
        state[row.k] = (s, latest, z)
        assert (row.s, row.l, row.b, row.z) == (s, latest, before, z), row
    assert len(got) == 900
