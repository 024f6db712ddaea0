import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditflow.operators import events as ev
from auditflow.operators.score import audit
from auditflow.operators.sequences import SLICE, running
from auditflow.sources.tables import EVENT_DDL, read_event_stream
from auditflow.streaming import guard

COPY = "user string, machine string, session_id string, seq bigint, ts timestamp, source string, text string, paused boolean"


def test_running_against_a_loop(spark):
    rnd = random.Random(3)
    rows = [(k, i, i // 4, rnd.randint(0, 2), rnd.choice([None, f"v{i}"]), rnd.random() < 0.3)
            for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, f"k string, i int, {SLICE} int, x int, v string, r boolean")
    got = running(df, ["k"], ["i"], sums={"s": F.col("x")}, last={"l": F.col("v")}, before={"b": F.col("v")},
                  since={"z": (F.col("x"), F.col("r"))}).orderBy("k", "i").collect()
    state = {}
    for row in got:
        s, latest, z = state.get(row.k, (0, None, 0))
        before = latest
        s += row.x
        latest = row.v or latest
        z = 0 if row.r else z + row.x
        state[row.k] = (s, latest, z)
        assert (row.s, row.l, row.b, row.z) == (s, latest, before, z), row


def test_length_gate(spark):
    rows = [("desktop", " ab "), ("desktop", "abc"), ("extension", "abcde"), ("extension", "abcd𝐀"), ("extension", None)]
    df = spark.createDataFrame(rows, "source string, text string")
    assert [r.text for r in ev.min_length_gate(df).collect()] == ["abc", "abcd𝐀"]


def make_events(spark, n=400):
    rnd = random.Random(5)
    pool = ["password hunter1", "password hunter2", "password [PASSWORD_1]", "plain note", "other note", "call 9812345678",
            "call [PHONE_1]", "ab", "plain note"]
    rows = []
    for i in range(n):
        user = rnd.choice(["u1"] * 5 + ["u2", "u3"])
        ts = f"2024-01-{1 + i // 60:02d} 00:{i % 60:02d}:00"
        if rnd.random() < 0.06:
            rows.append((user, "m", "s", i, ts, "desktop", None, rnd.choice([True, False, None])))
        else:
            rows.append((user, "m", "s", i, ts, rnd.choice(["desktop", "extension"]), rnd.choice(pool), None))
    return spark.createDataFrame(rows, COPY.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def by_hand(events, audits):
    """Statuses of the looked-at events, one event at a time."""
    state, out = {}, {}
    for e in sorted(events, key=lambda e: e.seq):
        paused, written, clean = state.get(e.user, (False, None, None))
        if e.text is None:
            state[e.user] = ((not paused) if e.paused is None else e.paused, written, clean)
            continue
        if len(e.text.strip()) < (6 if e.source == "extension" else 3):
            continue
        sanitized, n = audits[e.text]
        if paused:
            out[e.seq] = "paused"
        elif e.text == written:
            out[e.seq] = "own_output"
        elif e.text == clean:
            out[e.seq] = "clean_repeat"
        elif not n:
            out[e.seq], clean = "clean", e.text
        elif sanitized != e.text:
            out[e.seq], written, clean = "intercepted", sanitized, None
        else:
            out[e.seq] = "unchanged"
        state[e.user] = (paused, written, clean)
    return out


@pytest.fixture(scope="module")
def expected(spark):
    events = make_events(spark).collect()
    pool = sorted({e.text for e in events if e.text})
    audited = audit(spark.createDataFrame([(i, t) for i, t in enumerate(pool)], "doc_id bigint, text string")).collect()
    return by_hand(events, {r.text: (r.sanitized_text, r.n_findings) for r in audited})


def test_batch_decisions(spark, expected):
    events = make_events(spark)
    control = events.where("text is null").select("user", "ts", "paused")
    copies = ev.min_length_gate(events.where("text is not null")).drop("paused")
    gated = ev.pause_gate(copies, control, ["user"])
    got = {r.seq: r.status for r in ev.guard_decisions(audit(gated), ["user"], ["ts", "seq"]).collect()}
    assert got == {k: v for k, v in expected.items() if v != "paused"}
    assert set(got.values()) >= {"own_output", "clean_repeat", "clean", "intercepted"}


def test_stream_equals_batch(spark, expected, tmp_path):
    events = make_events(spark)
    for part in range(4):
        events.where(f"seq >= {part * 100} and seq < {part * 100 + 100}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = read_event_stream(spark, str(tmp_path / "in"), schema=EVENT_DDL)
    out = str(tmp_path / "out")
    query = guard.start_guard(guard.guard_stream(stream), out, str(tmp_path / "checkpoint"), keep_original=True, availableNow=True)
    query.awaitTermination()
    got = {r.seq: r.status for r in spark.read.parquet(f"{out}/statuses").collect() if r.status != "control"}
    assert got == expected
    log = spark.read.parquet(f"{out}/log")
    assert sorted(r.seq for r in log.select("seq").collect()) == sorted(k for k, v in expected.items() if v == "intercepted")
    vault = spark.read.parquet(f"{out}/vault")
    assert {r.scope for r in vault.collect()} == {"u1/m/s", "u2/m/s", "u3/m/s"}
    merged = {(r.scope, r.token): r.original for r in guard.session_vault(vault).collect()}
    assert merged[("u1/m/s", "[PHONE_1]")] == "9812345678"
    latest = max(e.seq for e in events.collect() if e.user == "u1" and expected.get(e.seq) == "intercepted" and "password" in e.text)
    assert merged[("u1/m/s", "[PASSWORD_1]")] == events.where(f"seq = {latest}").first().text.split()[1]


def test_stream_over_several_batches(spark, expected, tmp_path):
    events = make_events(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(4):
        events.where(f"seq >= {part * 100} and seq < {part * 100 + 100}").coalesce(1).write.mode("append").json(source)
        query = guard.start_guard(guard.guard_stream(read_event_stream(spark, source)), out, str(tmp_path / "c"), availableNow=True)
        query.awaitTermination()
    got = {r.seq: r.status for r in spark.read.parquet(f"{out}/statuses").collect() if r.status != "control"}
    assert got == expected


def test_live_summary(spark, tmp_path):
    spark.createDataFrame([("desktop", 2), ("extension", 0)], "source string, n_findings int").write.parquet(str(tmp_path / "a"))
    audits = spark.readStream.schema("source string, n_findings int").parquet(str(tmp_path / "a"))
    guard.start_live_summary(audits, "live_summary_test", str(tmp_path / "c"), availableNow=True).awaitTermination()
    got = {r.source: (r.total_scanned, r.desktop_interceptions) for r in spark.table("live_summary_test").collect()}
    assert got == {"desktop": (1, 1), "extension": (1, 0)}


def test_log_ids_of_a_stream(spark, expected, tmp_path):
    """Unique, ascending from batch to batch, without gaps in a batch, and the same after a replay."""
    events, source, out = make_events(spark), str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(10):
        events.where(f"seq >= {part * 40} and seq < {part * 40 + 40}").coalesce(1).write.mode("append").json(source)

    def run(checkpoint):
        stream = read_event_stream(spark, source, files_per_trigger=1)
        guard.start_guard(guard.guard_stream(stream), out, str(tmp_path / checkpoint), availableNow=True).awaitTermination()
        return sorted((r.id, r.seq, r.batch_id) for r in spark.read.parquet(f"{out}/log").collect())

    first = run("a")
    assert {r.seq: r.status for r in spark.read.parquet(f"{out}/statuses").collect() if r.status != "control"} == expected
    assert len({b for _, _, b in first}) > 5 and [i for i, _, _ in first] == sorted({i for i, _, _ in first})
    for batch in {b for _, _, b in first}:
        assert [i for i, _, b in first if b == batch] == [batch * guard.BATCH_IDS + 1 + k for k in range(sum(b == batch for _, _, b in first))]
    assert run("b") == first  # every batch again, into the same folders


class _State:
    """The state of one guard, as Spark hands it to the decision."""

    hasTimedOut, exists, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_guards_are_decided_without_a_frame_for_each(monkeypatch):
    for name in ("sort_values", "itertuples"):  # milliseconds for a guard of a few events
        monkeypatch.setattr(pd.DataFrame, name, None)
    rows = [  # seq, kind, text, sanitized, what is expected
        (None, "clean", "c", "c", "clean_repeat"), (3, "dirty", "a", "b", "intercepted"), (1, "clean", "c", "c", "clean"),
        (4, "dirty", "b", "b2", "own_output"), (2, "clean", "c", "c", "clean_repeat"), (5, "clean", "c", "c", "clean"), (6, "flip", None, None, "control"),
        (7, "clean", "d", "d", "paused"), (8, "resume", None, None, "control"), (9, "unchanged", "e", "e", "unchanged"),
        (10, "pause", None, None, "control"), (11, "flip", None, None, "control"),
    ]
    frame = pd.DataFrame([("u", "m", "s", *r[:4], f"p{r[0]}") for r in rows],
                         columns=[*guard.KEYS, "seq", "kind", "text_hash", "sanitized_hash", "payload"])
    state = _State()
    out = pd.concat(guard._decide(("u", "m", "s"), iter([frame[:5], frame[5:]]), state, None))
    want = {r[0]: r[4] for r in rows}
    assert {None if pd.isna(s) else int(s): t for s, t in zip(out["seq"], out["status"], strict=True)} == want
    assert out["payload"].dropna().tolist() == ["p3"] and state.get == (False, "b", "c")
    again = pd.concat(guard._decide(("u", "m", "s"), iter([frame[3:4], frame[2:3]]), state, None))
    assert again["status"].tolist() == ["clean_repeat", "own_output"]
