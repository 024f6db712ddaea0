"""The guard as a streaming query: gates, audit, keyed suppression, log and vault."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditflow.operators.anonymize import vault
from auditflow.operators.auditlog import (
    ACTIVITY_BINS, ACTIVITY_ROWS, RECENT, assign_log_ids, audit_summary, guardian_counters, log_entries)
from auditflow.operators.events import long_enough
from auditflow.operators.restore import merge_vaults, upsert_vault
from auditflow.operators.score import audit
from auditflow.sources.buckets import BUCKETS, read_buckets, update_buckets
from auditflow.sources.tables import write_batch

KEYS = ("user", "machine", "session_id")
IDLE_MS = 7 * 24 * 3600 * 1000
#: Ids that each micro-batch has for its log rows.
BATCH_IDS = 1 << 32
SESSION_DDL = "scope string, token string, original string, seq bigint, first_seq bigint, first_start int"
_STATE = "paused boolean, last_sanitized string, last_clean string"
#: Pause rows, and the state of the guard after them; "flip" turns it round.
_CONTROL = {"pause": True, "resume": False, "flip": None}


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    """Decide the events of one guard in order; the state is three short values.

    The events of a guard in one micro-batch are sorted together, so the size of a
    micro-batch bounds what is held.  A guard idle for ``idle_ms`` forgets its last texts,
    unless it is paused.
    """
    if state.hasTimedOut:
        state.remove()
        return
    # Plain lists: with many guards, frames of a few rows cost far more than deciding them.
    columns: dict[str, list] = {c: [] for c in ("seq", "kind", "text_hash", "sanitized_hash", "payload")}
    for batch in batches:
        for name, values in columns.items():
            values += batch[name].tolist()
    seq, kinds, texts, outputs, payloads = columns.values()
    order = sorted(range(len(seq)), key=lambda i: (seq[i] != seq[i], seq[i]))  # without a number: last
    paused, written, clean = state.get if state.exists else (False, None, None)
    statuses = []
    for i in order:
        kind = kinds[i]
        if kind in _CONTROL:
            paused = _CONTROL[kind] if kind != "flip" else not paused
            status = "control"
        elif paused:
            status = "paused"
        elif texts[i] == written:
            status = "own_output"
        elif texts[i] == clean:
            status = "clean_repeat"
        elif kind == "clean":
            status, clean = "clean", texts[i]
        elif kind == "dirty":
            status, written, clean = "intercepted", outputs[i], None
        else:
            status = "unchanged"
        statuses.append(status)
    state.update((paused, written, clean))
    if idle_ms is not None and not paused:
        state.setTimeoutDuration(idle_ms)
    out = {name: [value] * len(order) for name, value in zip(KEYS, key, strict=True)}
    out["seq"] = [seq[i] for i in order]
    out["payload"] = [payloads[i] if status == "intercepted" else None for i, status in zip(order, statuses, strict=True)]
    yield pd.DataFrame(out | {"status": statuses})


def guard_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Each looked-at event of a stream with its ``status``; interceptions carry their audit.

    A stream that runs on should give ``idle_ms``, IDLE_MS say, after which an idle guard's state
    expires.  With a trigger that ends by itself it must be None, as Spark goes on to wait
    for expiries.  For many guards set the RocksDB provider in
    ``spark.sql.streaming.stateStore.providerClass``, and bound the micro-batches with
    ``files_per_trigger`` of the source.

    A row without text is a pause row: ``paused`` sets the state of its guard, a null
    flips it.  The audit runs as native expressions before the keyed step, which
    compares hashes; only texts with findings travel through it.
    """
    looked_at = events.where(F.col("text").isNull() | long_enough(F.col("text"), F.col("source")))
    # A micro-batch may be one file and so one split: without this one task would audit all of it.
    looked_at = looked_at.repartition(2 * events.sparkSession.sparkContext.defaultParallelism, "seq")
    audited = audit(looked_at)
    has_findings = F.size("findings") > 0
    control = F.when(F.col("paused"), "pause").when(~F.col("paused"), "resume").otherwise("flip")
    kind = F.when(F.col("text").isNull(), control).when(
        has_findings & (F.col("sanitized_text") != F.col("text")), "dirty").when(
        has_findings, "unchanged").otherwise("clean")
    payload = F.struct("ts", "source", "text", "sanitized_text", "findings", "spans")
    shape = audited.select(payload.alias("p")).schema["p"].dataType
    narrow = audited.select(
        *KEYS, "seq", kind.alias("kind"), F.sha2("text", 256).alias("text_hash"),
        F.sha2("sanitized_text", 256).alias("sanitized_hash"),
        F.when(kind == "dirty", F.to_json(payload)).alias("payload"),
    )
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    decided = narrow.groupBy(*KEYS).applyInPandasWithState(
        partial(_decide, idle_ms=idle_ms), "user string, machine string, session_id string, seq bigint, payload string, status string",
        _STATE, "append", timeout)
    return decided.select(*KEYS, "seq", "status", F.from_json("payload", shape).alias("p")).select(
        *KEYS, "seq", "status", "p.*")


def start_guard(events: DataFrame, path: str, checkpoint: str, keep_original: bool = False,
                sessions: bool = False, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Run the guard: per micro-batch, write the log, the vault entries and the statuses.

    Each batch has folders of its own, so a batch that is replayed after a failure
    replaces what it wrote before.  A log row's id is made of its batch and its place in it
    (from 1, by guard and ``seq``), so ids are unique, ascend from batch to batch, have no gap in a batch,
    and a replay gives the same ones.  With ``sessions`` the vault of the sessions is kept as well
    (``session_store``), in buckets of which a batch rewrites only those that its sessions fall into.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        hits = batch.where(F.col("status") == "intercepted")
        numbered = assign_log_ids(log_entries(hits, keep_original), [*KEYS, "seq"])
        log = numbered.withColumn("id", F.col("id") + F.lit(batch_id).cast("long") * BATCH_IDS)
        write_batch(log, f"{path}/log", batch_id)
        scope = F.concat_ws("/", *KEYS)
        entries = vault(hits, "session_id", scope, F.col("seq"))
        write_batch(entries, f"{path}/vault", batch_id)
        write_batch(batch.select(*KEYS, "seq", "status"), f"{path}/statuses", batch_id)
        if sessions:
            new = batch.sparkSession.read.schema(entries.schema).parquet(f"{path}/vault/batch_id={batch_id}")
            update_buckets(upsert_vault(new), f"{path}/sessions", ["scope"], batch_id, merge_vaults, buckets)
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def session_store(spark: SparkSession, path: str) -> DataFrame:
    """The vault of each session (SESSION_DDL) after the last micro-batch of ``start_guard(sessions=True)``."""
    return read_buckets(spark, f"{path}/sessions", SESSION_DDL)


def session_vault(entries: DataFrame) -> DataFrame:
    """The merged vault of each session, the last value per token."""
    return upsert_vault(entries)


def running_counters(audits: DataFrame) -> DataFrame:
    """Counters by source over a stream of audits (``source, n_findings``)."""
    return guardian_counters(audits, "source")


def start_live_summary(audits: DataFrame, name: str, checkpoint: str,
                       interval: str = "1500 milliseconds", **trigger) -> StreamingQuery:
    """Keep the counters by source in the in-memory table ``name``, refreshed at ``interval``."""
    trigger = trigger or {"processingTime": interval}
    return running_counters(audits).writeStream.outputMode("complete").format("memory").queryName(name).option(
        "checkpointLocation", checkpoint).trigger(**trigger).start()


_COUNTS = ("total_events", "total_threats_blocked", "secrets_count", "pii_count", "financial_count")
SUMMARY_DDL = (", ".join(f"{c} bigint" for c in _COUNTS) + ", recent array<struct<id:bigint,seq:bigint,source:string,threats_count:int>>, "
               "activity array<bigint>, is_paused boolean")


def start_summary(log: DataFrame, path: str, checkpoint: str, is_paused: bool = False, **trigger) -> StreamingQuery:
    """Keep the summary of a stream of log rows (``seq, ts, source, threats_count, categories``) as a table.

    Each micro-batch adds its totals and its newest rows to the summary before it and writes
    the new one, a single row, into a folder of its own; so a replayed batch starts from the same
    summary again.  Ids count on over the batches.  Per batch the totals and at most 30 rows come
    to the driver, however large it is.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.select("seq", "ts", "source", "threats_count", "categories").persist()
        before = spark.read.schema(SUMMARY_DDL).parquet(f"{path}/batch_id={batch_id - 1}").first() if batch_id else None
        added = audit_summary(batch).first()
        totals = {c: added[c] + (before[c] if before else 0) for c in _COUNTS}
        newest = batch.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(RECENT).collect()
        rows = [(totals["total_events"] - k, r["seq"], r["source"], r["threats_count"]) for k, r in enumerate(newest)]
        rows = (rows + [tuple(r) for r in (before["recent"] if before else [])])[:RECENT]
        activity = [0] * ACTIVITY_BINS
        for number, _, _, threats in rows[:ACTIVITY_ROWS] if totals["total_threats_blocked"] else []:
            activity[(number - 1) % ACTIVITY_BINS] += 1 if threats is None else threats
        summary = spark.createDataFrame([(*totals.values(), rows, activity, is_paused)], SUMMARY_DDL)
        write_batch(summary.coalesce(1), path, batch_id)
        batch.unpersist()

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
