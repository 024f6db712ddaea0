"""Copy and paste events in batch: which are audited, skipped or intercepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditflow.functions import lineage
from auditflow.functions.text import strip
from auditflow.operators.sequences import SLICE, running, sliced

# Shortest stripped text that is looked at; a paste is counted in
# UTF-16 units, as a browser counts.
MIN_COPY_LENGTH, MIN_PASTE_LENGTH = 3, 6
PASTE_SOURCE = "extension"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points outside the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))


def long_enough(text: Column, source: Column) -> Column:
    body = strip(F.coalesce(text, F.lit("")))
    return F.when(source == PASTE_SOURCE, utf16_length(body) >= MIN_PASTE_LENGTH).otherwise(
        F.length(body) >= MIN_COPY_LENGTH)


def min_length_gate(events: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    return events.where(long_enough(F.col(text_col), F.col(source_col)))


def read_control(users: DataFrame, control: DataFrame, key: str = "user") -> DataFrame:
    """The present pause state per user; without any control row it is not paused."""
    state = pause_states(control, [key]).groupBy(key).agg(F.max_by("is_paused", F.struct(*_order(control))).alias("is_paused"))
    return users.join(state, key, "left").withColumn("is_paused", F.coalesce("is_paused", F.lit(False)))


def _order(control: DataFrame) -> list[str]:
    """Control rows stand in the order of their times, and at one time in that of ``seq``."""
    return ["ts", "seq"] if "seq" in control.columns else ["ts"]


def _with_state(rows: DataFrame, keys: list[str], order: list[str], is_control: Column) -> DataFrame:
    """Add ``is_paused``: what the control rows up to each row say, in one scan; a null ``paused`` flips."""
    flips, sets = is_control & F.col("paused").isNull(), is_control & F.col("paused").isNotNull()
    scanned = running(sliced(rows, keys, order), keys, order, last={"_set": F.when(sets, F.col("paused"))}, since={"_flips": (flips.cast("int"), sets)})
    odd = F.pmod("_flips", F.lit(2)) == 1
    return scanned.withColumn("is_paused", F.coalesce("_set", F.lit(False)) != odd).drop("_flips", "_set", SLICE)


def pause_states(control: DataFrame, keys: list[str]) -> DataFrame:
    """``control`` (keys, ts, paused, and seq where times repeat) with the state after each row; a null ``paused`` flips it."""
    return _with_state(control, keys, _order(control), F.lit(True))


def with_pause_state(events: DataFrame, control: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``is_paused`` as of each event (keys, ts); a control row counts from its own time on.

    Events and control rows are scanned together, so the states need no scan of their own.
    """
    tie = F.col("seq") if "seq" in control.columns else F.lit(0)
    said = control.select(*keys, "ts", F.col("paused").alias("_paused"), F.lit(0).alias("_kind"), tie.cast("long").alias("_tie"))
    both = events.withColumn("_kind", F.lit(1)).unionByName(said, allowMissingColumns=True)
    own = "paused" in both.columns  # a column of the events, which is kept
    named = (both.withColumnRenamed("paused", "_own") if own else both).withColumnRenamed("_paused", "paused")
    known = _with_state(named, keys, ["ts", "_kind", "_tie"], F.col("_kind") == 0).where(F.col("_kind") == 1).drop("_kind", "_tie", "paused")
    return known.withColumnRenamed("_own", "paused") if own else known


def pause_gate(events: DataFrame, control: DataFrame, keys: list[str]) -> DataFrame:
    """The events that arrive while the guard is not paused."""
    return with_pause_state(events, control, keys).where(~F.col("is_paused")).drop("is_paused")


def guard_decisions(audited: DataFrame, keys: list[str], order: list[str], text_col: str = "text",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """What a guard does with each event it looks at, in order per key.

    ``status`` is ``intercepted``, ``own_output`` (the text the guard itself wrote
    last), ``clean``, ``clean_repeat`` (the last text found clean, again) or
    ``unchanged`` (findings, but nothing to replace).  ``audited`` needs ``ts``.

    Whether a text is the guard's own output depends on the decision before, but
    only in three ways: with the previous event that has findings, a text equal to
    its output turns the decision round, an equal text repeats it, any other text is
    intercepted.  So an event is own output after an odd number of turns since
    the last such reset, which running sums can tell.
    """
    has_findings = F.size("findings") > 0
    changed = has_findings & (F.col("sanitized_text") != F.col(text_col))
    seen = audited.select(
        *keys, *[c for c in order if c not in keys], *[c for c in keep if c not in (*keys, *order)],
        F.when(changed, "dirty").when(has_findings, "unchanged").otherwise("clean").alias("_kind"),
        F.sha2(text_col, 256).alias("_in"), F.sha2("sanitized_text", 256).alias("_out"),
    )
    seen = sliced(lineage.written(seen), keys, order)  # the audit runs once, not for the ranges too
    is_dirty = F.col("_kind") == "dirty"
    # Events with findings: turn, repeat or reset against the previous one.
    paired = running(seen.where(is_dirty), keys, order, before={"_prev": F.struct("_in", "_out")})
    turn = F.coalesce(F.col("_in") == F.col("_prev._out"), F.lit(False))
    reset = ~turn & ~F.coalesce(F.col("_in") == F.col("_prev._in"), F.lit(False))
    turned = running(paired, keys, order, since={"_turns": (turn.cast("int"), reset)})
    judged = turned.select(*seen.columns, (F.pmod("_turns", F.lit(2)) == 1).alias("_skip"))

    # All events: the last text written and the number of interceptions so far.
    rest = seen.where(~is_dirty).withColumn("_skip", F.lit(False))
    written = is_dirty & ~F.col("_skip")
    every = running(lineage.written(judged.unionByName(rest)), keys, order, sums={"_writes": written.cast("int")},
                    last={"_written": F.when(written, F.col("_out"))})
    own = ~is_dirty & F.coalesce(F.col("_in") == F.col("_written"), F.lit(False))
    marked = lineage.written(every.withColumn("_own", own | F.col("_skip")))

    # Clean events that were audited: the same text as the one before, nothing intercepted between.
    is_clean = (F.col("_kind") == "clean") & ~F.col("_own")
    clean = running(marked.where(is_clean), keys, order, before={"_before": F.struct("_in", "_writes")})
    repeat = F.coalesce(F.col("_before") == F.struct("_in", "_writes"), F.lit(False))
    named = clean.withColumn("status", F.when(repeat, "clean_repeat").otherwise("clean"))
    others = marked.where(~is_clean).withColumn(
        "status", F.when(F.col("_own"), "own_output").when(is_dirty, "intercepted").otherwise("unchanged"))
    out = [c for c in seen.columns if not c.startswith("_")]
    return named.select(*out, "status").unionByName(others.select(*out, "status"))
