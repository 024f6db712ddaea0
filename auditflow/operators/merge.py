"""From findings to kept spans: union, dedupe, grounding, location, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditflow.functions.folds import bind, fold
from auditflow.functions.index import WINDOW, places, windows
from auditflow.functions.lineage import unbroadcast
from auditflow.functions.text import computed_once, sql_name, strip
from auditflow.operators.anonymize import tag_of
from auditflow.operators.detect import FINDING

#: From so many findings on, the text is indexed.
INDEXED = 200
SPAN = "struct<start:int,finding_ord:int,len:int,category:string,tag:string,original:string>"


def semantic_arrays(semantic: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per text with its external findings in their order.

    The group is what a model reported for one text, so it is bounded by the text.
    """
    finding = F.struct(
        F.col("ord").cast("int").alias("finding_ord"),
        F.lit(None).cast("int").alias("rule_ord"),
        F.concat(F.lit("f"), F.col("ord")).alias("id"),
        "category", "severity", "verbatim_quote", "entity_type", "suggested_synthetic",
        "risk_explanation", F.lit("semantic").alias("source"),
    ).cast(FINDING)
    return semantic.groupBy(key).agg(F.array_sort(F.collect_list(finding)).alias("semantic"))


def with_merged(df: DataFrame, semantic: DataFrame | None = None, key: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Put external findings before the rule findings and renumber what remains.

    A finding is kept if its stripped quote is new for the text and occurs in it; what a
    rule found occurs in any case.  Without external findings the rule findings are distinct and grounded already.
    """
    if semantic is None:
        return df
    kept = [c for c in df.columns if c != "findings"]
    joined = df.join(unbroadcast(semantic_arrays(semantic, key)), key, "left")
    every = joined.select(*kept, F.concat(
        F.coalesce("semantic", F.array().cast(f"array<{FINDING}>")), "findings").alias("_all"))
    quoted = every.select(*kept, "_all", F.transform(
        "_all", lambda f: strip(F.coalesce(f["verbatim_quote"], F.lit("")))).alias("_quotes"))
    by_quote = quoted.select(*kept, "_all", "_quotes", F.array_sort(
        F.transform("_quotes", lambda q, i: F.struct(q.alias("quote"), i.alias("at")))).alias("_sorted"))
    # The first finding of each quote, in the order of the findings.
    first = by_quote.select(*kept, "_all", "_quotes", F.expr(
        "array_sort(transform(filter(_sorted, (s, i) -> s.quote <> '' AND (i = 0 OR get(_sorted, i - 1).quote <> s.quote)), s -> s.at))").alias("_first"))
    grounded = F.filter("_first", lambda i: (F.get("_all", i)["source"] == "pattern_rule") | F.contains(F.col(text_col), F.get("_quotes", i)))
    numbered = F.transform(grounded, lambda at, i: F.get("_all", at).withField("finding_ord", (i + 1).cast("int")))
    return first.select(*kept, computed_once(numbered).alias("findings"))


def _located(text_col: str) -> Column:
    """All non-overlapping occurrences of every finding's quote, left to right.

    With few findings each quote is searched by splitting the text at it: the lengths of the
    pieces give the positions.  That costs a pass over the text for each quote.  With more
    than INDEXED findings the windows of the text are sorted once, and a quote
    of at most WINDOW signs is found by binary search.
    """
    quoted = r"concat(r'\Q', replace(f.verbatim_quote, r'\E', r'\E\\E\Q'), r'\E')"
    text = sql_name(text_col)
    pieces = f"split({text}, {quoted}, -1)"
    span = ("struct({at}, f.finding_ord, length(f.verbatim_quote), "
            f"coalesce(f.category, 'PII'), {tag_of('f')}, f.verbatim_quote)")
    step = (f"named_struct('pos', a.pos + length(x) + length(f.verbatim_quote), "
            f"'out', concat(a.out, array(cast({span.format(at='a.pos + length(x)')} as {SPAN}))))")
    # Most quotes occur once: behind the first piece.
    once = f"array(cast({span.format(at='length(get(p, 0))')} as {SPAN}))"
    by_split = bind(pieces, "p", f"CASE WHEN size(p) = 2 THEN {once} ELSE {bind('slice(p, 1, size(p) - 1)', 'q', fold('q', SPAN, step))} END")
    # Places of a quote that overlaps itself are taken from the left.
    apart = fold("at", "int", "CASE WHEN x >= a.pos THEN named_struct('pos', x + length(f.verbatim_quote), 'out', concat(a.out, array(x))) ELSE a END")
    overlaps = "size(filter(at, (x, i) -> i > 0 AND x < get(at, i - 1) + length(f.verbatim_quote))) > 0"
    own = f"CASE WHEN {overlaps} THEN {apart} ELSE at END"
    by_index = bind(places("idx", "f.verbatim_quote"), "at", f"transform({own}, x -> cast({span.format(at='x')} as {SPAN}))")
    few = f"transform(findings, f -> {by_split})"
    many = bind(windows(text), "idx", f"transform(findings, f -> CASE WHEN length(f.verbatim_quote) <= {WINDOW} THEN {by_index} ELSE {by_split} END)")
    return F.expr(f"flatten(CASE WHEN size(findings) <= {INDEXED} THEN {few} ELSE {many} END)")


def _without_overlaps(spans: str) -> Column:
    """Keep a span if it starts at or after the end of the last kept one.

    ``spans`` is sorted by (start, finding order), so equal starts favour the
    earlier finding, not the longer one.
    """
    return F.expr(fold(spans, SPAN, "CASE WHEN x.start >= a.pos THEN named_struct("
                       "'pos', x.start + x.len, 'out', concat(a.out, array(x))) ELSE a END"))


def with_spans(df: DataFrame, text_col: str = "text", longest: bool = False) -> DataFrame:
    """Add ``spans``: where the findings are replaced, in text order (0-based start).

    ``longest`` prefers the longest span among those with the same start.
    """
    kept = df.columns
    located = _located(text_col)
    if longest:
        ordered = F.array_sort(located, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                               .when(a["len"] != b["len"], b["len"] - a["len"])
                               .otherwise(a["finding_ord"] - b["finding_ord"]))
    else:
        ordered = F.array_sort(located)
    staged = df.select(*kept, ordered.alias("_located"))
    return staged.select(*kept, computed_once(_without_overlaps("_located")).alias("spans"))
