"""Detection: from texts to classified findings, row by row.

Nothing here shuffles.  Each text is scanned where it was read, and the findings
stay in its row as an array until a caller asks for the exploded table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditflow.functions.dialect import STRIP_REGEX, java_regex, skipping_runs
from auditflow.functions.text import computed_once, sql_name, sql_strings, sql_text
from auditflow.operators.gates import GATES, is_open, with_gates
from auditflow.rules import RULES, Pattern, Rule, patterns

FINDING = (
    "struct<finding_ord:int,rule_ord:int,id:string,category:string,severity:string,"
    "verbatim_quote:string,entity_type:string,suggested_synthetic:string,"
    "risk_explanation:string,source:string>"
)
MIN_VALUE_LENGTH = 2


def _gates(rules: tuple[Rule, ...]):
    out = []
    for rule in rules:
        known = GATES.get(rule.label, ())
        stock = next((r for r in RULES if r.label == rule.label), None)
        out += list(known) if stock is rule else [None] * len(rule.patterns)
    return out


def _matches(text: str, pattern: Pattern, gate) -> str:
    """SQL for all values of one pattern; empty where its gate is shut."""
    linear, group = skipping_runs(pattern.regex, pattern.group)
    leads = (gate.lead, gate.then) if gate and linear == pattern.regex else ()
    regex = sql_text(java_regex(linear, *leads))
    found = f"regexp_extract_all({text}, {regex}, {group})"
    return found if gate is None else f"CASE WHEN {is_open(gate)} THEN {found} ELSE {sql_strings(())} END"


def with_matches(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``_hits``: the stripped values of all patterns in evaluation order.

    A value shorter than two characters after stripping is dropped.  The expressions
    are put together as SQL: a call per pattern and gate would cost seconds.
    """
    kept, gates, flat = df.columns, _gates(rules), patterns(rules)
    every = ", ".join(_matches(sql_name(text_col), p, g) for p, g in zip(flat, gates, strict=True))
    rule_of = f"array({', '.join(str(p.rule_ord) for p in flat)})"
    scanned = with_gates(df, text_col, gates).select(*kept, F.expr(f"array({every})").alias("_raw"))
    hits = (f"flatten(transform(_raw, (vals, i) -> transform(vals, v -> named_struct('rule_ord', get({rule_of}, i), "
            f"'quote', regexp_replace(v, {sql_text(STRIP_REGEX)}, '')))))")
    return scanned.select(
        *kept, F.expr(f"filter({hits}, h -> length(h.quote) >= {MIN_VALUE_LENGTH})").alias("_hits"))


def with_findings(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``findings``: one classified finding per distinct value of the text.

    The first pattern that yields a value decides its class; findings are numbered
    in that order.
    """
    kept = df.columns
    hits = with_matches(df, text_col, rules)
    # Equal values stand side by side once sorted, the first one in front: no search per value.
    by_value = hits.select(*kept, F.expr(
        "array_sort(transform(_hits, (h, i) -> named_struct('quote', h.quote, 'at', i, 'rule_ord', h.rule_ord)))").alias("_sorted"))
    firsts = by_value.select(*kept, F.expr(
        "array_sort(transform(filter(_sorted, (s, i) -> i = 0 OR get(_sorted, i - 1).quote <> s.quote), "
        "s -> named_struct('at', s.at, 'quote', s.quote, 'rule_ord', s.rule_ord)))").alias("_order"))
    ordered = firsts.select(*kept, F.expr(
        "transform(_order, (s, i) -> named_struct('n', i + 1, 'quote', s.quote, 'rule_ord', s.rule_ord))").alias("_firsts"))
    of_rule = {name: f"get({sql_strings([getattr(r, name) for r in rules])}, f.rule_ord - 1)"
               for name in ("label", "category", "severity", "prefix")}
    finding = ", ".join((
        "f.n", "f.rule_ord", "concat('p', f.n)", of_rule["category"], of_rule["severity"], "f.quote", of_rule["label"],
        f"concat('[', {of_rule['prefix']}, '_', f.n, ']')",
        f"concat('Matches standard structure for sensitive ', {of_rule['label']}, '.')", "'pattern_rule'",
    ))
    found = F.expr(f"cast(transform(_firsts, f -> struct({finding})) as array<{FINDING}>)")
    return ordered.select(*kept, computed_once(found).alias("findings"))


def findings(df: DataFrame, key: str = "doc_id", text_col: str = "text",
             rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """The findings table: one row per finding, with ``key`` and the ``keep`` columns."""
    found = with_findings(df.select(key, *keep, text_col), text_col, rules)
    return found.select(key, *keep, F.explode_outer("findings").alias("f")).where("f is not null").select(
        key, *keep, "f.finding_ord", "f.rule_ord", F.col("f.entity_type").alias("label"),
        "f.category", "f.severity", F.col("f.verbatim_quote").alias("quote"), "f.source",
    )
