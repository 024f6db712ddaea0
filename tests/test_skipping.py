"""Patterns that pass over text at once find what the catalogue's patterns find."""

import random

from pyspark.sql import functions as F

from auditflow.functions.dialect import SPACE, java_regex, skipping_runs
from auditflow.functions.text import sql_text
from auditflow.operators.detect import _gates, with_matches
from auditflow.rules import RULES, patterns
from tests.conftest import texts

CHANGED = ("Email Address", "UPI ID / VPA", "Phone Number", "Customer / Transactor / Person Name", "Financial Amount",
           "Indian Passport Number", "GSTIN / GST Number")
PIECES = ("a", "Z", "é", "_", ".", "-", "+", "%", "@", "@", " ", "  ", "\n", "ſ", "K", "ı", "𝐀", "|", "0", "91 ", "9826012345", "(555) 024-0360",
          "asha", "x@ok", "mail.x@post.example.org", " paid", " sent ", "Withdrew", " bor", " lent", "12", ".5", "k", " crore", "Rs. ", "₹", "$",
          "3,45,000", "usd 7", "İNR 5", "R12 34567", "29ABCDE1234F1Z5", ",", "/")


def _plain(p):
    """The pattern as it stands; its amounts are given back digit by digit."""
    return java_regex(p.regex).replace(rf"([0-9]++(?:\.[0-9]++)?+[{SPACE}]*+(?:k|", rf"([0-9]+(?:\.[0-9]+)?[{SPACE}]*(?:k|")


def _random_texts(n):
    rng = random.Random(7)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 24))) for _ in range(n)]


def test_changed_patterns_find_the_same(spark):
    """Each changed pattern against its plain form in Spark, on texts of their parts."""
    df = texts(spark, _random_texts(4000) + ["a" * 300 + "@ok", ".a" * 300 + "@ok x", "." * 300 + "a@b.example"]).repartition(8)
    labels = {i: r.label for i, r in enumerate(RULES, 1)}
    chosen = [(p, g) for p, g in zip(patterns(), _gates(RULES), strict=True) if labels[p.rule_ord] in CHANGED]
    differing = []
    for p, g in chosen:
        linear, group = skipping_runs(p.regex, p.group)
        fast = java_regex(linear, *((g.lead, g.then) if linear == p.regex else ()))
        found = f"filter(regexp_extract_all(text, {sql_text(fast)}, {group}), v -> length(v) >= 2)"
        plain = f"filter(regexp_extract_all(text, {sql_text(_plain(p))}, {p.group}), v -> length(v) >= 2)"
        differing.append(F.sum(F.expr(f"{found} <> {plain}").cast("int")).alias(f"p{p.pattern_ord}"))
    row = df.agg(*differing, F.sum(F.expr("length(text)"))).first().asDict()
    assert {k: v for k, v in row.items() if k.startswith("p") and v} == {}


def test_runs_without_a_value_are_not_values(spark):
    """A text of many words gave the e-mail rule an empty value for each of them."""
    mail = next(r for r in RULES if r.label == "Email Address").patterns[0]
    regex, group = skipping_runs(mail, 0)
    n = texts(spark, ["word " * 1000 + "x@y.example"]).select(
        F.expr(f"size(regexp_extract_all(text, {sql_text(java_regex(regex))}, {group}))")).first()[0]
    assert n <= 3


def test_long_runs_stay_linear(spark):
    long = ["a" * 1_000_000 + "@", "." * 1_000_000 + "@", "a." * 500_000 + "@1", "a" + " " * 1_000_000 + "b", "ab " * 300_000]
    rules = tuple(r for r in RULES if r.label in ("Email Address", "UPI ID / VPA", "Customer / Transactor / Person Name"))
    rows = with_matches(texts(spark, long), rules=rules).select(F.size("_hits")).collect()
    assert [r[0] for r in rows] == [0] * len(long)
