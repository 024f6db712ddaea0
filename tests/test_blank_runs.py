"""Runs of blanks behind a key word: same values, and linear time."""

import random
import re
import time

import pytest
from conftest import texts
from test_detect import compare_with_brute

from auditflow.functions.dialect import _single_blank_runs
from auditflow.operators.detect import findings
from auditflow.rules import RULES, patterns

KEYS = ("password", "pin", "aadhaar", "pan card", "passport no", "voter id", "driving licence", "rc no", "gst no", "tan", "din no", "uan", "abha id",
        "ration card", "fir no", "amount", "a/c", "transfer to", "payee", "name", "card", "phone")
VALUE = ("0123456789", "0123456789", "ab", "- ", "/", ",", ".", "x Y", "+", " " * 9)


def spaced(rng, n):
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(1, 3)):
            t += rng.choice(KEYS) + rng.choice(["", " ", " " * rng.randint(0, 60), "\n \t"])
            t += rng.choice(["", "is", "IS", ":", "=", "no", "no.", "number", "num", "card", "of"]) + rng.choice(["", " ", " " * rng.randint(0, 60)])
            t += rng.choice(["", ":", "="]) + rng.choice(["", " ", " " * rng.randint(0, 40)])
            t += "".join(rng.choice(rng.choice(VALUE)) for _ in range(rng.randint(0, 30))) + rng.choice(["", " ", "|", "\n", ", "])
        yield t


def test_same_matches_pattern_by_pattern():
    rng, changed = random.Random(11), 0
    cases = list(spaced(rng, 2500))
    for p in patterns():
        new = _single_blank_runs(p.regex)
        if new == p.regex:
            continue
        changed += 1
        old, new = re.compile(p.regex), re.compile(new)
        for t in cases:
            assert [(m.span(), m.span(p.group)) for m in old.finditer(t)] == [(m.span(), m.span(p.group)) for m in new.finditer(t)], (p.regex, t)
    assert changed == 21


def test_same_values_in_spark(spark):
    compare_with_brute(texts(spark, list(spaced(random.Random(5), 600))).repartition(8))


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.prefix + str(RULES.index(r)))
def test_long_runs(spark, rule):
    """Each key word with 100,000 blanks behind it, then with a sign and as many again."""
    run = " " * 100_000
    found = findings(texts(spark, [f"{k}{run}|" for k in KEYS] + [f"{k} :{run}|" for k in KEYS] + ["amount 5" + run + "x"]), rules=(rule,))
    start = time.perf_counter()
    found.count()
    # One second for each text, were they read one after the other.
    assert time.perf_counter() - start < 8
