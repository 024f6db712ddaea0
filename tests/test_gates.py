"""A gate must be open wherever its pattern matches."""

import re

import pytest
from conftest import texts
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditflow.operators.detect import _gates, with_findings
from auditflow.operators.gates import PREFIX, is_open, with_gates
from auditflow.rules import RULES, patterns
import brute

PATTERNS, GATES = patterns(), _gates(RULES)


def test_every_pattern_has_a_gate():
    assert len(GATES) == len(PATTERNS) == 49 and all(g is not None for g in GATES)
    assert all(len(w) <= PREFIX and w.islower() for g in GATES for w in g.words)


# Python and the JVM know different Unicode versions; older characters are in both.
ALPHABET = st.characters(max_codepoint=0x86F)


@pytest.fixture(scope="module")
def samples():
    """Strings generated from each pattern, some with letters next to the match."""
    out = {}
    for p in PATTERNS:
        found = []

        @settings(max_examples=60, database=None, deadline=None, derandomize=True,
                  suppress_health_check=list(HealthCheck))
        @given(st.from_regex(p.regex, alphabet=ALPHABET), st.sampled_from(["", " ", "é", "x ", " "]))
        def collect(s, around):
            found.append(around + s + around)

        collect()
        out[p.pattern_ord] = [s for s in found if re.search(p.regex, s)]
        assert len(out[p.pattern_ord]) >= 10, p
    return out


def test_gates_are_implied(spark, samples):
    rows = [(i, s) for i, found in samples.items() for s in found]
    df = spark.createDataFrame(rows, "p int, text string").repartition(8)
    gated = with_gates(df, "text", GATES).select(
        "p", "text", F.array(*[F.expr(f"coalesce({is_open(g)}, false)") for g in GATES]).alias("open"))
    closed = [(PATTERNS[r.p].regex, r.text) for r in gated.collect() if not r.open[r.p]]
    assert not closed, closed[:3]


def test_generated_texts_against_brute(spark, samples):
    cases = [s for found in samples.values() for s in found]
    df = texts(spark, cases).repartition(8)
    for row in with_findings(df).collect():
        got = [(f.entity_type, f.verbatim_quote) for f in row.findings]
        assert got == [(r.label, v) for r, v in brute.values(row.text)], row.text
