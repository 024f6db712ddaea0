"""Many values in one text: located by an index of its windows, restored in one pass."""

import random
import time

import brute
import pytest
from conftest import texts
from pyspark.sql import functions as F

from auditflow.functions import index
from auditflow.operators import auditlog, merge, restore
from auditflow.operators.score import audit


def all_places(text, value):
    return [i for i in range(len(text)) if text.startswith(value, i)]


def test_places_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(index, "SEGMENT", 512)
    monkeypatch.setattr(index, "_PART", 128)
    monkeypatch.setattr(index, "_BLOCK", 32)
    rnd = random.Random(4)
    cases = ["", "a", "aaaaaaa", "𐀀b𐀀b\U0010ffff" * 200] + ["".join(rnd.choices("ab𐀀é\n", k=rnd.randint(1, 1600))) for _ in range(12)]
    rows = [(k, t, v) for k, t in enumerate(cases) for v in {"a", "ab", "ba𐀀", "aaa", "b" * 40, t[3:9] or "x", t[-5:] or "y", t[:40] or "z"}]
    df = spark.createDataFrame(rows, "k int, t string, v string")
    expr = index.bind(index.windows("t"), "idx", index.places("idx", "v"))
    for r in df.select("t", "v", F.expr(expr).alias("at")).collect():
        assert r.at == all_places(r.t, r.v), (r.t, r.v)


def dense(n, seed):
    """A text with ``n`` addresses, some inside others, some that overlap themselves, some repeated."""
    rnd = random.Random(seed)
    users = [f"{rnd.choice('abx')}{rnd.randint(0, n)}" for _ in range(n)]
    return " ".join(f"{rnd.choice(['', 'q'])}{u}@m.org{rnd.choice(['', '', u + '@m.org'])}," for u in users) + " 11@11.orgorg 11@11.org"


@pytest.mark.parametrize("indexed", [0, 20, 10**6])
def test_spans_equal_brute_force(spark, monkeypatch, indexed):
    monkeypatch.setattr(merge, "INDEXED", indexed)
    cases = [dense(n, n) for n in (0, 3, 30, 120)] + ["plain", "", "call 9812345678, 9812345678 or 198123456789812345678"]
    got = audit(texts(spark, cases)).orderBy("doc_id").collect()
    assert [r.sanitized_text for r in got] == [brute.sanitized(t) for t in cases]


def test_quotes_that_overlap_themselves_and_long_ones(spark, monkeypatch):
    text = "abababa aaaaa " + "z" * 90 + " abab"
    quotes = ["aba", "aa", "z" * 45, "bab", "nothing"]
    semantic = spark.createDataFrame([(0, k, "C", "HIGH", q, "T", "[T_1]", "") for k, q in enumerate(quotes)],
        "doc_id long, ord int, category string, severity string, verbatim_quote string, entity_type string, suggested_synthetic string, risk_explanation string")
    for indexed in (0, 100):
        monkeypatch.setattr(merge, "INDEXED", indexed)
        spans = audit(texts(spark, [text]), semantic).first().spans
        assert [(s.start, s.original) for s in spans] == [(s, quotes[i]) for s, i in brute.spans(text, quotes[:4])]


def seconds(spark, n, of):
    df = texts(spark, ["".join(f"u{k}@mail{k}.example.org, " for k in range(n))]).cache()
    df.count()
    start = time.perf_counter()
    assert of(audit(df)).first()[0]
    return time.perf_counter() - start


@pytest.mark.parametrize("what", ["audit", "log", "restore"])
def test_many_values_cost_linear_time(spark, what):
    of = {
        "audit": lambda a: a.select(F.size("spans")),
        "log": lambda a: auditlog.log_entries(a.withColumns({"ts": F.current_timestamp(), "source": F.lit("x")}), True).select(F.size("vault")),
        "restore": lambda a: restore.roundtrip(a).select("exact"),
    }[what]
    seconds(spark, 1000, of)
    small, large = (min(seconds(spark, n, of) for _ in range(2)) for n in (8000, 16000))
    assert large < 2.5 * small + 0.5


def test_one_pass_equals_one_token_after_the_other(spark, monkeypatch):
    rnd = random.Random(8)
    rows = []
    for k in range(60):
        tokens = [f"[{rnd.choice(['A', 'B', 'AB'])}_{n}]" for n in range(rnd.randint(0, 12))]
        values = [rnd.choice(["x", "", "value", "a[b", "]", "[A_1]", "é𐀀"] if k % 3 == 0 else ["x", "", "value", "$1", "\\\\"]) for _ in tokens]
        text = "".join(rnd.choice([*tokens, "[A_99]", "[", "]", "[]", " word ", "[[A_1]]", "\n"]) for _ in range(rnd.randint(0, 40)))
        entries = [(t, v, n) for n, (t, v) in enumerate(zip(tokens, values, strict=True))] + [(t, "later", 99) for t in tokens[:1] if k % 4 == 1]
        rows.append((k, text, entries))
    df = spark.createDataFrame(rows, "k int, t string, e array<struct<token:string,original:string,start:int>>")
    for few in (-1, 100):
        monkeypatch.setattr(restore, "FEW", few)
        got = {r.k: r.out for r in df.select("k", restore.restored("t", "e").alias("out")).collect()}
        for k, text, entries in rows:
            for token, value, _ in sorted(entries, key=lambda e: (-len(e[0]), e[2], e[0], e[1])):
                text = text.replace(token, value)
            assert got[k] == text, rows[k]
