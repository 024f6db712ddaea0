import random
import re
from collections import Counter

import numpy as np
import pytest

from auditflow.llm import divergence, transducer

SMALL = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, piece int, ordinal long, value long, p long, total long"


def table(spark, rows):
    return spark.createDataFrame([(k, *r, None, "t", None, None, None, None, None) for k, r in enumerate(rows)], SCHEMA)


def by_hand(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(SMALL))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted((t for t, n in df.items() if n >= min_docs), key=str.encode)
        counts = {}
        for _, source, terms in mine:
            c = counts.setdefault(source, Counter())
            c.update(t for t in terms if df[t] >= min_docs)
        every = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        q_all, p_of = shares(every), {s: shares(c) for s, c in counts.items()}
        for s, p in p_of.items():
            f = lambda q, t, p=p: (p[t] - q[t]) ** 2 // q[t]
            pairs = sorted(((-sum(f(q, t) for t in kept), o.encode(), o) for o, q in p_of.items() if o != s))
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((-f(q_all, t), t.encode(), t) for t in kept if counts[s][t] and p[t] > q_all[t])[:top]
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms, 1)}
    return out


def check(spark, rows, **options):
    got = [tuple(r) for r in divergence.audit(table(spark, rows), **options).select("lang", "source", "part", "item", "value", "rank").collect()]
    want = by_hand(rows, top=options.get("top", 200))
    assert len(got) == len(want) and set(got) == want


def made(n, seed=2, sources=5):
    rnd = random.Random(seed)
    pool = [f"{a}{b}{c}" for a in ("b", "st", "É", "字", "Ba") for b in ("a", "o", "ü") for c in ("", "n", "nd", "ré", "x" * 40)]
    return [(" ".join(rnd.choices(pool, k=rnd.randint(0, 60))) + rnd.choice(["", "1st!", "a_b"]), rnd.choice(["en", "de", None, "xx"]), rnd.choice([f"s{k}" for k in range(sources)] + [None, "é"])) for _ in range(n)]


def test_transducer_is_minimal_and_ordered():
    rnd = random.Random(1)
    terms = sorted({"".join(rnd.choices("abé字", k=rnd.randint(1, 9))).encode() for _ in range(3000)} | {b"a", b"ab", b"abc"})
    t = transducer.build(terms)
    words = terms + [b"zz", b"abz", b"a" * 70, b"\xff", terms[5] + b"a" * 40] + terms[:10]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    found = transducer.ordinals(t, np.full(len(words), t.start), data, starts, ends)
    places = {w: k for k, w in enumerate(terms)}
    assert found.tolist() == [places.get(w, -1) for w in words]
    # As many states as there are different sets of endings: none could be saved.
    endings = {}
    for w in terms:
        for k in range(len(w) + 1):
            endings.setdefault(w[:k], set()).add(w[k:])
    assert len(t.final) - 1 == len({frozenset(e) for e in endings.values()})


def test_empty_transducer_and_several():
    none, (one, two) = transducer.build([]), (transducer.build([b"a", b"c"]), transducer.build([b"b", b"ba"]))
    both, starts = transducer.together([none, one, two])
    data = np.frombuffer(b"acbba", np.uint8)
    at, to = np.array([0, 1, 2, 3]), np.array([1, 2, 3, 5])
    assert [transducer.ordinals(both, np.full(4, s), data, at, to).tolist() for s in starts] == [[-1] * 4, [0, 1, -1, -1], [-1, -1, 0, 1]]


def test_against_brute_force(spark):
    check(spark, made(120))


@pytest.mark.parametrize("options", [{"piece_terms": 7}, {"piece_terms": 7, "pass_bytes": 900}, {"top": 3}])
def test_pieces_and_passes_change_nothing(spark, options):
    check(spark, made(90, 5), **options)


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 30)
    check(spark, made(90, 6))


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "a"), ("one word", "en", "b"), ("123 !", "fr", "a"), ("x" * 70000, "fr", "b"), ("x" * 70000, "fr", "b"), ("X" * 70000 + " y", "fr", "c"),
            ("solo solo solo", "it", "only"), ("solo", "it", "only"), ("Solo", "it", "only"), ("solo", "it", "only")]
    check(spark, rows)


def test_empty_table(spark):
    assert divergence.audit(table(spark, [])).collect() == []
