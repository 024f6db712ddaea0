import hashlib
import random

import pytest
from cases import TEXTS, docs
from pyspark.sql import functions as F

from auditflow.llm import exact

SMALL = {c: c + 32 for c in range(65, 91)}


def by_hand(rows):
    """keep_id, group_size, digest of (doc_id, text) rows, one by one."""
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(SMALL), []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items()}


def check(spark, texts, ids=None, **options):
    ids = list(range(len(texts))) if ids is None else ids
    want = by_hand(zip(ids, texts, strict=True))
    digests = {(t or "").translate(SMALL): want[(t or "").translate(SMALL)][2] for t in texts}
    got = exact.duplicates(docs(spark, texts, ids), **options).collect()
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted((str(i), digests[(t or "").translate(SMALL)]) for i, t in zip(ids, texts, strict=True))
    of = {d: w for w in want.values() for d in [w[2]]}
    for r in got:
        assert (r.keep_id, r.group_size) == of[r.text_sha256][:2]
    for digest, (keep, _, _) in of.items():
        assert [r.doc_id for r in got if r.text_sha256 == digest and r.kept] == [keep]


def varied(n, seed=3):
    rnd = random.Random(seed)
    words = [f"{rnd.choice('bkvwyzstrm')}{rnd.choice('aeiou')}{rnd.choice('nrstkz')}" for _ in range(300)] + ["été", "ÀB", "字。", "б а"]
    base = " ".join(rnd.choices(words, k=3000))
    out = []
    for k in range(n):
        t = " ".join(rnd.choices(words, k=rnd.randint(0, 900))) + base[: rnd.choice([0, 0, 5000])]
        out += [t, t.upper() if t.isascii() else t, t + "x", "x" + t][: rnd.randint(1, 4)]
    return out


def test_cases(spark):
    check(spark, TEXTS + TEXTS)


def test_only_ascii_letters_fold(spark):
    check(spark, ["É", "é", "AbÉ", "aBÉ", "abé", "İ", "i", "K", "k"])


def test_ties_null_ids_and_repeated_rows(spark):
    check(spark, ["a", "A", "a", "b", "b", "b", None, "", "c"], [4, 4, 1, None, None, 2, None, None, None])


def test_empty_table(spark):
    assert exact.duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [4, 70, 128])
def test_clashing_identifiers_are_drawn_anew(spark, bits):
    check(spark, varied(40), bits=bits)


def test_chunks_hold_the_text_and_follow_its_content(spark):
    texts = [t.translate(SMALL) for t in varied(30)] + ["x" * 20000, "\n" * 9000, "𐀀" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact.chunks(F.col("t")).alias("c")).collect()
    for r in rows:
        assert "".join(r.c) == r.t
        assert all(exact.MIN_CHUNK <= len(c) <= exact.MAX_CHUNK for c in r.c[:-1])
    base = " ".join(varied(40, 9)).translate(SMALL)
    old, new = (r.c for r in spark.createDataFrame([(base,), ("something put in front, " + base,)], "t string").select(exact.chunks(F.col("t")).alias("c")).collect())
    assert len(set(old) & set(new)) > 0.95 * len(set(old))


def test_no_python_in_the_plan(spark):
    plan = exact.duplicates(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
