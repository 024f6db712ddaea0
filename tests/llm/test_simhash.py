import random
import re

import numpy as np
import pytest
import xxhash
from cases import TEXTS, by_id, docs

import corpus_pipeline
from auditflow.llm import simhash

SMALL = {c: c + 32 for c in range(65, 91)}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(prints, budget):
    """The smallest key reachable from each key."""
    keys, seen = sorted(prints), {}
    for k in keys:
        if k in seen:
            continue
        todo, seen[k] = [k], k
        while todo:
            a = todo.pop()
            for b in keys:
                if b not in seen and (prints[a] ^ prints[b]).bit_count() <= budget:
                    seen[b] = k
                    todo.append(b)
    return seen


def check(spark, texts, **options):
    found = by_id(simhash.near_duplicates(docs(spark, texts), **options), "fingerprint", "component_id")
    prints = {k: fingerprint(t) for k, t in enumerate(texts)}
    roots = closed(prints, options.get("budget", 2))
    assert found == {k: (f"{prints[k]:016x}", roots[k]) for k in prints}


def test_cases(spark):
    check(spark, TEXTS)


def near_copies(n, seed):
    random.seed(seed)
    words = [f"w{k}" for k in range(400)]
    base = random.choices(words, k=300)
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(random.randint(0, 3)):
            copy[random.randrange(300)] = random.choice(words)
        out.append(" ".join(copy) if k % 5 else " ".join(random.choices(words, k=20)))
    return out


def test_near_copies_in_split_subtries(spark):
    check(spark, near_copies(250, 1), split_rows=8)


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_other_budgets(spark, budget):
    check(spark, near_copies(80, 2) + TEXTS, budget=budget)


def test_trie_finds_all_pairs():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    noise = [np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, 3))) for _ in range(300)]
    v = np.unique(np.array([centre[k % 12] ^ x for k, x in enumerate(noise)]))
    a, b = simhash.trie_pairs(v, np.array([0]), np.array([len(v)]), 0, 4)
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 4}
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)} == want


def test_long_chain_is_one_component(spark):
    fps = [(1 << k) - 1 for k in range(0, 64, 2)]
    edges = simhash.links(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long"))
    found = simhash.components(edges).collect()
    assert len(found) == len(fps) - 1 and len({r["b"] for r in found}) == 1


def test_survivors(spark):
    texts = ["same text of several words here", "same text of several words here", "another one, wholly different from it", None, ""]
    table = docs(spark, texts, [5, 2, 2, None, 9])
    kept = simhash.survivors(table)
    assert kept.columns == table.columns
    # The second and third rows share an id: one row stays for it; of the empty ones the row that has an id.
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 9]
    alone = simhash.survivors(docs(spark, [None, ""], [None, None]))
    assert alone.count() == 1
    assert simhash.survivors(docs(spark, [])).count() == 0 and simhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_row_of_each_component_whatever_the_ids(spark):
    one, two, three = "same text of several words here", "another one, wholly different from it", "a third that nobody else has written down"
    cases = [
        ([one, two, three, one], [None] * 4, {one, two, three}),
        ([one, one, two], [None, None, 4], {one, two}),
        ([one, two, two, three], [2, 2, 2, 5], {one, two, three}),
        ([one, two, one, None, ""], [2, 3, 3, None, None], None),
        ([one, one, one], [None, None, None], {one}),
    ]
    for texts, ids, want in cases:
        table = docs(spark, texts, ids)
        for stage in (simhash.representatives, lambda t: corpus_pipeline.drop_near_duplicates(spark, t, "")):
            kept = stage(table)
            assert kept.columns == table.columns
            got = [(r["doc_id"], r["text"]) for r in kept.collect()]
            if want is None:
                assert sorted(got, key=str) in ([(2, one), (3, two), (None, "")], [(2, one), (3, two), (None, None)])
            else:
                assert sorted(t for _, t in got) == sorted(want)
