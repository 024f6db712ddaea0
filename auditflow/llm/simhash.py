"""SimHash fingerprints and near-duplicate components by a binary trie self-join.

A fingerprint holds the majority bits of the XXH64 hashes of a text's word shingles.
Distinct fingerprints that differ in at most ``budget`` bits are linked.  Cut into
``budget + 1`` blocks, two linked fingerprints agree in one block at least; so each
fingerprint is turned that many times, each time with another block in front, and stands in
the subtrie below that block.  Inside a subtrie node pairs are traversed together from
bit to bit: a pair that parts at a bit has one differing bit more, and is dropped as soon
as it has more than the budget.  Each subtrie returns a spanning forest of its links, and
alternating stars over all forests give the components.

A subtrie with more than ``split_rows`` fingerprints is dealt to several tasks: its
fingerprints fall into slots, and each pair of slots is joined by a task of its own.

Defined cases: null, empty or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle; copies share a fingerprint and enter the
join once; the smallest doc_id names a component, null ids count last; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditflow.functions import lineage
from auditflow.llm import text as T

SHINGLE = 3
BUDGET = 2
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(column: pa.Array, size: int = SHINGLE, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of all texts, and for each row the place of its first."""
    data, offsets = T.utf8(column)
    data, starts, ends, first = T.joined(T.LOWER[data], offsets)
    n = np.diff(first)
    per_row = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    place = np.zeros(len(per_row) + 1, np.int64)
    np.cumsum(per_row, out=place[1:])
    row = np.repeat(np.arange(len(n)), per_row)
    left = first[row] + np.arange(len(row)) - place[row]
    right = np.minimum(left + size, first[row + 1]) - 1
    raw, digest = memoryview(data.tobytes()), xxhash.xxh64_intdigest
    out = np.fromiter((digest(raw[a:b], seed) for a, b in zip(starts[left].tolist(), ends[right].tolist(), strict=True)), np.uint64, len(row))
    return out, place


def fingerprints(column: pa.Array, size: int = SHINGLE) -> np.ndarray:
    hashes, place = shingle_hashes(column, size)
    rows = len(place) - 1
    out = np.zeros(rows, np.uint64)
    if not len(hashes):
        return out
    row = T.row_of(place) * 256
    n = np.diff(place)
    for k in range(8):
        byte = ((hashes >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
        ones = np.bincount(row + byte, minlength=rows * 256).reshape(rows, 256) @ _BITS
        for bit in range(8):
            out |= (2 * ones[:, bit] > n).astype(np.uint64) << np.uint64(8 * k + bit)
    return out


def fingerprinted(docs: DataFrame, size: int = SHINGLE, digests: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every whole text; with ``digests`` also the text's digest."""
    own = ["doc_id", "digest"] if digests else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            fp = fingerprints(batch.column("text"), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(fp)], [*own, "fp"])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}{', digest string' if digests else ''}"
    rows = docs.select("doc_id", "text", *([_digest().alias("digest")] if digests else []))
    return rows.mapInArrow(run, f"{kinds}, fp long")


def _digest():
    return F.sha2(F.col("text").cast("binary"), 256)


def blocks(budget: int) -> list[tuple[int, int]]:
    """Start bit (from the top) and width of each block."""
    edge = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by)) if by else x


def trie_pairs(v: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs at most ``budget`` bits apart inside each of the sorted ranges ``low:high``.

    The values of a range are distinct and agree in their first ``depth`` bits.  A node is a
    range; a pair of nodes goes down one bit at a time.
    """
    a0, a1, b0, b1 = low, high, low, high
    d = np.zeros(len(low), np.int8)
    found_a, found_b = [], []
    for bit in range(63 - depth, -1, -1):
        ones = np.zeros(len(v) + 1, np.int64)
        np.cumsum((v >> np.uint64(bit)) & np.uint64(1), out=ones[1:])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        parts = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), (am[~same], a1[~same], b0[~same], bm[~same], d[~same] + 1)]
        a0, a1, b0, b1, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (a1 > a0) & (b1 > b0) & (d <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        leaf = live & (a1 - a0 == 1) & (b1 - b0 == 1)
        p, q = a0[leaf], b0[leaf]
        near = np.bitwise_count(v[p] ^ v[q]) <= budget
        found_a.append(p[near]), found_b.append(q[near])
        go = live & ~leaf
        a0, a1, b0, b1, d = a0[go], a1[go], b0[go], b1[go], d[go]
        if not len(a0):
            break
    return np.concatenate([*found_a, np.zeros(0, np.int64)]), np.concatenate([*found_b, np.zeros(0, np.int64)])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest place that links lead to."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _subtries(batches: Iterator[pa.RecordBatch], budget: int, together: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (turn, head, i, j) and turned value: the spanning forest of each group."""
    cut, held, count = blocks(budget), [], 0
    names = ["turn", "head", "i", "j", "v"]

    def forest(columns: list[np.ndarray]) -> pa.RecordBatch:
        turn, head, i, j, v = columns
        v = v.view(np.uint64)
        new = np.ones(len(v), bool)
        new[1:] = (turn[1:] != turn[:-1]) | (head[1:] != head[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        low = np.flatnonzero(new)
        high = np.append(low[1:], len(v))
        links = []
        for k, (_, width) in enumerate(cut):
            mine = (turn[low] == k) & (high - low > 1)
            links.append(trie_pairs(v, low[mine], high[mine], width, budget))
        root = roots(len(v), np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links]))
        own = np.flatnonzero(root != np.arange(len(v)))
        a, b = v[own], v[root[own]]
        for k, (start, _) in enumerate(cut):  # turn the values back
            rows = turn[own] == k
            a[rows], b[rows] = _turned(a[rows], 64 - start), _turned(b[rows], 64 - start)
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    for batch in batches:
        held.append([batch.column(n).to_numpy() for n in names])
        count += batch.num_rows
        if count < together:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        key = columns[:4]
        last = np.ones(count, bool)  # rows of the last group stay for the next batch
        for c in key:
            last &= c == c[-1]
        split = int(np.argmax(last))
        if split:
            yield forest([c[:split] for c in columns])
        held, count = [[c[split:] for c in columns]], count - split
    if count:
        yield forest([np.concatenate(c) for c in zip(*held, strict=True)])


def links(fps: DataFrame, budget: int = BUDGET, split_rows: int = 2000, together: int = 1 << 16) -> DataFrame:
    """a > b for pairs of ``fps.fp`` (distinct) that span every component of the links in each subtrie."""
    turned = [
        F.struct(F.lit(k).alias("turn"), F.shiftrightunsigned(v, 64 - width).alias("head"), v.alias("v"))
        for k, (start, width) in enumerate(blocks(budget))
        for v in [F.shiftleft("fp", start).bitwiseOR(F.shiftrightunsigned("fp", 64 - start)) if start else F.col("fp")]
    ]
    rows = fps.select(F.inline(F.array(*turned)))
    sizes = rows.groupBy("turn", "head").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("turn").alias("t"), F.col("head").alias("h"), F.ceil(F.col("n") / split_rows).cast("int").alias("slots"))
    rows = rows.join(sizes, (F.col("turn") == F.col("t")) & (F.col("head") == F.col("h")))  # a subtrie of one has no pair
    own = F.pmod(F.xxhash64("v"), F.col("slots")).cast("int")
    rows = rows.select("turn", "head", "v", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("other"))
    rows = rows.select("turn", "head", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "v")
    # Turned values are sorted as unsigned numbers.
    rows = rows.repartition("turn", "head", "i", "j").sortWithinPartitions("turn", "head", "i", "j", F.col("v").bitwiseXOR(F.lit(-(1 << 63))))
    return rows.mapInArrow(lambda batches: _subtries(batches, budget, together), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that is not the smallest of its component, and the smallest.

    Alternating large and small stars; each round is written to the checkpoint folder.  A
    node's smallest neighbour comes from a grouped minimum, so no task holds a hot node.
    """
    edges = lineage.cut(edges.distinct())
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a > b").distinct()
        small = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        joined = down.join(small, F.col("a") == F.col("n"))
        star = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.where("b = m").select("a", F.col("m").alias("b")))
        edges = lineage.cut(star.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            return edges
        state = now


def _rooted(fps: DataFrame, budget: int, split_rows: int) -> DataFrame:
    """``fps`` (distinct fp, least) with root, the smallest fingerprint of the component."""
    parents = components(links(fps.select("fp"), budget, split_rows))
    return lineage.cut(fps.join(parents, F.col("fp") == F.col("a"), "left").select("fp", F.coalesce("b", "fp").alias("root"), "least"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET, size: int = SHINGLE, split_rows: int = 2000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = lineage.cut(fingerprinted(docs, size))
    named = _rooted(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), budget, split_rows)
    tops = named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("top"), "component_id")
    by_fp = named.join(tops, F.col("root") == F.col("top")).select(F.col("fp").alias("print"), "component_id")
    return prints.join(by_fp, F.col("fp") == F.col("print")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, budget: int = BUDGET, size: int = SHINGLE, split_rows: int = 2000) -> DataFrame:
    """One whole row of each component, with the columns of ``docs``: the smallest by doc_id, null ids last, then by the text's digest.

    Rows are told apart by doc_id and digest, so rows that share an id, or have none, stand for
    their own components; of rows equal in both one stays.
    """
    rows = lineage.cut(fingerprinted(docs, size, digests=True)).groupBy("fp", "doc_id", "digest").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n"))
    fps = lineage.cut(rows.groupBy("fp").agg(least.alias("least")))
    stay = _rooted(fps, budget, split_rows).groupBy("root").agg(F.min("least").alias("least"))
    stay = stay.select(F.col("least.doc_id").alias("__id"), F.col("least.digest").alias("__digest"), F.col("least.n").alias("__rows"))
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & _digest().eqNullSafe(F.col("__digest")))
    once = kept.where("__rows = 1").select(docs.columns)
    return once.union(kept.where("__rows > 1").dropDuplicates(["__id", "__digest"]).select(docs.columns))


def survivors(docs: DataFrame, budget: int = BUDGET, size: int = SHINGLE) -> DataFrame:
    """``representatives``, for tables in which a doc_id names one document: of those that share an id one stays."""
    kept = representatives(docs, budget, size)
    return kept.where("doc_id IS NULL").union(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
