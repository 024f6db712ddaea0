"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

An entry c becomes the whole number x = floor(1024 c) + 100000.  With X the centred rows,
one step takes u = Xv - beta u', then v = X'u - alpha v', each made orthogonal to all earlier
vectors of its side; the coefficients are a bidiagonal matrix.  Its small singular value
decomposition gives the components and the deviations along them.

The rows stay where they are.  They are written once as blocks of whole numbers, and a step is
one pass: each task multiplies its blocks by the vector, and what it got by the blocks
again, so d + 1 sums come back, of d dimensions.  A u is as long as the table and
is never stored: u = Xw for a short w that the recurrence knows, and the products with earlier u's
are those of their w's with X'u.  Where these show that u had lost its orthogonality, the step
is done again on the mended w.  The driver holds 3 d vectors of length d.

The steps end when what is missing of each wanted component is below rounding, after d
steps at the latest.  An exact end before that (equal eigenvalues, a smaller rank) goes on with a
new direction, so that no component is missed.

Defined cases: a null vector, and one with a null, infinite or not-a-number entry, is dropped; so
are vectors without entries, and those whose length is not that of the most vectors (of
equally many, the greater).  Entries beyond 2^62 / 1024 count as that.  Rows may repeat, and vec_id may repeat or be null.
Components along which nothing varies (below 1e-12 of all variance) are left out, so equal
vectors, a single one, and an empty table give no rows.  A deviation beyond a long is null.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditflow.functions import lineage

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
BLOCK_BYTES = 2 << 20
_FAR = float(1 << 62)
_NOTHING = 1e-12


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column; lengths and ends of all; all entries, floor(1024 c)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)
    entries = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    good = np.flatnonzero((lengths > 0) & (bad[ends] == bad[ends - lengths]))
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.clip(np.floor(entries * SCALE), -_FAR, _FAR)
    return good, lengths, ends, scaled


def blocks(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """d, n, ids and x (d times n whole numbers of 4 or 8 bytes) of up to BLOCK_BYTES of vectors a row, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, lengths, ends, scaled = whole(batch.column(1))
            for d in np.unique(lengths[good]):
                mine = good[lengths[good] == d]
                each = max(1, BLOCK_BYTES // (8 * int(d)))
                for k in range(0, len(mine), each):
                    part = mine[k : k + each]
                    x = scaled[(ends[part] - d)[:, None] + np.arange(d)].astype(np.int64) + SHIFT
                    small = len(x) == 0 or np.abs(x).max() < 1 << 31
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([batch.column(0).take(pa.array(part)).to_pylist()], pa.list_(pa.int64())),
                         pa.array([x.astype("<i4" if small else "<i8").tobytes()], pa.binary())], ["d", "n", "ids", "x"])

    rows = vectors.select(F.col("vec_id").cast("long"), column)
    return lineage.written(rows.mapInArrow(run, "d long, n long, ids array<long>, x binary"))


class Centre(NamedTuple):
    """What centring needs: the number of vectors, their exact sums, the nearest whole means, and the rest of the means."""

    d: int
    n: int
    sums: list[int]
    near: np.ndarray
    rest: np.ndarray


def _matrix(n: int, d: int, x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<i4" if len(x) == 4 * n * d else "<i8").reshape(n, d)


def _summed(rows: DataFrame, length: int, add, kind: str = "double") -> list:
    """For each place the sum over all blocks of what ``add(x)`` returns; tasks add up their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, d, x in zip(*(batch.column(c).to_pylist() for c in ("n", "d", "x")), strict=True):
                part = add(_matrix(n, d, x))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(list(total), pa.int64() if kind == "long" else pa.float64())], ["k", "v"])

    found = rows.select("n", "d", "x").mapInArrow(run, f"k int, v {kind}").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")).alias("v"))
    out = [0] * length
    for r in found.collect():  # one row for each place
        out[r["k"]] = int(r["v"]) if kind == "long" else r["v"]
    return out


def centre(rows: DataFrame) -> Centre | None:
    """The fit list's length, sums and means, exactly; None if it is empty."""
    most = rows.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if most is None:
        return None
    d, n = most["d"], most["n"]

    def halves(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])

    parts = _summed(rows.where(F.col("d") == d), 2 * d, halves, "long")
    sums = [(h << 32) + low for h, low in zip(parts[:d], parts[d:], strict=True)]
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([float(Fraction(s - m * n, n)) for s, m in zip(sums, near, strict=True)])
    return Centre(d, n, sums, np.array(near, np.int64), rest)


def _centred(x: np.ndarray, c: Centre) -> np.ndarray:
    return (x - c.near).astype(np.float64) - c.rest


def _apart(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``basis``, taken out twice."""
    if basis:
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    return v


class Decomposition(NamedTuple):
    components: np.ndarray  # a row each
    eigenvalues: np.ndarray
    trace: float
    steps: int


def decompose(rows: DataFrame, c: Centre, wanted: int = COMPONENTS, seed: int = 11) -> Decomposition:
    """The components of the largest eigenvalues of the covariance of ``rows`` (blocks of dimension ``c.d``)."""
    d, draw = c.d, np.random.default_rng(seed)

    def pass_over(w: np.ndarray) -> tuple[np.ndarray, float]:
        """X'Xw and |Xw|^2."""
        def add(x: np.ndarray) -> np.ndarray:
            z = _centred(x, c)
            u = z @ w
            return np.concatenate([u @ z, [u @ u]])

        found = np.array(_summed(rows, d + 1, add))
        return found[:d], float(found[d])

    total = _summed(rows, 1, lambda x: np.array([np.square(_centred(x, c)).sum()]))[0]
    if not total > 0:
        return Decomposition(np.zeros((0, d)), np.zeros(0), 0.0, 0)
    tiny = 1e-14 * np.sqrt(total)

    def fresh(basis: list[np.ndarray]) -> np.ndarray:
        while True:
            v = _apart(draw.standard_normal(d), basis)
            if (size := np.linalg.norm(v)) > 1e-6:
                return v / size

    vs, ws, zs = [fresh([])], [], []  # v, w with u = Xw, and X'u
    alphas, betas = [], []
    while True:
        w = vs[-1] - (betas[-1] * ws[-1] if betas else 0)
        for _ in range(3):
            z, square = pass_over(w)
            along = np.array(ws) @ z if ws else np.zeros(0)  # products with the earlier u's
            if ws:
                w, z = w - np.array(ws).T @ along, z - np.array(zs).T @ along
            left = max(square - float(along @ along), 0.0)
            if float(along @ along) <= 1e-20 * square or left <= tiny**2:
                break
        alpha = np.sqrt(left)
        if alpha <= tiny:  # nothing new on this side
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, z = w / alpha, z / alpha
        alphas.append(alpha), ws.append(w), zs.append(z)
        v = _apart(z - alpha * vs[-1], vs)
        beta = float(np.linalg.norm(v))
        k = len(alphas)
        small = np.diag(alphas) + np.diag(betas, 1)
        left_vectors, values, right = np.linalg.svd(small)
        missing = beta * np.abs(left_vectors[-1, : min(wanted, k)])
        ended = beta <= tiny
        if k == d or (k >= min(wanted, d) and not ended and (missing <= 1e-15 * values[0]).all()):
            break
        betas.append(0.0 if ended else beta)
        vs.append(fresh(vs) if ended else v / beta)
    eigenvalues = values**2 / c.n
    trace = total / c.n
    kept = np.flatnonzero(eigenvalues[:wanted] > _NOTHING * trace)
    components = right[kept] @ np.array(vs)
    return Decomposition(components / np.linalg.norm(components, axis=1, keepdims=True), eigenvalues[kept], trace, k)


def _deviations(x: np.ndarray, c: Centre) -> list[int | None]:
    """For each row the exact sum of (n x - S)^2."""
    off = [s - c.n * int(m) for s, m in zip(c.sums, c.near, strict=True)]
    far = float(np.abs(x.astype(np.float64) - c.near).max(initial=0)) * c.n + c.n
    if far * far * c.d < float(1 << 62):
        gap = c.n * (x - c.near) - np.array(off, np.int64)
        return np.square(gap).sum(axis=1).tolist()
    exact = (sum((c.n * (int(v) - int(m)) - o) ** 2 for v, m, o in zip(row, c.near, off, strict=True)) for row in x)
    return [e if e < 1 << 63 else None for e in exact]


def whiten(vectors: DataFrame, column: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    every = blocks(vectors, column)
    c = centre(every)
    if c is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = every.where(F.col("d") == c.d)
    held = rows.persist()
    found = decompose(held, c, wanted)
    m = len(found.eigenvalues)
    if not m:
        held.unpersist()
        return vectors.sparkSession.createDataFrame([], schema)
    turn = (found.components / np.sqrt(found.eigenvalues)[:, None]).T

    def add(x: np.ndarray) -> np.ndarray:
        white = _centred(x, c) @ turn
        return (white.T @ white).ravel()

    identity_error = float(np.abs(np.array(_summed(held, m * m, add)).reshape(m, m) / c.n - np.eye(m)).max())
    held.unpersist()
    explained = found.eigenvalues / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, d, ids, x in zip(*(batch.column(k).to_pylist() for k in ("n", "d", "ids", "x")), strict=True):
                x = _matrix(n, d, x).astype(np.int64)
                times = np.repeat(np.arange(n), m)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()).take(pa.array(times)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)), pa.array(np.full(n * m, c.n)),
                    pa.array(_deviations(x, c), pa.int64()).take(pa.array(times)), pa.array((_centred(x, c) @ turn).ravel()),
                    pa.array(np.tile(explained, n)), pa.array(np.full(n * m, identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
