"""Quality rules: counted base rules, and a calibrated n-gram regression as verdict.

The base rules count words, characters, symbols, repeated lines and words inside
repeated five-word windows.  The verdict of the method is a logistic regression over
hashed word and character n-grams, fitted on labelled rows, calibrated on a part of them
that the fit does not see, and compared with a fixed threshold.

Defined cases: null text has no words and fails the base rules; without labelled rows of
both kinds the regression abstains and the base rules decide; repeated rows give repeated
results; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditflow.llm import learn, ngrams
from auditflow.llm import text as T

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Below this calibrated probability a text goes.  Low, so that doubtful texts stay.
KEEP_FROM = 0.1
CHAR_DIMS = 2048
WORD_DIMS = 2048


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    shift: float
    slope: tuple[float, float]


def features(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shares of hashed byte trigrams (case and signs kept) and of hashed words and word pairs."""
    chars = ngrams.frequencies(ngrams.char_counts(data, offsets, CHAR_DIMS))
    grams = ngrams.word_counts(hashes, first, WORD_DIMS) + ngrams.word_counts(hashes, first, WORD_DIMS, 2)
    return np.hstack([np.sqrt(chars), np.sqrt(ngrams.frequencies(grams))])


def repeat_words(hashes: np.ndarray, first: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For each row the number of words inside windows that occur twice or more in the row."""
    places, grams = T.windows(hashes, first, size)
    if not len(places):
        return np.zeros(len(first) - 1, np.int64)
    row = T.row_of(first).astype(np.uint64)[places]
    keys = T.mixed(grams + row * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = places[order[twice]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return T.row_sums(np.cumsum(cover[:-1]) > 0, first)


def dup_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    twice = 0
    for line in lines:
        if line in seen:
            twice += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return twice


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1200) -> QualityModel | None:
    """Fit on about ``per_label`` labelled texts of each kind, chosen by a hash of the id.

    ``labels`` holds doc_id and quality.  Feature rows of a fixed width come to the driver.
    """
    chosen = learn.bounded_sample(labels.select("doc_id", F.col("quality").alias("y")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()), "y", "doc_id", per_label)
    ids = sorted({(r[0], r[1]) for r in chosen.collect()})
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(ids, "doc_id bigint, y int")), "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            data, offsets = T.utf8(batch.column("text"))
            starts, ends, first = T.words(data, offsets)
            x = features(data, offsets, T.word_hashes(data, starts, ends), first)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["y", "x"])

    found = sorted((r["y"], bytes(r["x"])) for r in rows.mapInArrow(featurise, "y int, x binary").collect())
    if len({y for y, _ in found}) < 2:
        return None
    x = np.stack([np.frombuffer(b, np.float16) for _, b in found]).astype(np.float32)
    y = np.array([r[0] for r in found], np.float32)
    held = np.arange(len(y)) % 4 == 0  # sorted by label and features: a quarter of each kind
    weight = np.where(y == 1, 0.5 / max((y[~held] == 1).sum(), 1), 0.5 / max((y[~held] == 0).sum(), 1))
    w = learn.logistic(x[~held], y[~held], weight=weight[~held])
    slope = learn.platt(x[held] @ w[:-1] + w[-1], y[held])
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]), slope)


def probability(model: QualityModel, x: np.ndarray) -> np.ndarray:
    return learn.sigmoid((x @ model.weights + model.shift).astype(np.float64) * model.slope[0] + model.slope[1])


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def _judged(column: pa.Array, model: QualityModel | None, keep_from: float) -> list[pa.Array]:
    """The columns of SCHEMA for a column of texts."""
    data, offsets = T.utf8(column)
    starts, ends, first = T.words(data, offsets)
    hashes = T.word_hashes(data, starts, ends)
    n = np.diff(first)
    points = ((data & 0xC0) != 0x80) & ~T.BLANK[data]
    repeats = repeat_words(hashes, first)
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    lines = [dup_lines(t) for t in column.to_pylist()]
    counts = [pa.array(n), pa.array(T.row_sums(points, offsets)), pa.array(T.row_sums(SYMBOLS[data], offsets)), pa.array(lines, pa.int64()), pa.array(repeats), pa.array(failed)]
    if model is None:
        return [*counts, pa.nulls(len(n), pa.float64()), pa.array(~failed)]
    sure = probability(model, features(data, offsets, hashes, first))
    return [*counts, pa.array(sure), pa.array(~failed & (sure >= keep_from))]


def judge(docs: DataFrame, model: QualityModel | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the counts, base_failed, the calibrated score (null without a model) and kept, for every whole text."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            found = _judged(batch.column("text"), model, keep_from)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, {SCHEMA}")


def good(docs: DataFrame, model: QualityModel | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            yield batch.filter(_judged(batch.column("text"), model, keep_from)[-1])

    return docs.mapInArrow(keep, docs.schema)
