"""Language identification: the family first, then one-versus-one machines inside it.

Texts become shares of hashed byte trigrams (lower case, everything that is not a letter
is a space).  Languages whose mean profiles lie close together form a family; a linear
support vector machine per family picks one, and inside it every pair of languages has a
machine of its own that votes.  Families are learned from the data, or given.

Defined cases: null or letterless text is ``und`` with score 0; ties go to the family or
language that is first in sorted order; with no labelled row every text is ``und``; an
empty table gives an empty result; repeated rows give repeated results; further columns
are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditflow.llm import learn, ngrams
from auditflow.llm import text as T

UND = "und"
#: A filter rejects ``und`` and what scores below this: for so few letters any language is a guess.
MIN_SCORE = 0.3
DIMS = 4096
_LETTER = re.compile(r"[^\W\d_]")
_LATIN_WORD = np.zeros(256, bool)
_LATIN_WORD[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@dataclass(frozen=True)
class LanguageModel:
    """Languages by family, and the weights of all machines: one column each, then the calibration."""

    families: tuple[tuple[str, ...], ...]
    weights: np.ndarray  # (DIMS, machines)
    shift: np.ndarray  # (machines,)
    slope: np.ndarray  # (machines, 2): calibration
    pairs: tuple[tuple[str, str], ...]


def features(column: pa.Array) -> np.ndarray:
    data, offsets = T.utf8(column)
    return ngrams.frequencies(ngrams.char_counts(ngrams.lower_latin(data), offsets, DIMS))


def _family_groups(profiles: dict[str, np.ndarray]) -> tuple[tuple[str, ...], ...]:
    """Average-linkage groups of languages that are nearer to one another than the mean pair."""
    names = sorted(profiles)
    if len(names) < 3:
        return tuple((n,) for n in names)
    centre = np.mean([profiles[n] for n in names], axis=0)
    unit = {n: (profiles[n] - centre) / max(np.linalg.norm(profiles[n] - centre), 1e-12) for n in names}
    near = {frozenset(p): float(unit[p[0]] @ unit[p[1]]) for p in combinations(names, 2)}
    limit = float(np.mean(list(near.values())))
    groups = [(n,) for n in names]
    while len(groups) > 2:
        def closeness(pair):
            return np.mean([near[frozenset((a, b))] for a in pair[0] for b in pair[1]])

        best = max(combinations(groups, 2), key=closeness)
        if closeness(best) <= limit:
            break
        groups = [g for g in groups if g not in best] + [tuple(sorted(best[0] + best[1]))]
    return tuple(sorted(groups))


def _machine(x: np.ndarray, y: np.ndarray, scale: np.ndarray):
    w = learn.svm(x * scale, y)
    a, b = learn.platt((x * scale) @ w[:-1] + w[-1], y)
    return w[:-1] * scale, w[-1], (a, b)


def fit(x: np.ndarray, lang: list[str], families: list[list[str]] | None = None) -> LanguageModel:
    """A model from feature rows and their languages; ``families`` overrides the learned grouping."""
    labels = np.array(lang, dtype=object)
    names = sorted(set(lang))
    profile = {n: np.sqrt(x[labels == n].mean(axis=0)) for n in names}
    groups = tuple(tuple(sorted(g)) for g in families) if families else _family_groups(profile)
    scale = (1.0 / np.sqrt(x.mean(axis=0) + 1e-5)).astype(np.float32) if len(x) else np.ones(DIMS, np.float32)
    weights, shift, slope, pairs = [], [], [], []

    def add(rows, y):
        w, b, s = _machine(x[rows], y, scale)
        weights.append(w), shift.append(b), slope.append(s)

    if len(groups) > 1:
        for group in groups:
            add(np.arange(len(x)), np.where(np.isin(labels, group), 1.0, -1.0))
    for group in groups:
        for a, b in combinations(group, 2):
            rows = np.flatnonzero((labels == a) | (labels == b))
            add(rows, np.where(labels[rows] == a, 1.0, -1.0))
            pairs.append((a, b))
    k = len(weights)
    return LanguageModel(groups, np.array(weights, np.float32).reshape(k, DIMS).T.copy(), np.array(shift, np.float32), np.array(slope, np.float64).reshape(k, 2), tuple(pairs))


def predict(model: LanguageModel, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each feature row."""
    n = len(x)
    if not model.families:
        return np.full(n, UND, object), np.zeros(n)
    sure = learn.sigmoid(np.stack([(x @ model.weights[:, k] + model.shift[k]) * a + b for k, (a, b) in enumerate(model.slope)], axis=1)) if len(model.slope) else np.zeros((n, 0))
    many = len(model.families) > 1
    top = sure[:, : len(model.families)] if many else np.ones((n, 1))
    family, of_family = top.argmax(axis=1), top.max(axis=1) / np.maximum(top.sum(axis=1), 1e-12)
    lang, score = np.empty(n, object), np.zeros(n)
    pair_at = {p: k + many * len(model.families) for k, p in enumerate(model.pairs)}
    for f, group in enumerate(model.families):
        rows = np.flatnonzero(family == f)
        votes = np.zeros((len(rows), len(group)))
        trust = np.zeros((len(rows), len(group)))
        for a, b in combinations(range(len(group)), 2):
            p = sure[rows, pair_at[group[a], group[b]]]
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
            trust[:, a] += p
            trust[:, b] += 1 - p
        best = (votes + trust / (2 * max(len(group), 1))).argmax(axis=1)
        lang[rows] = np.array(group, object)[best]
        own = trust[np.arange(len(rows)), best] / (len(group) - 1) if len(group) > 1 else np.ones(len(rows))
        score[rows] = of_family[rows] * own
    return lang, np.clip(score, 0.0, 1.0)


def lettered(column: pa.Array) -> np.ndarray:
    """Which texts hold a letter of any script."""
    data, offsets = T.utf8(column)
    out = T.row_sums(_LATIN_WORD[data], offsets) > 0
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[k] = _LETTER.search(column[int(k)].as_py()) is not None
    return out


def train(docs: DataFrame, per_language: int = 700, families: list[list[str]] | None = None) -> LanguageModel:
    """Fit on about ``per_language`` texts of each ``lang`` value, chosen by a hash of the text's id.

    Only fixed-width feature rows come to the driver, never texts.
    """
    rows = learn.bounded_sample(docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull()), "lang", "doc_id", per_language)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            x, ok = features(batch.column("text")), lettered(batch.column("text"))
            yield pa.RecordBatch.from_pydict({
                "lang": batch.column("lang").filter(pa.array(ok)), "x": pa.array([r.astype(np.float16).tobytes() for r in x[ok]], pa.binary()),
            })

    found = sorted((r["lang"], bytes(r["x"])) for r in rows.mapInArrow(featurise, "lang string, x binary").collect())
    x = np.stack([np.frombuffer(b, np.float16) for _, b in found]).astype(np.float32) if found else np.zeros((0, DIMS), np.float32)
    return fit(x, [r[0] for r in found], families)


def languages(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of a column."""
    lang, sure = predict(model, features(column))
    ok = lettered(column)
    lang[~ok], sure[~ok] = UND, 0.0
    return lang, sure


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            lang, sure = languages(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame, model: LanguageModel, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            lang, sure = languages(model, batch.column("text"))
            yield batch.filter(pa.array((lang != UND) & (sure >= min_score)))

    return docs.mapInArrow(keep, docs.schema)
