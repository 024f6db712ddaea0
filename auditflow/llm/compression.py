"""Quality by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is trained on whole good labelled texts, cut into blocks, the other on bad
ones; how many texts is bounded, their length is not.  A text is cut into blocks, and each block is compressed with both; so the
dictionaries matter over the whole of a long text.  The difference of the two sizes, per
byte of text, becomes a probability by a logistic curve fitted on labelled texts that the
dictionaries have not seen.

Defined cases: null and empty texts have the difference 0 and the probability that belongs
to it; without labelled rows of both kinds every score is 0.5; repeated rows give
repeated results, and of rows that share an id one text is learned from; texts of any length are read whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditflow.llm import learn
from auditflow.llm import text as T

BLOCK = 2048
DICTIONARY = 32 << 10
#: Bytes of the blocks in which whole texts go to the trainer; chosen, like the number of texts, on rows learned from.
PIECE = 200
LEVEL = 3
PREDICT_FROM = 0.3


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float = 0.0
    shift: float = 0.0


class Sizes:
    """Compressed sizes with both dictionaries."""

    def __init__(self, model: CompressionModel):
        self.both = []
        for raw in (model.good, model.bad):
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            words = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            words.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def difference(self, text: bytes | memoryview) -> float:
        """By how much per byte the good dictionary shortens the text more than the bad one."""
        good, bad = self.both
        saved = 0
        for k in range(0, len(text), BLOCK):
            block = text[k : k + BLOCK]
            saved += len(bad(block)) - len(good(block))
        return saved / max(len(text), 1)

    def differences(self, column: pa.Array) -> np.ndarray:
        data, offsets = T.utf8(column)
        raw = memoryview(data.tobytes())
        at = offsets.tolist()
        return np.fromiter((self.difference(raw[a:b]) for a, b in zip(at, at[1:], strict=False)), np.float64, len(at) - 1)


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    """A trained dictionary; from few pieces the trainer makes none, then the pieces themselves serve."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, y and one text of each chosen id, so that rows which share an id count once."""
    found = sorted({(r[0], r[1]) for r in ids.select("doc_id", "y").distinct().collect()})
    chosen = F.broadcast(docs.sparkSession.createDataFrame(found, "doc_id bigint, y int"))
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def _trained(group: pa.Table) -> pa.Table:
    """The dictionary of one label, from all blocks of its chosen texts."""
    raw = [(t or "").encode() for t in group.column("text").to_pylist()]
    blocks = sorted({t[k : k + PIECE] for t in raw for k in range(0, len(t), PIECE)})
    mixed = np.random.default_rng(7).permutation(len(blocks))
    words = _dictionary([blocks[k] for k in mixed], DICTIONARY) if blocks else b""
    return pa.table({"y": pa.array([group.column("y")[0].as_py()], pa.int32()), "words": pa.array([words], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, per_label: int = 600, calibrate: int = 2000) -> CompressionModel | None:
    """Dictionaries from about ``per_label`` texts of each label, the curve from about ``calibrate`` other texts.

    ``labels`` holds doc_id and quality.  A task for each label trains its dictionary; the two dictionaries come to
    the driver, then one number for each text of the second sample.
    """
    labels = labels.select("doc_id", F.col("quality").alias("y"), F.lit(1).alias("any")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(2))
    first = _chosen(docs, learn.bounded_sample(labels.where(half == 0), "y", "doc_id", per_label))
    found = {r["y"]: bytes(r["words"]) for r in first.select("y", "text").groupBy("y").applyInArrow(_trained, "y int, words binary").collect()}
    if not found.get(0) or not found.get(1):
        return None
    model = CompressionModel(found[1], found[0])
    second = _chosen(docs, learn.bounded_sample(labels.where(half == 1), "any", "doc_id", calibrate))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model)
        for batch in T.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(sizes.differences(batch.column("text")))], ["y", "d"])

    seen = np.array(sorted((r["y"], r["d"]) for r in second.mapInArrow(measure, "y int, d double").collect())).reshape(-1, 2)
    slope, shift = learn.platt(seen[:, 1], seen[:, 0]) if len(seen) else (50.0, 0.0)
    return CompressionModel(model.good, model.bad, slope, shift)


def score(docs: DataFrame, model: CompressionModel | None) -> DataFrame:
    """doc_id, difference and score of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model) if model else None
        for batch in T.slices(batches, "text"):
            d = sizes.differences(batch.column("text")) if sizes else np.zeros(batch.num_rows)
            p = learn.sigmoid(d * model.slope + model.shift) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(d), pa.array(p)], ["doc_id", "difference", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, difference double, score double")
