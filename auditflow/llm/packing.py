"""Token ids in files of fixed-width bit-packed blocks.

Documents are put in ascending order of doc_id by a range partitioning; each partition
encodes its texts and writes segments.  A segment is a header, tables (doc_ids, their first
id, byte offset of each block), then blocks of ``BLOCK`` ids that take the vocabulary's
minimum of bits each, and a check sum.  Blocks begin at whole bytes, so any id is found by
arithmetic and any block is unpacked by a few numpy operations.  A segment ends with one
line feed: Spark's text writer ends each row with it, and that writer puts the raw bytes
into plain files on any file system, through Spark's commit protocol.  Files are
read with the binaryFile source, so nothing is opened by path in a task.

A segment's ids begin where those of all segments before it end.  The sizes, a row for each
segment, are summed up on the driver.

Defined cases: null text has the end id alone; rows that share a doc_id stand in the order
of their texts; rows without a doc_id stand first; an empty table makes no segment and reads
as no rows; further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditflow.llm import text as T
from auditflow.llm import vocab

MAGIC = b"TKB1"
#: magic, partition, number in it, bits of an id, ids of a block, documents, ids, blocks
_HEAD = struct.Struct("<4sIIIIQQQ")
BLOCK = 4096
SEGMENT_IDS = 2 << 20
SEGMENTS_PER_FILE = 4
REMEMBERED = 250_000
#: Bytes by class: letters, digits, other printable signs of ASCII.
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_CLASS = np.where(_VISIBLE, _OTHER, 0).astype(np.uint8)
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER


def width(ids: int) -> int:
    """The least bits that tell ``ids`` ids apart."""
    return max(1, (ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The lowest ``bits`` bits of each id, one behind the other, least significant first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 8 or bits == 32:
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = ((ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """``n`` ids as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros(n, np.uint32)
    for k in range(bits):
        out |= each[:, k].astype(np.uint32) << np.uint32(k)
    return out


def segment(partition: int, number: int, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    blocks = [pack(ids[k : k + BLOCK], bits) for k in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    body = b"".join([
        _HEAD.pack(MAGIC, partition, number, bits, BLOCK, len(doc_ids), len(ids), len(blocks)),
        known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks,
    ])
    return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """One segment of a file, read without copying; ``ids(i, j)`` unpacks only the blocks that it touches."""

    def __init__(self, raw: memoryview):
        magic, self.partition, self.number, self.bits, self.block, docs, self.n_ids, blocks = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = _HEAD.size
        known = np.frombuffer(raw, np.uint8, docs, at)
        numbers = np.frombuffer(raw, "<i8", docs, at + docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
        self.starts = np.frombuffer(raw, "<u8", docs + 1, at + 9 * docs)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at + 9 * docs + 8 * (docs + 1))
        self.data = at + 9 * docs + 8 * (docs + 1) + 8 * (blocks + 1)
        self.size = self.data + int(self.offsets[-1]) + 4
        self.raw = raw
        if zlib.crc32(raw[: self.size - 4]) != struct.unpack_from("<I", raw, self.size - 4)[0]:
            raise ValueError("the check sum is wrong")

    def ids(self, i: int, j: int) -> np.ndarray:
        """The ids from place ``i`` to ``j`` of the segment."""
        if i >= j:
            return np.zeros(0, np.uint32)
        first, last = i // self.block, (j - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(self.raw[self.data + int(self.offsets[b]) : self.data + int(self.offsets[b + 1])], n, self.bits))
        return np.concatenate(parts)[i - first * self.block : j - first * self.block]


def segments(raw: bytes) -> Iterator[Segment]:
    """The segments of a file, each with a line feed behind it."""
    at, whole = 0, memoryview(raw)
    while at < len(raw):
        found = Segment(whole[at:])
        yield found
        at += found.size + 1


class WordEncoder:
    """Ids of whole texts by the tokenizers library's model, once for each distinct pre-token that is remembered.

    The normaliser and pre-tokeniser of the vocabulary never look beyond a blank.  In words
    of printable ASCII and Latin-1 letters the pre-tokens (letters, single digits, other
    signs, endings such as 's) follow from the classes of the bytes, so all of a slice are
    found at once; words with other signs or a special string go through the library as a whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.library = vocab.library_tokenizer(path)
        self.model = self.library.model
        self.size = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.letters = {b: c for b, c in vocab.byte_letters().items()}
        self.openings = {s[:2].encode() for s in vocab.special_strings(path)}
        self.words, self.parts = vocab.Memory(remembered), vocab.Memory(remembered)
        vocab.content.cache_clear()

    def part(self, part: bytes) -> bytes:
        """The ids of a pre-token as little-endian uint32, which takes less memory than numbers."""
        found = self.parts.get(part)
        if found is None:
            found = np.array([t.id for t in self.model.tokenize(part.decode("latin-1").translate(self.letters))], "<u4").tobytes()
            self.parts.put(part, found)
        return found

    def word(self, word: bytes) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            self.words.put(word, found)
        return found

    def units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, and starts and ends of all pre-tokens and odd words, and which are odd words."""
        after = np.append(data[1:], np.uint8(0))
        lead = (data == 0xC3) & (after >= 0x80) & (after != 0x97) & (after != 0xB7)
        second = np.append(False, lead[:-1])
        strange = ~(_VISIBLE[data] | T.BLANK[data] | lead | second)
        for opening in self.openings:
            strange |= (data == opening[0]) & (after == opening[-1])
        seen = np.concatenate([[0], np.cumsum(strange)])
        odd = seen[ends] > seen[starts]
        lower = T.LOWER[data]
        lower[second & (data <= 0x9E)] += 0x20

        kind = _CLASS[data]
        kind[lead | second] = _LETTER
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[:-1] |= (kind == _DIGIT)
        edge[starts] = True
        # 's, 't, 'm, 'd, 're, 've, 'll, where no other sign stands directly in front.
        mark = np.flatnonzero((data == 0x27) & edge[:-1])
        padded = np.append(lower, np.zeros(2, np.uint8))
        one, two = padded[mark + 1], padded[mark + 2]
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        short = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
        last = ends[np.searchsorted(ends, mark, "right")] if len(mark) else mark
        long &= mark + 3 <= last
        short &= mark + 2 <= last
        edge[mark[long | short] + 1] = False
        edge[mark[short] + 2] = True
        edge[mark[long] + 3] = True

        inside = np.repeat(odd, ends - starts)
        places = np.flatnonzero(~T.BLANK[data])
        edge[places[inside]] = False
        edge[starts[odd]] = True
        begin = np.flatnonzero(edge[:-1] & ~T.BLANK[data])
        owner = np.searchsorted(starts, begin, "right") - 1
        finish = np.minimum(np.append(begin[1:], len(data)), ends[owner])
        return lower, begin, finish, odd[owner]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and how many each text has."""
        data, offsets = T.utf8(column)
        starts, ends, _ = T.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        lower, begin, finish, odd = self.units(data, starts, ends)
        code = np.empty(len(begin), np.int64)
        known: list[bytes] = []
        for which, raw, look_up in ((~odd, lower, self.part), (odd, data, self.word)):
            mine = np.flatnonzero(which)
            coded = _slices_of(raw, begin[mine], finish[mine]).dictionary_encode()
            code[mine] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(known)
            known += [look_up(w) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        first = np.cumsum(sizes) - sizes
        per_unit = sizes[code]
        ends_of = np.cumsum(per_unit)
        place = np.arange(int(ends_of[-1])) + np.repeat(first[code] - (ends_of - per_unit), per_unit)
        unit_at = np.concatenate([[0], ends_of])[np.searchsorted(begin, offsets)]
        return flat[place], np.diff(unit_at)


def _slices_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each range, which ascend without overlap, as one binary column."""
    lengths = ends - starts
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1  # ranges are not empty, so ends differ
    kept = np.ascontiguousarray(data[np.cumsum(step[:-1], dtype=np.int8) > 0])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(kept)])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _with_end(ids: np.ndarray, sizes: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    if end is None:
        return ids, sizes
    return np.insert(ids, np.cumsum(sizes), end), sizes + 1


def write(docs: DataFrame, folder: str, path: str, end: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text) with the vocabulary at ``path`` and write the files into ``folder``.

    ``end`` is put behind each document's ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = word_encoder(path)
        bits, partition = width(max(work.size, (end or 0) + 1)), TaskContext.get().partitionId()
        number, held, count = 0, [], 0

        def emit():
            doc_ids = [d for part in held for d in part[0]]
            body = segment(partition, number, doc_ids, np.concatenate([p[2] for p in held]), np.concatenate([p[1] for p in held]), bits)
            return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])

        for batch in T.slices(batches, "text", 3 << 20, 1 << 14):
            ids, sizes = _with_end(*work.encode(batch.column("text")), end)
            held.append((batch.column("doc_id").to_pylist(), ids, sizes))
            count += len(ids)
            if count >= segment_ids:
                yield emit()
                number, held, count = number + 1, [], 0
        if held:
            yield emit()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "body binary").select(F.col("body").cast("string")).write.option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (the ids of all documents before it), n_tokens, ids (little-endian uint32) from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                found = [(s.partition, s.number, s.n_ids) for s in segments(raw.as_py())]
                yield pa.RecordBatch.from_pylist([{"p": p, "k": k, "n": n} for p, k, n in found], pa.schema([("p", pa.int64()), ("k", pa.int64()), ("n", pa.int64())]))

    base, total = {}, 0
    for p, k, n in sorted(tuple(r) for r in files.mapInArrow(heads, "p long, k long, n long").collect()):
        base[p, k], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                for s in segments(raw.as_py()):
                    first = base[s.partition, s.number]
                    starts = s.starts.astype(np.int64)
                    for k in range(0, len(s.doc_ids), 1024):
                        part = starts[k : k + 1025]
                        ids = s.ids(int(part[0]), int(part[-1])).astype("<u4").tobytes()
                        ends = pa.array((4 * (part - part[0])).astype(np.int32))
                        column = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, ends.buffers()[1], pa.py_buffer(ids)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(s.doc_ids[k : k + 1024], pa.int64()), pa.array(first + part[:-1]), pa.array(np.diff(part)), column],
                            ["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
