"""Byte-pair encoding with content-defined chunks, and decoding.

A rolling hash over the last 32 bytes cuts texts into chunks of about ``CHUNK`` bytes.  The
cuts follow the content, so copied passages fall into the same chunks in every document, and
a chunk that was met before is not encoded again: its ids come from the memory of the
Python worker, which lasts over tasks and has a bounded size.  A chunk's first and last
tokens may depend on its neighbours.  So each join is repaired: the ids next to it are
dropped on both sides as far as the nearest place where the encoding of the chunk and that
of the whole text must agree (a blank behind a visible sign: every pre-token pattern match
ends there), and the stretch between is encoded again.  If there is no such place the
stretch grows over the next chunk.  The ids are exactly those of the whole text.

The vocabulary and merges are read from the tokenizer file.  Texts that hold one of its
special strings, and stretches with characters above U+2FFF, go through the tokenizers
library itself; all others through a faster encoder made from the same merges, in front of
which runs of blanks are set apart, whatever their length.

Defined cases: null is the empty text, which has no ids and decodes to the empty text; ids
that the vocabulary lacks decode to nothing; repeated rows give repeated results; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditflow.llm import text as T
from auditflow.llm import vocab

#: Mean bytes of a chunk, a power of two.
CHUNK = 512
_REACH = 32
#: Bytes of chunk text whose ids a worker remembers, in each of two generations.
REMEMBERED = 8 << 20
_GEAR = np.random.default_rng(19937).integers(0, 1 << 32, 256, dtype=np.uint32)
_ODD_SIGNS = re.compile("[　-\U0010ffff]")
#: Runs of what the pattern counts as blanks (below U+3000).
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f]{2,}")
#: A blank behind a sign that certainly is none: there all encodings agree.
_AGREE = re.compile(r"(?<=[\x21-\x7EÀ-ſ])[ \n\t\r]")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def cuts(data: np.ndarray, offsets: np.ndarray, mean: int = CHUNK) -> np.ndarray:
    """The places between two chunks: behind a byte where the hash of the last 32 bytes of the row is right."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step) if len(h) > step else np.uint32(0)
        h = more
    at = np.flatnonzero(h >> np.uint32(32 - (mean.bit_length() - 1)) == 0) + 1
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    start = offsets[np.searchsorted(offsets, at, "right") - 1]
    return at[at - start >= _REACH]


class Encoder:
    """Ids of whole texts through remembered chunks; ``stats`` counts chunks met and chunks encoded."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import tiktoken

        self.path = path
        model = vocab.content(path)["model"]
        raw = {letter: b for b, letter in vocab.byte_letters().items()}
        ranks = {bytes(raw[c] for c in token): i for token, i in model["vocab"].items()}
        if any(model["vocab"]["".join(m)] != 256 + k for k, m in enumerate(vocab.merges(path))):
            raise ValueError("ids must follow the order of the merges")
        self.specials = vocab.special_strings(path)
        self.fast = tiktoken.Encoding("merges", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memory = vocab.Memory(remembered)
        self.stats = {"chunks": 0, "encoded": 0}
        vocab.content.cache_clear()

    def slow(self, text: str) -> array:
        """By the tokenizers library, which is loaded when it is first needed."""
        return array("i", vocab.library_tokenizer(self.path).encode(text, add_special_tokens=False).ids)

    def plain(self, text: str) -> array:
        if _ODD_SIGNS.search(text):
            return self.slow(text)
        ids, at = array("i"), 0
        for run in _RUN.finditer(text):
            # The pattern takes a run of blanks without its last sign (at the end of the text: all of it) as one piece.
            # Its look-ahead gives back signs one by one, so a long run would overflow the matcher's stack.
            end = run.end() - (run.end() < len(text))
            if at < run.start():
                ids.extend(self.fast.encode_ordinary(text[at : run.start()]))
            ids.extend(self.fast._encode_single_piece(text[run.start() : end]))
            at = end
        if at < len(text):
            ids.extend(self.fast.encode_ordinary(text[at:] if at else text))
        return ids

    def chunk(self, text: str) -> tuple[str, array | None, str]:
        """What stands before the first agreeing place, the ids between first and last, what stands behind.

        Without an agreeing place the ids are None and all stands behind.
        """
        self.stats["chunks"] += 1
        found = self.memory.get(text)
        if found is None:
            self.stats["encoded"] += 1
            first = _AGREE.search(text)
            if first is None:
                found = ("", None, text)
            else:
                begin, end = first.start(), first.start()
                for end in (m.start() for m in _AGREE.finditer(text, max(begin, len(text) - 64))):
                    pass
                if end == begin:  # none near the end: look everywhere
                    for end in (m.start() for m in _AGREE.finditer(text, begin)):
                        pass
                found = (text[:begin], self.plain(text[begin:end]), text[end:])
            self.memory.put(text, found, len(text))
        return found

    def encode(self, chunks: list[str]) -> array:
        """The ids of the text that the chunks make up."""
        whole = "".join(chunks)
        if any(s in whole for s in self.specials):
            return self.slow(whole)
        ids = array("i")
        open_end = ""
        for text in chunks:
            head, body, tail = self.chunk(text)
            if body is None:
                open_end += tail
                continue
            if open_end or head:  # the join, encoded from agreement to agreement
                ids += self.plain(open_end + head)
            ids += body
            open_end = tail
        return ids + self.plain(open_end) if open_end else ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The bytes that each id stands for."""
    model, raw = vocab.content(path), {letter: b for b, letter in vocab.byte_letters().items()}
    found = {i: bytes(raw[c] for c in token) for token, i in model["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in model["added_tokens"]}
    vocab.content.cache_clear()
    return [found.get(i, b"") for i in range(max(found) + 1)]


def chunked(column: pa.Array, mean: int = CHUNK) -> Iterator[list[str]]:
    """The chunks of each text of a column."""
    data, offsets = T.utf8(column)
    at = cuts(data, offsets, mean)
    raw = data.tobytes()
    first = np.searchsorted(at, offsets[:-1], "right")
    last = np.searchsorted(at, offsets[1:], "left")
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), last.tolist(), strict=True):
        edges = [a, *at[i:j].tolist(), b]
        yield [raw[x:y].decode() for x, y in zip(edges, edges[1:], strict=False)] if b > a else []


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    work = encoder(path)
    for batch in T.slices(batches, "text", 1 << 20):
        ids = [np.frombuffer(work.encode(chunks), np.int32) for chunks in chunked(batch.column("text"))]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = pieces(path)
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part, texts = batch.slice(k, 512), []
            for row in part.column("ids"):
                ids = row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else []
                if ids and (max(ids) >= len(table) or min(ids) < 0):
                    ids = [i for i in ids if 0 <= i < len(table)]
                texts.append(b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _encoded(batches, path), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` and the text that their ids stand for; invalid UTF-8 becomes U+FFFD."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, path), f"doc_id {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``decode(encode(docs))`` in one pass, so that the ids do not leave the Python worker in between."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _decoded(_encoded(batches, path), path), f"doc_id {kind}, ids array<int>, decoded string")
