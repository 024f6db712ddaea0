"""Token counts by a finite-state transducer compiled from the merges of a vocabulary.

In a byte-pair vocabulary a sequence of tokens is the encoding of its text exactly if each
two neighbours are the encoding of theirs.  So each prefix of a word has one last token:
the one that may follow the last token of the prefix in front of it.  A state holds what
can still matter: for each place where a token may yet begin, its node in the trie of
tokens, the last token before it, and the tokens counted up to there relative to now.  A
transition reads a byte and carries the change of the token count; the byte that ends a
word has transitions of its own, back to the start.  States and transitions are compiled
when a text first needs them and kept within a bound.

Blanks bring every state back to the start.  So the map of a chunk of text, from the state
before it to the state and count behind it, is held by three things: the stretch before its
first blank, the count between the first and last blank, the stretch behind the last.  Maps
compose associatively; the count of a text is the scan over its chunks.  Inside a batch the
distinct words run through the transducer once and a prefix sum over all words gives every
text's count.

Defined cases: null and empty texts have no bytes and no tokens; characters outside the
common ones are normalised and parted by the tokenizers library before the transducer counts;
a special string in a text counts as the library counts it; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from auditflow.llm import text as T
from auditflow.llm import vocab

#: Signs for which lower case and the pattern below equal what the library does: ASCII and Latin-1 letters.
_COMMON = re.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Texts above this many bytes are counted chunk by chunk.
CHUNK = 4 << 20
STATES = 250_000
REMEMBERED = 300_000


class Transducer:
    """Counts the tokens of a word, given as bytes, by walking compiled transitions.

    An open place of a state is one number: trie node, last token + 1 (0: none), and the
    tokens counted up to there less those counted now.
    """

    def __init__(self, path: str, states: int = STATES):
        model = vocab.content(path)["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        ids: dict[str, int] = model["vocab"]
        merges = vocab.merges(path)
        self.rank = {(ids[a], ids[b]): k for k, (a, b) in enumerate(merges)}
        self.parts = {ids[a + b]: (ids[a], ids[b]) for a, b in merges}
        if len(self.parts) < len(merges):
            raise ValueError("each merge must make a token of its own")
        raw = {letter: b for b, letter in vocab.byte_letters().items()}
        specials = set(vocab.special_strings(path))
        self.trie: list[dict[int, int]] = [{}]
        self.inner: dict[int, int] = {}  # node -> token that may be followed
        self.final: dict[int, int] = {}  # node -> token that ends a word
        for name, number in ids.items():
            if name in specials:
                continue
            ends = bool(self.suffix) and name.endswith(self.suffix) and name != self.suffix
            node = 0
            for c in name[: len(name) - len(self.suffix)] if ends else name:
                node = self.trie[node].setdefault(raw[c], len(self.trie))
                if node == len(self.trie):
                    self.trie.append({})
            (self.final if ends else self.inner)[node] = number
        self.whole: dict[int, bool] = {}
        self.limit = states
        self.restart()

    def restart(self) -> None:
        """Forget the compiled states, of which there are too many."""
        start = (self.open(0, 0, 0),)
        self.numbers = {start: 0}
        self.states = [start]
        self.moves: dict[int, int] = {}  # state * 256 + byte -> next state * 256 + change + 128
        self.ends: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def open(node: int, last: int, behind: int) -> int:
        return (node << 32 | last) << 8 | behind + 128

    def is_whole(self, token: int) -> bool:
        """Whether byte-pair encoding of the token's own bytes gives the token."""
        found = self.whole.get(token)
        if found is None:
            parts = self.parts.get(token)
            found = parts is None or self.is_whole(parts[0]) and self.is_whole(parts[1]) and self.apart(*parts, self.rank[parts])
            self.whole[token] = found
        return found

    def apart(self, a: int, b: int, until: int | None = None) -> bool:
        """Whether no merge crosses the border of ``a`` and ``b``, or none before the rank ``until``.

        Both tokens are built up merge by merge at the border; the pieces that touch there
        would merge if their rank came first, on equal rank the one further left.
        """
        never = len(self.rank) if until is None else until
        left, right = [a], [b]
        while left[-1] in self.parts:
            left.append(self.parts[left[-1]][1])
        while right[-1] in self.parts:
            right.append(self.parts[right[-1]][0])
        x, y = left.pop(), right.pop()
        while True:
            cross = self.rank.get((x, y), never)
            up_x = self.rank[self.parts[left[-1]]] if left else never
            up_y = self.rank[self.parts[right[-1]]] if right else never
            if cross < up_x and cross <= up_y and cross < never:
                return False
            if left and up_x <= up_y:
                x = left.pop()
            elif right:
                y = right.pop()
            else:
                return True

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand behind the token ``last`` - 1 (0: the word's beginning)."""
        if not last:
            return self.is_whole(token)
        key = last << 32 | token
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self.is_whole(token) and self.apart(last - 1, token)
        return found

    def step(self, state: int, byte: int) -> int:
        """The next state and the change of the count."""
        token, count, still = -1, 0, []
        for place in self.states[state]:
            child = self.trie[place >> 40].get(byte)
            if child is None:
                continue
            last, behind = place >> 8 & 0xFFFFFFFF, (place & 255) - 128
            found = self.inner.get(child)
            if found is not None and self.follows(last, found):
                token, count = found, behind + 1
            if self.trie[child]:
                still.append((child, last, behind))
        if token < 0:
            raise ValueError("the vocabulary lacks a byte")
        key = (*[self.open(child, last, behind - count) for child, last, behind in still], self.open(0, token + 1, 0))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        found = self.moves[state << 8 | byte] = number << 8 | count + 128
        return found

    def end(self, state: int, byte: int) -> int:
        """The change of the count by the last byte of a word."""
        ending = self.final if self.suffix else self.inner
        for place in self.states[state]:
            child = self.trie[place >> 40].get(byte)
            token = None if child is None else ending.get(child)
            if token is not None and self.follows(place >> 8 & 0xFFFFFFFF, token):
                found = self.ends[state << 8 | byte] = (place & 255) - 127
                return found
        raise ValueError("the vocabulary lacks a byte")

    def count(self, word: bytes) -> int:
        """The tokens of one pre-token."""
        if not word:
            return 0
        if len(self.states) > self.limit:
            self.restart()
        state, total, moves = 0, 0, self.moves
        for byte in word[:-1]:
            go = moves.get(state << 8 | byte)
            if go is None:
                go = self.step(state, byte)
            state = go >> 8
            total += (go & 255) - 128
        last = self.ends.get(state << 8 | word[-1])
        return total + (self.end(state, word[-1]) if last is None else last)


class ChunkMap:
    """What a chunk of text does to the state and count: stretch before its first blank, count, stretch behind its last.

    ``count`` is None for a chunk without a blank, which is one open stretch, ``head``.
    """

    __slots__ = ("head", "count", "tail")

    def __init__(self, head: str, count: int | None, tail: str):
        self.head, self.count, self.tail = head, count, tail

    def then(self, other: ChunkMap, words) -> ChunkMap:
        """This chunk and the next as one; ``words`` counts the tokens of a stretch."""
        if self.count is None:
            return ChunkMap(self.head + other.head, other.count, other.tail)
        if other.count is None:
            return ChunkMap(self.head, self.count, self.tail + other.head)
        return ChunkMap(self.head, self.count + words(self.tail + other.head) + other.count, other.tail)

    def total(self, words) -> int:
        return words(self.head) + (0 if self.count is None else self.count + words(self.tail))


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.library = vocab.library_tokenizer(path)
        self.transducer = Transducer(path)
        self.specials = vocab.special_strings(path)
        self.letters = {letter: b for b, letter in vocab.byte_letters().items()}
        self.memory, self.parts = vocab.Memory(remembered), vocab.Memory(remembered)
        vocab.content.cache_clear()

    def part(self, part: str) -> int:
        found = self.parts.get(part)
        if found is None:
            found = self.transducer.count(part.encode())
            if len(part) < 200:
                self.parts.put(part, found)
        return found

    def word(self, word: str) -> int:
        """The tokens of a stretch without ASCII blanks."""
        if not word:
            return 0
        found = self.memory.get(word)
        if found is None:
            if any(s in word for s in self.specials):
                found = len(self.library.encode(word, add_special_tokens=False).ids)
            elif _COMMON.fullmatch(word):
                found = sum(map(self.part, _PARTS.findall(word.lower())))
            else:
                parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
                found = sum(self.transducer.count(bytes(self.letters[c] for c in part)) for part, _ in parts)
            if len(word) < 200:
                self.memory.put(word, found)
        return found

    def column(self, column: pa.Array) -> np.ndarray:
        """The tokens of each text: distinct words once, then a prefix sum over all words."""
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded = lists.flatten().dictionary_encode()
        known = np.fromiter(map(self.word, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        before = np.zeros(len(coded) + 1, np.int64)
        np.cumsum(known[coded.indices.to_numpy(zero_copy_only=False)], out=before[1:])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return np.diff(before[ends])

    def chunk(self, text: str) -> ChunkMap:
        first = next((k for k, c in enumerate(text) if c in " \t\n\v\f\r"), None)
        if first is None:
            return ChunkMap(text, None, "")
        last = max(text.rfind(c) for c in " \t\n\v\f\r")
        inner = text[first : last + 1]
        return ChunkMap(text[:first], int(self.column(pa.array([inner]))[0]), text[last + 1 :])

    def long(self, text: str, size: int = CHUNK) -> int:
        """The tokens of a text of any length, scanned chunk by chunk in bounded memory."""
        found = ChunkMap("", None, "")
        for k in range(0, len(text), size):
            found = found.then(self.chunk(text[k : k + size]), self.word)
        return found.total(self.word)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = counter(path)
        for batch in T.slices(batches, "text", chunk, 1 << 14):
            column = batch.column("text")
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            if batch.num_rows == 1 and size[0].as_py() > chunk:
                tokens = np.array([work.long(column[0].as_py(), chunk)])
            else:
                tokens = work.column(column)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
