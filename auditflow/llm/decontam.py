"""Benchmark decontamination by templates.

Texts become templates: numbers, names and units are replaced by typed placeholders, all
else is lower-cased and freed of outer signs.  A run of names is one name.  A capital that opens
a sentence may make a name or not, so both readings are taken.  Windows of five template tokens are hashed
and joined with the benchmark's windows.  The hits of one text and item are chained to a
passage: places in the text and in the item rise together, and no two neighbours lie further
apart than the item is long, so words may be put in or left out anywhere.  The hits of a
passage fill the item's slots; those that disagree with what most of them say are not counted,
unless they are word for word.  An item has leaked where a passage holds at least ``share`` of
its windows.  So a question with other numbers, names or units is caught, and a text that
merely has numbers in like places is not.

A window of placeholders alone is joined by the word next to its run and the distance from it, so that a long list of
numbers does not meet every item with five of them; a number put into such a run moves the windows behind it.

Documents are scanned once, in a narrow stage.  A bit map of fixed size, made from the
benchmark's hashes, lets through the few windows that can join; the join itself is exact and
left to Spark, however large the benchmark is.

Defined cases: null or empty texts match nothing; items with fewer tokens than a window
match nothing; equal items each get their rows; rows that repeat an id are judged one by one
and reported once; null ids are not reported, but ``clean`` judges rows without a doc_id too;
texts of any length are read whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditflow.llm import text as T

WINDOW = 5
SHARE = 0.8
#: log2 of the bits in the map: 2 MB, whatever the size of the benchmark.
MAP_BITS = 24
#: Fixed words that are units where they follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs ounce ounces ton tons ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents pound pounds usd eur gbp percent % $ mph km/h kw kwh w v a hz mb gb tb".split()
)
#: Of these, the ones that mean nothing else and are units anywhere.
FREE_UNITS = UNITS - frozenset("m g l s h v a w in ft min sec second seconds minute mg ml mb gb tb hz % $".split())
#: Fixed signs that are no part of a word at its ends.
OUTER = "\"'`.,;:!?()[]{}<>*_|#&$%~-"
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(%|[a-z°]{1,3})?")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ENDS = (".", "!", "?", ":")
_NUM, _NAME, _UNIT = "\x01num", "\x01name", "\x01unit"
#: The bit of a slot value that tells numbers from names and units.
_IS_NUM = 2


def _is_number(word: str) -> bool:
    return _NUMBER.fullmatch(word.strip("\"'`.,;:!?()[]{}*").lower()) is not None


def token(word: str, before: str | None) -> tuple[str, str]:
    """Template token ('' for mere signs) and slot value; ``before`` is the word in front of it in its line."""
    core = word.strip(OUTER)
    low = core.lower()
    if _is_number(word):
        return _NUM, low
    if low in FREE_UNITS or before is not None and _is_number(before) and (low in UNITS or word in UNITS):
        return _UNIT, low or word
    if not core:
        return "", ""
    if core[0].isupper() and not core.isupper() and before is not None and not before.endswith(_ENDS):
        return _NAME, low
    return low, ""


def tokens(text: str | None) -> list[tuple[str, str]]:
    """(template token, slot value) of each word that has one, a run of names as one; sentences start in lower case."""
    out = []
    for line in (text or "").split("\n"):
        before, open_end = None, False
        for word in _WORD.findall(line):
            found, slot = token(word, before)
            if found == _NAME and open_end and word[0] not in OUTER:
                out[-1] = (_NAME, f"{out[-1][1]} {slot}")
            elif found:
                out.append((found, slot))
            before, open_end = word, found == _NAME and word[-1] not in OUTER
    return out


def _table(signs: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in signs]] = True
    return out


_SIGN, _END, _DIGIT = _table(OUTER), _table("".join(_ENDS)), _table("0123456789")


def _hash(value: str) -> int:
    raw = np.frombuffer(value.encode(), np.uint8)
    return int(T.word_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])


def _hashes(values: list[str]) -> np.ndarray:
    """The hash of each of many words."""
    raw = [v.encode() for v in values]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    return T.word_hashes(np.frombuffer(b"".join(raw) or b" ", np.uint8), ends - [len(r) for r in raw], ends)


_PLACEHOLDERS = np.array([_hash(x) for x in (_NUM, _NAME, _UNIT)], np.uint64)
_FREE = np.sort(np.array([_hash(u) for u in sorted(FREE_UNITS)], np.uint64))


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


class Readings(NamedTuple):
    """Tokens of a column as hashes (slot 0: none), and the first place of each row.

    A capital that opens a sentence is read in two ways: ``codes`` has the word, ``other`` the
    places that may be names instead, ``named`` their slots; ``tied`` are names that such a
    name takes in.
    """

    codes: np.ndarray
    slots: np.ndarray
    first: np.ndarray
    other: np.ndarray
    named: np.ndarray
    tied: np.ndarray


def template_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` of a whole column as hashes (slot 0: none), and the first place of each row."""
    return readings(column)[:3]


def readings(column: pa.Array) -> Readings:
    """Both readings of a whole column.

    Words of ASCII and Latin-1 letters are handled as arrays; words with digits or other
    characters, and words behind a digit, one by one, once for each distinct case.
    """
    data, offsets = T.utf8(column)
    starts, ends, first = T.words(data, offsets)
    n = len(starts)
    if not n:
        return Readings(np.zeros(0, np.uint64), np.zeros(0, np.uint64), first, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
    second = np.zeros(len(data), bool)  # the second bytes of Latin-1 letters
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    sign = (data == 0x97) | (data == 0xB7)
    capital = ((data >= 0x41) & (data <= 0x5A)) | (second & (data <= 0x9E) & ~sign)
    small = _sums(((data >= 0x61) & (data <= 0x7A)) | (second & (data >= 0x9F) & ~sign))
    lowered = data.copy()
    lowered[capital] += 0x20
    solid = np.flatnonzero(~_SIGN[data])
    before = _sums(~_SIGN[data])
    left = np.append(solid, len(data))[before[starts]]
    some = left < ends  # else the word is mere signs
    left = np.where(some, left, starts)
    right = np.where(some, solid[np.maximum(before[ends], 1) - 1] + 1, starts)
    codes, slots = T.word_hashes(lowered, left, right), np.zeros(n, np.uint64)
    begins = np.zeros(n, bool)
    begins[first[:-1][first[:-1] < n]] = True
    newline = _sums(data == 0x0A)
    begins[1:] |= newline[starts[1:]] > newline[ends[:-1]]
    opened = begins.copy()  # a capital says nothing here
    opened[1:] |= _END[data[ends[:-1] - 1]]
    head = np.minimum(left, len(data) - 1)
    upper = capital[head] | ((data[head] == 0xC3) & capital[np.minimum(head + 1, len(data) - 1)])
    name = some & upper & (small[right] > small[left])
    at = np.searchsorted(_FREE, codes)
    at[at == len(_FREE)] = 0
    unit = some & (_FREE[at] == codes)
    name &= ~unit
    maybe = name & opened
    name &= ~opened
    slots[maybe] = codes[maybe] | np.uint64(1)  # until the readings part
    for placeholder, those in ((_NAME, name), (_UNIT, unit)):
        slots[those] = codes[those] | np.uint64(1)
        codes[those] = np.uint64(_hash(placeholder))
    keep = some.copy()
    digit = _sums(_DIGIT[data])
    other = (data >= 0x80) & ~second
    other[:-1] &= ~second[1:]
    strange = _sums(other)
    numeric = digit[ends] > digit[starts]
    special = numeric | (strange[ends] > strange[starts]) | (second & sign)[np.minimum(starts + 1, len(data) - 1)]
    special |= _sums(second & sign)[ends] > _sums(second & sign)[starts]
    special[1:] |= numeric[:-1]
    raw, seen, numbers, which = data.tobytes(), {}, {}, []
    odd = np.flatnonzero(special)
    for k in odd.tolist():
        word = raw[starts[k] : ends[k]]
        told = None
        if not begins[k]:  # of the word in front it matters whether it is a number and whether it ends a sentence
            told = "." if opened[k] else "x"
            if numeric[k - 1]:
                front = raw[starts[k - 1] : ends[k - 1]]
                if (number := numbers.get(front)) is None:
                    number = numbers[front] = _is_number(front.decode())
                if number:
                    told = "1." if opened[k] else "1"
        which.append(seen.setdefault((word, told), len(seen)))
    read = []
    for word, told in seen:
        t, slot = token(word.decode(), told)
        inside, low = token(word.decode(), "x") if t and not slot else ("", "")
        own = inside == _NAME
        read.append((t, low if own else slot, t == _NAME, own))
    if read:
        tokens_of, slots_of = (np.array([bool(x) for x in c]) for c in list(zip(*read, strict=True))[:2])
        hashes = [_hashes([r[c] for r in read]) for c in (0, 1)]
        codes[odd], slots[odd] = np.where(tokens_of, hashes[0], 0)[which], np.where(slots_of, hashes[1] | np.uint64(1), 0)[which]
        keep[odd], name[odd], maybe[odd] = tokens_of[which], np.array([r[2] for r in read])[which], np.array([r[3] for r in read])[which]
    # A name that follows another without a sign between them is part of it.
    joins = np.zeros(n, bool)
    joins[1:] = name[1:] & (name | maybe)[:-1] & (right == ends)[:-1] & (left == starts)[1:]
    inner = joins.copy()  # words behind the first of a run of names
    inner[1:] &= name[:-1]
    tied = joins & ~inner
    plain = ~special
    plain[1:] &= (starts[1:] - ends[:-1] == 1) & (data[ends[:-1]] == 0x20)
    bounds = np.flatnonzero(~inner)
    last = np.empty(n, np.int64)  # the last word of the run that starts here
    last[bounds] = np.append(bounds[1:], n) - 1
    rough = _sums(~plain | special)
    odd = _sums(special)

    def fill(heads: np.ndarray, tails: np.ndarray) -> None:
        slots[heads] = T.word_hashes(lowered, left[heads], right[tails]) | np.uint64(1)
        bad = (rough[tails + 1] > rough[heads + 1]) | (odd[heads + 1] > odd[heads])
        for k, e in zip(heads[bad].tolist(), tails[bad].tolist(), strict=True):
            slots[k] = np.uint64(_hash(" ".join(raw[left[j] : right[j]].decode().lower() for j in range(k, e + 1))) | 1)

    heads = np.flatnonzero(name & ~inner)
    heads = heads[last[heads] > heads]
    fill(heads, last[heads])
    heads = np.flatnonzero(tied) - 1
    fill(heads, last[heads + 1])
    keep &= ~inner
    kept = np.flatnonzero(keep)
    other = np.flatnonzero(maybe[kept])
    named = slots[kept[other]]
    slots[maybe] = 0
    return Readings(codes[kept], slots[kept], np.searchsorted(kept, first), other, named, tied[kept])


def _other_windows(found: Readings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that read a sentence's first word as a name at least once: place, hash, and the places of their
    tokens (those of such names counted on behind the text's)."""
    m = len(found.codes)
    if not len(found.other):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, WINDOW), np.int64)
    rank = np.full(m + 1, -1, np.int64)
    rank[found.other] = np.arange(len(found.other))
    ends = np.repeat(found.first[1:], np.diff(found.first))
    place = np.unique((found.other[:, None] - np.arange(WINDOW)).reshape(-1))
    place = place[place >= 0]
    tied = np.append(found.tied, [False, False])
    at, total, used, path = place, np.zeros(len(place), np.uint64), np.zeros(len(place), bool), np.zeros((len(place), WINDOW), np.int64)
    for k in range(WINDOW):
        inside = at < ends[place]
        place, at, total, used, path = place[inside], at[inside], total[inside], used[inside], path[inside]
        name = np.flatnonzero(rank[at] >= 0)
        path, named = path.copy(), path[name]
        path[:, k], named[:, k] = at, m + rank[at[name]]
        read = T.mixed(total * T._ODD + found.codes[at])
        as_name = T.mixed(total[name] * T._ODD + np.uint64(_hash(_NAME)))
        place, total, used, path = (np.concatenate(x) for x in ((place, place[name]), (read, as_name), (used, np.ones(len(name), bool)), (path, named)))
        at = np.concatenate([at + 1, at[name] + 1 + tied[at[name] + 1]])
    return place[used], total[used], path[used]


def _run_keys(found: Readings, places: np.ndarray, paths: np.ndarray, grams: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three join keys of windows of placeholders alone, and which of them each window has.

    By its hash alone such a window would meet every other one.  So it is told by the nearest word of its text in front
    of the run of placeholders and its distance from it; else by the nearest one behind; else by its slot values.
    """
    m = len(found.codes)
    hard = ~np.isin(found.codes, _PLACEHOLDERS)
    hard[found.other] = False
    row = T.row_of(found.first)[places]
    before = np.maximum.accumulate(np.where(hard, np.arange(m), -1))[places]
    after = np.minimum.accumulate(np.where(hard, np.arange(m), m)[::-1])[::-1][places]
    keys, there = [], [before >= found.first[row], after < found.first[row + 1], np.ones(len(places), bool)]
    for kind, near in enumerate((before, after)):
        near = np.clip(near, 0, m - 1)
        far = np.abs(spot[places] - spot[near]).astype(np.uint64)
        keys.append(T.mixed(T.mixed(T.mixed(grams * T._ODD + found.codes[near]) * T._ODD + far) * T._ODD + np.uint64(kind)))
    values, total = np.concatenate([found.slots, found.named]), grams
    for k in range(WINDOW):
        total = T.mixed(total * T._ODD + values[paths[:, k]])
    return np.stack([*keys, total]), np.stack(there)


def _window_rows(batch: pa.RecordBatch, name: str, bits: np.ndarray | None = None) -> pa.RecordBatch:
    """The windows of a batch of texts; with ``bits`` those alone whose hash prefix is marked there.

    A window of placeholders alone has the first of its keys; with ``bits`` all of them.
    """
    found = readings(batch.column("text"))
    codes, first, m = found.codes, found.first, len(found.codes)
    spot = np.arange(m) - _sums(found.tied)[1:]
    places, grams = T.windows(codes, first, WINDOW)
    others, other_grams, other_paths = _other_windows(found)
    soft = np.isin(codes, _PLACEHOLDERS)
    in_front = _sums(soft)
    pure = np.concatenate([in_front[places + WINDOW] - in_front[places] == WINDOW, np.append(soft, np.ones(len(found.other), bool))[other_paths].all(axis=1)])
    plain, places, grams = len(places), np.concatenate([places, others]), np.concatenate([grams, other_grams])

    def paths_of(at: np.ndarray) -> np.ndarray:
        out = places[at][:, None] + np.arange(WINDOW)
        out[at >= plain] = other_paths[at[at >= plain] - plain]
        return out

    at = np.flatnonzero(pure)
    keys, there = _run_keys(found, places[at], paths_of(at), grams[at], spot)
    if bits is None:
        grams[at] = keys[np.argmax(there, axis=0), np.arange(len(at))]
        pick = np.arange(len(grams))
    else:
        pick = np.concatenate([np.flatnonzero(~pure), *(at[x] for x in there)])
        grams = np.concatenate([grams[~pure], *(k[x] for k, x in zip(keys, there, strict=True))])
        at = grams >> np.uint64(64 - MAP_BITS)
        marked = np.flatnonzero((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
        pick, grams = pick[marked], grams[marked]
    paths, places = paths_of(pick), places[pick]
    # A name that another reading takes in has no place of its own.
    begin = first[:-1]
    spots = T.row_sums(~found.tied, first)
    size = np.maximum(spots - WINDOW + 1, np.minimum(np.diff(first) - WINDOW + 1, 1))
    row = T.row_of(first)[places]
    if bits is None:
        counted = np.flatnonzero(~found.tied[places] & (spot[places] - spot[begin[row]] < size[row]))
        row, places, grams, paths = row[counted], places[counted], grams[counted], paths[counted]
    numbers = codes == np.uint64(_hash(_NUM))
    slots = np.where(numbers, found.slots | np.uint64(_IS_NUM), found.slots & ~np.uint64(_IS_NUM))
    slots = np.concatenate([slots, found.named & ~np.uint64(_IS_NUM)])
    spot = np.concatenate([spot, spot[found.other]])
    rows = pa.array(np.arange(len(row) + 1, dtype=np.int32) * WINDOW)
    place = places - begin[row] if bits is not None else spot[places] - spot[begin[row]]
    return pa.RecordBatch.from_arrays(
        [batch.column(name).take(pa.array(row)), batch.column("row").take(pa.array(row)), pa.array(size[row]), pa.array(place), pa.array(grams.view(np.int64)),
         pa.ListArray.from_arrays(rows, pa.array(slots[paths].view(np.int64).reshape(-1))),
         pa.ListArray.from_arrays(rows, pa.array((spot[paths] - spot[begin[row]][:, None]).reshape(-1)))],
        [name, "row", "size", "place", "gram", "slots", "spots"],
    )


def template_windows(texts: DataFrame, name: str, bits=None) -> DataFrame:
    """For each window of each text: its id and text hash, how many windows the text has, place, hash, slot values
    and places.  Without ``bits`` places leave out names that another reading takes in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            yield _window_rows(batch, name, bits.value if bits else None)

    kind = texts.schema[name].dataType.simpleString()
    rows = texts.select(name, "text", F.xxhash64("text").alias("row"))
    return rows.mapInArrow(run, f"{name} {kind}, row long, size long, place long, gram long, slots array<long>, spots array<long>")


def bit_map(windows: DataFrame) -> np.ndarray:
    """A bit for each hash prefix that occurs: 2^(MAP_BITS-3) bytes, so at most that many rows come to the driver."""
    top = F.shiftrightunsigned("gram", 64 - MAP_BITS)
    parts = windows.select(F.shiftright(top, 3).alias("byte"), F.call_function("shiftleft", F.lit(1), top.bitwiseAND(F.lit(7)).cast("int")).alias("bit"))
    found = parts.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    bits[found.column("byte").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return bits


def _chain(at: np.ndarray, place: np.ndarray, size: int, gap: int) -> np.ndarray:
    """Numbers of the hits in a longest passage: place and ``at`` rise, ``at`` by at most ``gap`` from one to the next.

    Hits are sorted by (at, place).  Of equally long passages the nearer one is continued.
    """
    length, last, ends = np.zeros(size, np.int64), np.full(size, -gap - 1, np.int64), np.full(size, -1, np.int64)
    back = np.full(len(at), -1, np.int64)
    best, best_end = 0, -1
    scale = int(at[-1]) + 2
    first = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at)).tolist()
    for lo, hi in zip(first, first[1:], strict=False):
        here, new = int(at[lo]), []
        score = np.where(last >= here - gap, length * scale + last, -1)
        for k in range(lo, hi):
            p, n = int(place[k]), 1
            if p:
                q = int(np.argmax(score[:p]))
                if score[q] > 0:
                    n, back[k] = int(length[q]) + 1, ends[q]
            new.append((p, n, k))
        for p, n, k in new:
            if n >= length[p] or last[p] < here - gap:
                length[p], last[p], ends[p] = n, here, k
            if n > best:
                best, best_end = n, k
    out = []
    while best_end >= 0:
        out.append(best_end)
        best_end = int(back[best_end])
    return np.array(out[::-1], np.int64)


def _agreeing(spots: np.ndarray, theirs: np.ndarray, ours: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Which hits fill the item's slots as most windows of the chain do; windows word for word always do.

    A name or unit is one slot wherever it stands; a number is a slot of its own at each place, as
    two quantities of an item may be equal by chance.
    """
    same = (theirs == ours).all(axis=1)
    theirs = np.where((theirs & _IS_NUM) != 0, spots + 1, theirs)
    votes: dict[int, dict[int, int]] = {}
    for t, o in zip(theirs[chain].reshape(-1).tolist(), ours[chain].reshape(-1).tolist(), strict=True):
        if t:
            votes.setdefault(t, {})[o] = votes.get(t, {}).get(o, 0) + 1
    filling = {t: max(found, key=found.get) for t, found in votes.items()}
    changed = np.flatnonzero(~same)
    agree = same.copy()
    agree[changed] = [all(not t or filling.get(t, o) == o for t, o in zip(ts, os, strict=True)) for ts, os in zip(theirs[changed].tolist(), ours[changed].tolist(), strict=True)]
    return agree


def _passage(at: np.ndarray, place: np.ndarray, theirs: np.ndarray, ours: np.ndarray, spots: np.ndarray, size: int, share: float) -> tuple[int, bool] | None:
    """How many windows of an item the text holds in one passage, and whether a slot is filled anew; None if too few."""
    gap, need = size + WINDOW - 1, share * size
    order = np.lexsort(((theirs != ours).sum(axis=1), place, at))
    at, place, theirs, ours, spots = at[order], place[order], theirs[order], ours[order], spots[order]
    once = np.append(True, (at[1:] != at[:-1]) | (place[1:] != place[:-1]))
    at, place, theirs, ours, spots = at[once], place[once], theirs[once], ours[once], spots[once]
    best = None
    cuts = np.append(0, np.append(np.flatnonzero(np.diff(at) > gap) + 1, len(at)))
    for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        left = np.arange(lo, hi)
        same = (theirs[left] == ours[left]).all(axis=1)
        if len(np.unique(place[left][same])) >= need:
            found = len(_chain(at[left][same], place[left][same], size, gap))
            if found >= need and (best is None or (found, False) >= (best[0], best[1])):
                best = (found, False)
        while len(np.unique(place[left])) >= need:  # each round tries one filling of the slots and takes its changed windows away
            a, p, t, o = at[left], place[left], theirs[left], ours[left]
            agree = np.flatnonzero(_agreeing(spots[left], t, o, _chain(a, p, size, gap)))
            tried = agree[_chain(a[agree], p[agree], size, gap)] if len(agree) else agree
            anew = (t[tried] != o[tried]).any(axis=1)
            if len(tried) >= need:
                if best is None or len(tried) > best[0]:
                    best = (len(tried), bool(anew.any()) and (best is None or best[1]))
                break
            if not anew.any():
                break
            left = np.delete(left, tried[anew])
    return best


def _judged(batches: Iterator[pa.RecordBatch], names: list[str], share: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document and item: for each pair that holds a passage, its ids, row key, share and changed."""
    def judge(group: pa.Table) -> tuple | None:
        n, size = group.num_rows, group.column("size")[0].as_py()
        place = group.column("place").to_numpy()
        if len(np.unique(place)) < share * size:
            return None
        slots = [group.column(c).combine_chunks().flatten().to_numpy().reshape(n, WINDOW) for c in ("theirs", "ours", "spots")]
        found = _passage(group.column("at").to_numpy(), place, *slots, size, share)
        return found and (group.column("doc_id")[0], group.column("row")[0], group.column("item_id")[0], found[0] / size, found[1])

    def rows(found: list, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 5
        kinds = [schema.field("doc_id").type, pa.int64(), schema.field("item_id").type, pa.float64(), pa.bool_()]
        values = [[x.as_py() if isinstance(x, pa.Scalar) else x for x in c] for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["doc_id", "row", "item_id", "share", "changed"])

    held, key, schema = [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        schema, out = batch.schema, []
        columns = [batch.column(n) for n in names]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            differ = pc.or_(pc.fill_null(pc.not_equal(c[1:], c[:-1]), False), pc.xor(pc.is_null(c[1:]), pc.is_null(c[:-1])))
            new[1:] |= differ.to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            mine = [c[lo].as_py() for c in columns]
            if held and mine != key:
                out.append(judge(pa.Table.from_batches(held)))
                held = []
            key = mine
            held.append(batch.slice(lo, hi - lo))
        yield rows([x for x in out if x], schema)
    if held:
        yield rows([x for x in [judge(pa.Table.from_batches(held))] if x], schema)


def leaked_rows(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, row (a hash of the text), item_id, share and changed of each row and item."""
    items = template_windows(benchmark.where(F.col("item_id").isNotNull()), "item_id").withColumnRenamed("slots", "theirs").withColumnRenamed("row", "item")
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(items))
    here = template_windows(docs, "doc_id", bits).select("doc_id", "row", F.col("place").alias("at"), "gram", F.col("slots").alias("ours"))
    names = ["doc_id", "row", "item_id", "item"]
    hits = here.join(items, "gram").drop("gram").repartition(*names).sortWithinPartitions(*names)
    kinds = [f"{n} {hits.schema[n].dataType.simpleString()}" for n in names[:3]]
    return hits.mapInArrow(lambda batches: _judged(batches, names, share), f"{', '.join(kinds)}, share double, changed boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, share of the item's windows found, changed (some slot value is another one)."""
    passages = leaked_rows(docs.where(F.col("doc_id").isNotNull()), benchmark, share)
    return passages.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.min("changed").alias("changed"))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows, with all their columns, into which no item has leaked; rows without a doc_id, or that share one, each by its own text."""
    found = leaked_rows(docs, benchmark, share).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__row")), "left_anti")
