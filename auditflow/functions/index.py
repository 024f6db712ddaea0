"""Look-ups inside one row: binary search in a sorted array, and an index of a text's windows.

Spark's maps are searched from the front, so a look-up per value in a row with many
values costs their square.  Arrays are reached by position at once: sorted, they are an index.
"""

from __future__ import annotations

from auditflow.functions.folds import bind

WINDOW = 40
SEGMENT = 1 << 20
_PART, _BLOCK = 1 << 15, 128


def below(array: str, test: str) -> str:
    """How many elements of ``array`` pass ``test`` of ``x``; sorted as they are, these stand in front."""
    middle = "cast((s.lo + s.hi) div 2 as int)"
    passes = bind(f"get({array}, {middle})", "x", test)
    step = (f"CASE WHEN s.lo >= s.hi THEN s WHEN {passes} THEN named_struct('lo', {middle} + 1, 'hi', s.hi) "
            f"ELSE named_struct('lo', s.lo, 'hi', {middle}) END")
    rounds = f"sequence(1, cast(ceil(log2(size({array}) + 2)) as int) + 1)"
    return f"aggregate({rounds}, named_struct('lo', 0, 'hi', size({array})), (s, i) -> {step}, s -> s.lo)"


def windows(text: str) -> str:
    """All windows of WINDOW signs of ``text`` (shorter at its end) as sorted arrays of (w, pos), an array per SEGMENT of places.

    Reaching a place in a string costs its distance from the start, so the text is cut into
    parts, and these into blocks, that hold the beginnings of their windows.
    """
    def cut(whole: str, size: str, by: int, body: str, part: str, at: str) -> str:
        """``body`` for each piece ``part`` of ``whole`` that holds ``by`` of its ``size`` places, the first of them ``at``."""
        piece = bind(f"substring({whole}, {at} + 1, {by + WINDOW - 1})", part, body)
        return f"transform(sequence(0, {size} - 1, {by}), {at} -> {piece})"

    window = f"named_struct('w', substring(block, j, {WINDOW}), 'pos', segment_at + part_at + block_at + j - 1)"
    in_block = f"transform(sequence(1, least({_BLOCK}, length(block))), j -> {window})"
    in_part = cut("part", f"least({_PART}, length(part))", _BLOCK, in_block, "block", "block_at")
    in_segment = cut("segment", f"least({SEGMENT}, length(segment))", _PART, in_part, "part", "part_at")
    every = cut(text, f"length({text})", SEGMENT, f"array_sort(flatten(flatten({in_segment})))", "segment", "segment_at")
    return f"CASE WHEN length({text}) = 0 THEN cast(array() as array<array<struct<w:string,pos:int>>>) ELSE {every} END"


def places(index: str, value: str) -> str:
    """The ascending places of ``value`` (at most WINDOW signs) in the text of ``index``."""
    low, high = below("seg", f"x.w < {value}"), below("seg", f"substring(x.w, 1, length({value})) <= {value}")
    hits = bind(low, "low", f"slice(seg, low + 1, {high} - low)")
    return f"array_sort(flatten(transform({index}, seg -> transform({hits}, h -> h.pos))))"
