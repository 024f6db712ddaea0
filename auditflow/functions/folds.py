"""Folds that build an array, without copying the whole array at every step.

Appending to an array copies it, so a plain fold over n spans costs n² copies: a
text with a hundred thousand values would never finish.  Here the items are cut
into chunks, a chunk is folded into an array of its own, and the chunks are joined
once at the end.
"""

from __future__ import annotations

CHUNK = 256


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def chunks(items: str) -> str:
    """``items`` cut into arrays of CHUNK; one chunk, possibly empty, if they fit."""
    return (f"CASE WHEN size({items}) <= {CHUNK} THEN array({items}) ELSE transform("
            f"sequence(0, (size({items}) - 1) div {CHUNK}), c -> slice({items}, cast(c * {CHUNK} + 1 as int), {CHUNK})) END")


def fold(items: str, element: str, step: str) -> str:
    """Fold ``items`` into an array of ``element``.

    ``step`` maps the state ``a`` (``pos``, an int from 0, and ``out``) and the item
    ``x`` to the next state.
    """
    inner = f"aggregate(chunk, named_struct('pos', acc.pos, 'out', cast(array() as array<{element}>)), (a, x) -> {step})"
    joined = bind(inner, "r", "named_struct('pos', r.pos, 'out', concat(acc.out, array(r.out)))")
    return (f"aggregate({chunks(items)}, named_struct('pos', 0, 'out', cast(array() as array<array<{element}>>)), "
            f"(acc, chunk) -> {joined}, acc -> flatten(acc.out))")
