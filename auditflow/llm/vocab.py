"""Public tokenizer files, read on the executor that uses them; and a bounded memory."""

from __future__ import annotations

import os
from functools import lru_cache
from typing import Any

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def content(path: str) -> dict:
    import json

    with open(path, encoding="utf-8") as f:
        return json.load(f)


def merges(path: str) -> list[tuple[str, str]]:
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in content(path)["model"]["merges"]]


def special_strings(path: str) -> list[str]:
    return [t["content"] for t in content(path)["added_tokens"]]


class Memory:
    """What was worked out before, in two generations: the older goes when the newer is full, so size is bounded."""

    def __init__(self, limit: int):
        self.limit, self.size, self.new, self.old = limit, 0, {}, {}

    def get(self, key: Any) -> Any:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: Any, value: Any, size: int = 1) -> None:
        if self.size + size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = value
        self.size += size
