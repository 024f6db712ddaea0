"""License scan with ordered signature rules.

A rule is a pattern over lower-case text with a label, a priority and a confidence.  The
rules come from a short table of licenses and from statement forms: an identifier line, a
grant by name, a name with a version, an address, a signature sentence.  A rule is tried only
where all its key words occur in the text, which the word hashes of a whole batch
tell at once.  A detection that lies inside another of the same or a higher priority is
dropped; so a license with a version wins over its bare name.

The base counts are places where a phrase's words stand one after another; their labels
always stay.

Defined cases: null and empty texts have no words and no labels; equal intervals of equal
priority go to the earlier rule; repeated rows give repeated results; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditflow.llm import text as T

#: What is no part of a word: ASCII but digits and small letters, after A-Z became small.
NO_WORD = np.zeros(256, bool)
NO_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Fixed base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, names, versions, host of the text.
LICENSES = (
    ("apache", ("apache license", "apache software license", "asl"), ("1.0", "1.1", "2.0"), "apache.org/licenses/license"),
    ("mit", ("mit license", "expat license", "mit/x11 license", "x11 license"), (), "opensource.org/licenses/mit"),
    ("gpl", ("gnu general public license", "gnu gpl", "gpl"), ("1", "2", "3"), "gnu.org/licenses/gpl"),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2", "2.1", "3"), "gnu.org/licenses/lgpl"),
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1", "3"), "gnu.org/licenses/agpl"),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1.1", "1.2", "1.3"), "gnu.org/licenses/fdl"),
    ("bsd", ("bsd license", "berkeley software distribution license"), ("2-clause", "3-clause", "4-clause"), "opensource.org/licenses/bsd"),
    ("mpl", ("mozilla public license", "mpl"), ("1.0", "1.1", "2.0"), "mozilla.org/mpl"),
    ("epl", ("eclipse public license", "epl"), ("1.0", "2.0"), "eclipse.org/legal/epl"),
    ("cddl", ("common development and distribution license", "cddl"), ("1.0", "1.1"), "opensource.org/licenses/cddl"),
    ("cpl", ("common public license",), ("1.0",), "opensource.org/licenses/cpl"),
    ("eupl", ("european union public licence", "european union public license", "eupl"), ("1.1", "1.2"), "joinup.ec.europa.eu/software/page/eupl"),
    ("isc", ("isc license",), (), "opensource.org/licenses/isc"),
    ("zlib", ("zlib license", "zlib/libpng license"), (), "opensource.org/licenses/zlib"),
    ("bsl", ("boost software license",), ("1.0",), "boost.org/license"),
    ("busl", ("business source license",), ("1.1",), "mariadb.com/bsl"),
    ("sspl", ("server side public license", "sspl"), ("1",), "mongodb.com/licensing/server-side-public-license"),
    ("artistic", ("artistic license",), ("1.0", "2.0"), "opensource.org/licenses/artistic"),
    ("unlicense", ("unlicense license", "the unlicense"), (), "unlicense.org"),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl"), ("2",), "wtfpl.net"),
    ("ofl", ("sil open font license", "open font license"), ("1.0", "1.1"), "scripts.sil.org/ofl"),
    ("psf", ("python software foundation license", "psf license"), ("2",), "docs.python.org/license"),
    ("php", ("php license",), ("3.0", "3.01"), "php.net/license"),
    ("postgresql", ("postgresql license",), (), "opensource.org/licenses/postgresql"),
    ("openssl", ("openssl license",), (), "openssl.org/source/license"),
    ("ncsa", ("university of illinois/ncsa open source license", "ncsa open source license"), (), "opensource.org/licenses/ncsa"),
    ("upl", ("universal permissive license",), ("1.0",), "opensource.org/licenses/upl"),
    ("ms-pl", ("microsoft public license",), (), "opensource.org/licenses/ms-pl"),
    ("ms-rl", ("microsoft reciprocal license",), (), "opensource.org/licenses/ms-rl"),
    ("afl", ("academic free license",), ("2.1", "3.0"), "opensource.org/licenses/afl"),
    ("osl", ("open software license",), ("2.1", "3.0"), "opensource.org/licenses/osl"),
    ("odbl", ("open database license", "odc open database license"), ("1.0",), "opendatacommons.org/licenses/odbl"),
    ("cc0", ("creative commons zero", "cc0"), ("1.0",), "creativecommons.org/publicdomain/zero"),
    ("cc-by", ("creative commons attribution license", "creative commons attribution", "cc by"), ("2.0", "2.5", "3.0", "4.0"), "creativecommons.org/licenses/by/"),
    ("cc-by-sa", ("creative commons attribution-sharealike", "creative commons attribution share alike", "cc by-sa"), ("2.0", "2.5", "3.0", "4.0"), "creativecommons.org/licenses/by-sa"),
    ("cc-by-nd", ("creative commons attribution-noderivatives", "creative commons attribution-noderivs", "cc by-nd"), ("2.0", "2.5", "3.0", "4.0"), "creativecommons.org/licenses/by-nd"),
    ("cc-by-nc", ("creative commons attribution-noncommercial", "creative commons attribution non-commercial", "cc by-nc"), ("2.0", "2.5", "3.0", "4.0"), "creativecommons.org/licenses/by-nc/"),
    ("cc-by-nc-sa", ("creative commons attribution-noncommercial-sharealike", "cc by-nc-sa"), ("2.0", "2.5", "3.0", "4.0"), "creativecommons.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", ("creative commons attribution-noncommercial-noderivs", "creative commons attribution-noncommercial-noderivatives", "cc by-nc-nd"), ("2.0", "2.5", "3.0", "4.0"), "creativecommons.org/licenses/by-nc-nd"),
)
#: Fixed signature sentences of license texts and notices.
SENTENCES = (
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", "neither the name of"),
    ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided 'as-is', without any express or implied warranty"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software; you can redistribute it and/or modify it"),
    ("gpl-or-later", "either version 3 of the license, or at your option any later version"),
    ("gpl-or-later", "either version 2 of the license, or at your option any later version"),
    ("bsl-1.0", "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("gpl-2", "gplv2"), ("gpl-3", "gplv3"), ("lgpl-2.1", "lgplv2.1"), ("lgpl-3", "lgplv3"), ("agpl-3", "agplv3"),
    ("bsd-2-clause", "bsd 2-clause"), ("bsd-3-clause", "bsd 3-clause"), ("mit", "mit licence"),
    ("public-domain", "dedicated to the public domain"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "this work is in the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized copying of this file"),
    ("copyright-notice", "copyright (c)"),
    ("no-warranty", "the software is provided as is, without warranty of any kind"),
)
#: Between two words of a pattern: signs or blanks, however many, as in wrapped and commented text.
_GAP = r"[^0-9a-z\x80-\U0010ffff]++"
_EDGE, _STOP = r"(?<![0-9a-z\x80-\U0010ffff])", r"(?![0-9a-z\x80-\U0010ffff])"
_VERSION = rf"(?:{_GAP}license)?{_GAP}(?:(?:version|ver|v)[^0-9a-z\x80-\U0010ffff]*+)?"
_GRANT = rf"(?:licensed|released|distributed|available|provided|published|redistributed){_GAP}(?:only{_GAP})?(?:under|using|with|according{_GAP}to)(?:{_GAP}the)?(?:{_GAP}terms{_GAP}of(?:{_GAP}the)?)?"
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


@dataclass(frozen=True)
class Rule:
    label: str
    source: str
    keys: tuple[str, ...]
    priority: int
    confidence: float

    @cached_property
    def pattern(self) -> re.Pattern:
        """Compiled when a text first has the key words."""
        return re.compile(self.source)


def _phrase(phrase: str) -> str:
    return _GAP.join(map(re.escape, _WORD.findall(phrase)))


def _number(version: str) -> str:
    return r"[^0-9a-z]{1,3}".join(map(re.escape, _WORD.findall(version.removesuffix(".0")))) + (r"(?:\.0)?" if version.endswith(".0") else "")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: the more telling a form, the higher its priority."""
    out: list[Rule] = []

    def add(label, pattern, keys, priority, confidence):
        out.append(Rule(label, _EDGE + pattern + _STOP, tuple(dict.fromkeys(keys)), priority, confidence))

    for label, sentence in SENTENCES:
        add(label, _phrase(sentence), _WORD.findall(sentence), 3, 0.6 if label in ("copyright-notice", "all-rights-reserved", "no-warranty") else 0.95)
    for label, names, versions, host in LICENSES:
        for version in versions:
            full = f"{label}-{version}"
            add(full, _GAP.join(("spdx", "license", "identifier", _phrase(full))), ("spdx", "identifier"), 5, 1.0)
            add(full, re.escape(host) + r"[^\s\"'<>]{0,12}?" + _number(version), _WORD.findall(host)[:2], 4, 0.95)
            for name in names:
                add(full, _phrase(name) + _VERSION + _number(version), _WORD.findall(name), 4, 0.95)
                add(full, _GRANT + _GAP + _phrase(name) + _VERSION + _number(version), _WORD.findall(name), 5, 1.0)
        add(label, _GAP.join(("spdx", "license", "identifier", _phrase(label))), ("spdx", "identifier"), 4, 0.95)
        add(label, re.escape(host), _WORD.findall(host)[:2], 2, 0.8)
        for name in names:
            add(label, _phrase(name), _WORD.findall(name), 1, 0.5 if " " not in name else 0.7)
            add(label, _GRANT + _GAP + _phrase(name), _WORD.findall(name), 3, 0.9)
    return tuple(out)


def detections(text: str, found: set[str] | None = None) -> list[tuple[int, int, Rule]]:
    """Surviving (start, end, rule) of a lower-case text, in page order."""
    found = set(_WORD.findall(text)) if found is None else found
    hits = []
    for order, rule in enumerate(rules()):
        if found.issuperset(rule.keys):
            hits += [(m.start(), -m.end(), -rule.priority, order, rule) for m in rule.pattern.finditer(text)]
    hits.sort(key=lambda h: h[:4])
    reach: dict[int, int] = {}  # priority -> the furthest end so far: all of these began no later
    out = []
    for start, end, priority, _, rule in hits:
        if not any(p >= -priority and furthest >= -end for p, furthest in reach.items()):
            out.append((start, -end, rule))
        reach[-priority] = max(reach.get(-priority, 0), -end)
    return out


def lower_ascii(text: str) -> str:
    return text.translate(_SMALL)


_SMALL = {c: c + 32 for c in range(0x41, 0x5B)}


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(T.word_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])


@lru_cache(maxsize=1)
def _gate() -> tuple[np.ndarray, list[str]]:
    """Hashes of all key words, sorted, and the words in that order."""
    words = sorted({k for r in rules() for k in r.keys}, key=_hash)
    return np.array([_hash(w) for w in words], np.uint64), words


@lru_cache(maxsize=1)
def _triggers() -> frozenset[str]:
    """A small set of key words of which every rule has one: its rarest, by a greedy choice."""
    common = frozenset("license licence public software free the of and to in is or a use with general source open common union".split())
    return frozenset(next((k for k in r.keys if k not in common), r.keys[0]) for r in rules())


def scan_batch(column: pa.Array) -> dict[str, np.ndarray | list]:
    data, offsets = T.utf8(column)
    data = T.LOWER[data]
    starts, ends, first = T.words(data, offsets, NO_WORD)
    hashes = T.word_hashes(data, starts, ends)
    rows, n = len(offsets) - 1, len(starts)
    raw = data.tobytes()
    n_base, low, high = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    base: list[set[str]] = [set() for _ in range(rows)]
    row_of, left = T.row_of(first), np.repeat(first[1:], np.diff(first))
    for phrase, label in BASE:
        parts = phrase.split()
        at = np.flatnonzero(hashes[: max(0, n - len(parts) + 1)] == np.uint64(_hash(parts[0])))
        for k, part in enumerate(parts[1:], 1):
            at = at[hashes[at + k] == np.uint64(_hash(part))]
        at = at[at + len(parts) <= left[at]]
        for place in at.tolist():
            if [raw[starts[place + k] : ends[place + k]].decode() for k in range(len(parts))] != parts:
                continue
            row = int(row_of[place])
            n_base[row] += 1
            low[row], high[row] = min(low[row], place - first[row]), max(high[row], place - first[row])
            base[row].add(label)
    keys, names = _gate()
    spot = np.searchsorted(keys, hashes)
    spot[spot == len(keys)] = 0
    hit = np.flatnonzero(keys[spot] == hashes)
    found: dict[int, set[str]] = {}
    for row, k in zip(row_of[hit].tolist(), spot[hit].tolist(), strict=True):
        found.setdefault(row, set()).add(names[k])
    labels = [set(b) for b in base]
    score = np.array([0.5 if b else 0.0 for b in base])
    for row, present in found.items():
        if present.isdisjoint(_triggers()):
            continue
        for _, _, rule in detections(raw[offsets[row] : offsets[row + 1]].decode(), present):
            labels[row].add(rule.label)
            score[row] = max(score[row], rule.confidence)
    return {"n_words": np.diff(first), "n_base": n_base, "first": low, "last": high, "base": base, "labels": labels, "score": score}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            x = scan_batch(batch.column("text"))
            none = x["n_base"] == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(x["n_words"]), pa.array(x["n_base"]), pa.array(x["first"], mask=none), pa.array(x["last"], mask=none),
                 pa.array([",".join(sorted(s)) for s in x["base"]], pa.string()), pa.array([",".join(sorted(s)) for s in x["labels"]], pa.string()), pa.array(x["score"])],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
