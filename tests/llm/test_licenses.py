import re

import pyarrow as pa
import pytest
from cases import TEXTS, by_id, docs

from auditflow.llm import licenses
from auditflow.llm import queries as Q

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
EXTRA = ["MIT License. mit-license, the MIT\nLicense", "GENERAL PUBLIC LICENSE general public public license", "mit", "license mit", "Apache License apache license éapache license"]


def brute(text):
    words = WORDS.findall((text or "").translate(licenses._SMALL))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark):
    texts = [*TEXTS, *EXTRA]
    found = by_id(licenses.scan(docs(spark, texts)), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert found == {k: brute(t) for k, t in enumerate(texts)}
    assert licenses.scan(docs(spark, [])).count() == 0


def test_query(spark):
    found = Q.QUERIES["op7_licenses"](spark, SF)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert by_id(found, "n_words", "n_base", "first_word", "last_word", "base_labels") == {k: brute(t) for k, t in texts.items()}
    for r in found.collect():
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(labels)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)


@pytest.mark.parametrize("text, label", [
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("Released under the Apache License,\n * Version 2.0", "apache-2.0"), ("SPDX-License-Identifier: GPL-3", "gpl-3"),
    ("see https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3"), ("Redistribution and use in source and binary forms, with or without\n# modification, are permitted", "bsd"),
    ("under the GNU Lesser General Public License, version 2.1", "lgpl-2.1"), ("All rights reserved.", "all-rights-reserved"), ("a Boost Software License note", "bsl"),
])
def test_signatures(text, label):
    assert label in {r.label for _, _, r in licenses.detections(licenses.lower_ascii(text))}


def test_containment():
    found = licenses.detections("licensed under the gnu general public license, version 3. mit license")
    assert [r.label for _, _, r in found] == ["gpl-3", "mit"]


def test_gate_loses_nothing():
    """Rules without the prefilter give the same labels."""
    texts = [t for t in [*TEXTS[:11], *EXTRA] if t] + ["GPLv3", "mozilla public license v2.0 and more", "PHP License 3.01", "nothing licensed"]
    got = licenses.scan_batch(pa.array(texts))["labels"]
    for text, labels in zip(texts, got, strict=True):
        low = licenses.lower_ascii(text)
        hit = [r for r in licenses.rules() if r.pattern.search(low)]
        assert all(set(r.keys) <= set(licenses._WORD.findall(low)) for r in hit)
        assert labels - set(PHRASES.values()) <= {r.label for r in hit} and (labels or not hit)
    assert len(licenses.rules()) >= 300


def test_long_runs_stay_linear():
    text = "licensed under " + " " * 50_000 + "license version " * 20_000
    assert licenses.detections(text) == []


@pytest.mark.parametrize("blanks", [1, 20, 30, 1000, 100_000])
def test_a_gap_has_no_limit(blanks):
    """A notice wrapped in comments is found however far its words stand apart."""
    gap = "\n//" + " " * blanks
    for words, label in [("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("licensed under the Apache License, Version 2.0", "apache-2.0")]:
        found = {r.label for _, _, r in licenses.detections(licenses.lower_ascii(words.replace(" ", gap)))}
        one = {r.label for _, _, r in licenses.detections(licenses.lower_ascii(words))}
        assert label in found and found == one


def test_repeated_wide_gaps_stay_linear():
    text = ("licensed" + " " * 500 + "under" + " " * 500) * 2000
    assert licenses.detections(text) == []
