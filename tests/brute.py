"""The expected result of a text, worked out one text at a time with Python's ``re``."""

import re
from collections import Counter

from auditflow.rules import RULES

COMPILED = [(rule, re.compile(regex)) for rule in RULES for regex in rule.patterns]


def values(text, only=None):
    """(rule, value) in the order in which the values are first found."""
    first = {}
    for rule, regex in COMPILED:
        if only is not None and rule.label != only:
            continue
        for m in regex.finditer(text):
            value = m.group(min(1, regex.groups)).strip()
            if len(value) >= 2:
                first.setdefault(value, rule)
    return [(rule, value) for value, rule in first.items()]


def spans(text, quotes):
    """Kept (start, quote index): leftmost first, ties to the earlier quote."""
    every = sorted((m.start(), i) for i, q in enumerate(quotes) for m in re.finditer(re.escape(q), text))
    kept, end = [], 0
    for start, i in every:
        if start >= end:
            kept.append((start, i))
            end = start + len(quotes[i])
    return kept


def sanitized(text):
    found = values(text)
    quotes = [v for _, v in found]
    out, end, seen = [], 0, Counter()
    for start, i in spans(text, quotes):
        tag = found[i][0].prefix
        seen[tag] += 1
        out += [text[end:start], f"[{tag}_{seen[tag]}]"]
        end = start + len(quotes[i])
    return "".join(out) + text[end:]
