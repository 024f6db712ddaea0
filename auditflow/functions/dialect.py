"""Catalogue patterns in the ``java.util.regex`` notation that Spark evaluates.

The shorthand classes are spelled out instead of using ``(?U)``: Java's own
Unicode classes count combining marks as word characters and leave the
separator controls U+001C-U+001F out of ``\\s``, and the meaning of ``\\b`` has
changed between Java versions.  Spelled out, a pattern means the same everywhere.
"""

from __future__ import annotations

import re

SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
# A look-behind steps back one UTF-16 unit, and so misreads a letter outside the
# basic plane, unless a character from there is written in it: hence the (redundant) 𝐀.
_BEHIND = WORD + "𝐀"
_BOUNDARY = rf"(?:(?<![{_BEHIND}])(?=[{WORD}])|(?<=[{_BEHIND}])(?![{WORD}]))"

_ONLY_WORD = re.compile(r"(?:[A-Za-z0-9](?:-[A-Za-z0-9])?|\\p\{Nd\})+")

# The letters outside ASCII that equal an ASCII letter when case is ignored.
CASE_VARIANTS = {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131"}

STRIP_REGEX = rf"^[{SPACE}]+|[{SPACE}]+\z"


# Java repeats a group of varying length by recursion: a long list of numbers after a
# currency sign would overflow the stack and take the executor down.  A group that
# ends an amount covers a whole run of digits, so the groups are fixed from the start
# and can be taken possessively; only the last one may have to be given back, where
# the amount then ends at its comma.
_GROUPS = r"(?:,[0-9]{2,3})*"
_GROUP = r",[0-9]{2,3}(?![0-9])"


def _without_recursion(pattern: str) -> str:
    if _GROUPS not in pattern:
        return pattern
    head, tail = pattern.split(_GROUPS)
    end = r")\b"
    if not tail.endswith(end):
        raise ValueError(f"cannot bound the repetition in {pattern!r}")
    tail = tail.removesuffix(end)
    return rf"{head}(?:(?:{_GROUP})*+{tail}\b|(?:,[0-9]{{2,3}}(?={_GROUP}))*+\b))"


# A separator with three places for blanks splits one run of them in quadratically many ways.
# Here a run is taken in one way only: up to the sign or word inside it possessively, and
# behind that as far as the value cannot begin earlier.
_SEPARATORS = (
    (re.compile(r"\\s\*\(\?:is\\s\*\|\[:=\]\\s\*\|\\s\+\)(?=\()"), lambda m: r"is|[:=]", True),
    (re.compile(r"\\s\*\(\?:((?:[^()\\]|\\\.|\(\?:ber\)\?)+)\|\\s\+\)\\s\*(?=\()"), lambda m: m[1], True),
    (re.compile(r"\\s\*\(\?:([a-z|.?\\]+)\)\?\\s\*\[:=\]\?\\s\*(?=\()"), lambda m: m[1], False),
    (re.compile(r"\\s\*\[:=\]\?\\s\*(?=\()"), None, False),
)
# A value that may hold blanks, and at most how many characters.
_BLANK_VALUE = re.compile(r"\((?:\\\+\?)?\[[^\]]*\\s[^\]]*\]\{\d+,(\d+)\}\)")


def _single_blank_runs(pattern: str) -> str:
    """``pattern`` with separators that take a run of blanks in one way, with the same matches.

    A value that cannot hold a blank begins at the first other character.  One that can
    may take blanks in front of its first other character, nearest ones first, but no more
    than its length: so all further blanks are passed possessively.
    """
    for form, inside, needed in _SEPARATORS:
        m = form.search(pattern)
        if m is None:
            continue
        head, value = pattern[: m.start()], pattern[m.end() :]
        blank = _BLANK_VALUE.match(value)
        run = rf"(?:\s(?=\s{{{blank[1]}}}))*+\s*" if blank else r"\s*+"
        if needed:  # a word or sign, else a blank at least
            separator = rf"(?:\s*+(?:{inside(m)}){run}|\s{run})"
        else:  # words and signs may both be missing
            sign = rf"\s*+[:=]{run}"
            word = "" if inside is None else rf"\s*+(?:{inside(m)})(?:{sign}|{run})|"
            separator = rf"(?:{word}{sign}|{run})"
        return head + separator + value
    return pattern


def _either_case(lead: str) -> str:
    """``lead`` for both cases, written out: a plain class is tested faster than a folded one."""
    folded = lead + lead.upper() + "".join(v for c, v in CASE_VARIANTS.items() if c in lead)
    return folded + "".join(CASE_VARIANTS.values()) if "a-z" in lead else folded


# A run of a class up to ``@``, of any length or of at most so many characters.
_RUN_TO_AT = re.compile(r"\\b(\[([^\]@]+)\])(\+|\{\d+,(\d+)\})(@.*)")
# A word before one of several words.
_WORD_BEFORE = re.compile(r"\(\?i\)\\b(\(\[a-z\]\{\d+,\d+\})\)\\s\+(\(\?:([a-z|]+)\)\\b)")


def skipping_runs(pattern: str, group: int) -> tuple[str, int]:
    """``pattern`` and its group, made linear for patterns that begin with a run.

    A loop passes over all text up to the next run with the right sign or letter behind it, so that the
    pattern is tried there only.  Where it fails, the part of the run that holds no further
    start is taken with an empty group 1 (too short to be a value), and so is the end of the text.
    """
    m = _RUN_TO_AT.fullmatch(pattern) if group == 0 else None
    if m is not None:
        run, inside, times, most, rest = m.groups()
        # A run of any length fails from all starts if from one; else a start is near enough to the sign.
        failed = rf"\b{run}++" if most is None else rf"{run}+(?={run}{{{most}}}@)|{run}(?:(?!\b){run})*+"
        return (rf"(?:[^@{inside}]+|{run}+(?![@{inside}])|@)*+"
                rf"(?:(\b{run}{times}+{rest})|{failed}|(?:(?!\b){run})++|\z)"), 1
    m = _WORD_BEFORE.fullmatch(pattern) if group == 1 else None
    if m is not None:
        word, behind, words = m.groups()
        letters, first = _either_case("a-z"), _either_case("".join(sorted({w[0] for w in words.split("|")})))
        return (rf"(?i)(?:[^{letters}]+|[{letters}]++(?!\s++[{first}]))*+"
                rf"(?:\b{word}+)\s++{behind}|[{letters}]++|\z)"), 1
    return pattern, group


# An amount's digits before a unit: nothing that follows them begins with a digit, a point or a blank.
_AMOUNT = (r"([0-9]+(?:\.[0-9]+)?\s*(?:k|", r"([0-9]++(?:\.[0-9]++)?+\s*+(?:k|")


def _has_choice(pattern: str) -> bool:
    """Whether ``pattern`` is a choice outside all groups."""
    depth, bare = 0, re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
    for ch in bare:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            return True
    return False


def java_regex(pattern: str, lead: str | None = None, then: str = "") -> str:
    """``pattern`` with Unicode ``\\b \\s \\d`` and case folding made explicit.

    With ``lead``, the character class every match starts with, that one character
    is looked at before the word boundary, and ``then``, what follows it in every match.
    """
    out, in_class, i = [], False, 0
    fold = pattern.startswith("(?i)")
    pattern = _single_blank_runs(_without_recursion(pattern[4:] if fold else pattern)).replace(*_AMOUNT)
    if lead is not None:
        out.append(f"(?=[{_either_case(lead) if fold else lead}]{then})")
        if _has_choice(pattern):  # else only the first form would be spared
            pattern = f"(?:{pattern})"
    out.append("(?iu)" if fold else "")
    if lead is not None and pattern.startswith(r"\b") and _ONLY_WORD.fullmatch(lead):
        out.append(rf"(?<![{_BEHIND}])")
        i = 2
    while i < len(pattern):
        pair, ch = pattern[i : i + 2], pattern[i]
        if ch == "\\":
            if pair == r"\s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif pair == r"\d":
                out.append(r"\p{Nd}")
            elif pair == r"\b":
                out.append(_BOUNDARY)
            else:
                out.append(pair)
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(r"\z" if ch == "$" and not in_class else ch)
        i += 1
    return "".join(out)
