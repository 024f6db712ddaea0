"""Cheap tests that decide per text which patterns are worth evaluating.

Running every pattern of the catalogue over every text is what costs: the words
a keyword pattern starts with are absent from most texts, and so are the digit
groups a shape pattern needs.  One pass collects the word beginnings of a text, a
few linear probes look for digit groups and separators, and a pattern runs only
where its gate is open.  Every gate is *implied* by its pattern (a text with a
match always opens it), so gating changes the cost and never the result;
``tests/test_gates.py`` checks this on strings generated from the patterns.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditflow.functions.dialect import CASE_VARIANTS, SPACE
from auditflow.functions.text import sql_name, sql_strings, sql_text

PREFIX = 4  # letters kept of each word; gate words are cut to the same length


class Gate(NamedTuple):
    """Open where (a word begins with one of ``words`` or ``probe`` hits) and ``also`` hits.

    ``lead`` is the character class every match starts with: looking at one
    character first spares the word-boundary test at most positions of a text.
    ``then`` is looked at behind it where many words begin with such a character.
    A gate word of fewer than PREFIX letters stands for the complete word.
    """

    lead: str
    words: tuple[str, ...] = ()
    probe: str | None = None
    also: str | None = None
    then: str = ""


PROBES = {
    "digit_group": rf"\p{{Nd}}{{3}}[{SPACE}-]?\p{{Nd}}{{4}}",
    "six_digits": rf"[1-9]\p{{Nd}}[{SPACE}]?\p{{Nd}}{{4}}[1-9]",
    "code": r"[A-Z]{2}[ -]?[0-9]",
    "unit": rf"[0-9][{SPACE}]*[kKmMlLcCrRbBdDiIuUeE\u212a\u0130\u0131]",
    "currency": rf"[₹$€£][{SPACE}]*[0-9]",
    "comma_id": rf",[{SPACE}]*(?:[+0-9]|a?adhar|pa|pw|phone|mobile|email)",
    "mail": r"@[A-Za-z0-9.-]+\.[A-Z|a-z]{2}",
    "handle": r"@[a-zA-Z]{2}",
    "dotted": r"[0-9]\.[0-9]{1,3}\.[0-9]",
    "number_run": rf"[0-9{SPACE}-]{{10}}",
    "a_slash_c": r"[aA]/[cC]",
    "withdrew": r"[wW](?iu)ithdrew",
}
# What a probe cannot do without, tested first: a digit, a character, a word beginning.
_NEEDS_DIGIT = ("digit_group", "six_digits", "code", "unit", "currency", "dotted")
_NEEDS_CHARACTER = {"mail": "@", "handle": "@", "a_slash_c": "/", "comma_id": ","}
_NEEDS_WORD = {"withdrew": "with"}

_code = Gate("A-Z", probe="code")

# label -> one gate per pattern, in pattern order
GATES: dict[str, tuple[Gate, ...]] = {
    "Password / Credential": (
        Gate("pstc", ("pass", "pwd", "pwdi", "pw", "pwis", "secr", "toke", "cred")),
        Gate("pocs", ("pin", "pini", "otp", "otpi", "cvv", "cvvi", "secu")),
    ),
    "Aadhaar Number": (
        Gate("au", ("aadh", "aaha", "aahr", "uida", "adha"), also="number_run"),
        Gate("2-9", probe="digit_group"),
        Gate("2-9", probe="digit_group"),
    ),
    "PAN Card Number": (_code, Gate("p", ("pan", "panc", "pann", "pani"))),
    "Indian Passport Number": (Gate("p", ("pass",)), Gate("A-PR-WYa-pr-wy", probe="six_digits", then="[1-9]")),
    "Voter ID / EPIC Card": (_code, Gate("ve", ("vote", "epic", "elec"))),
    "Driving License (DL)": (Gate("dl", ("driv", "dl", "dlno", "lice")), _code, _code),
    "Vehicle Registration / RC": (
        Gate("rvcb", ("rc", "rcno", "vehi", "car", "carn", "bike", "reg", "regi", "regn")),
        _code,
    ),
    "GSTIN / GST Number": (Gate("0-9", probe="code", then="[0-9][A-Z]"), Gate("g", ("gst", "gsti", "gstn"))),
    "TAN (Tax Deduction Number)": (Gate("t", ("tan", "tann", "tani")), _code),
    "CIN (Corporate Identity No)": (Gate("UL", probe="code"),),
    "DIN (Director Identity No)": (Gate("d", ("din", "dinn", "dini")),),
    "EPFO / UAN / PF Account": (Gate("uep", ("uan", "uann", "uani", "epf", "epfn", "epfi", "pf", "pfac")),),
    "ABHA / Health ID / PMJAY": (Gate("0-9", probe="digit_group"), Gate("aph", ("abha", "pmja", "heal"), also="number_run")),
    "Ration Card Number": (Gate("r", ("rati",)),),
    "Legal Court Case / FIR / Property Deed": (
        Gate("fcrdksp", ("fir", "firn", "case", "crim", "regi", "deed", "khas", "khat", "surv", "prop", "plot")),
    ),
    "Financial Amount": (
        Gate("0-9", probe="unit"),
        Gate("riueg₹$€£", ("rs", "inr", "usd", "eur", "gbp"), probe="currency",
             then="(?:[snubSNUBſ]|(?<=[₹$€£]))"),
        Gate("abstpfc", ("amou", "amt", "amti", "amto", "bala", "bal", "bali", "balo", "sala", "tran", "paid",
              "fee", "feei", "feeo", "cost", "pric", "payo", "sum", "sumi", "sumo")),
    ),
    "Bank Account & Bank Reference": (
        Gate("hisapbkcyw", ("hdfc", "icic", "sbi", "axis", "pnb", "bob", "kota", "cana", "yes", "yesb", "indu",
              "idfc", "citi", "hsbc", "barc", "chas", "well")),
        Gate("ab", ("acc", "acct", "acco", "accn", "acci", "bank"), probe="a_slash_c"),
        Gate("tcdb", ("tran", "cred", "debi", "bank")),
    ),
    "Account Holder / Beneficiary": (Gate("bpah", ("bene", "paye", "acc", "acch", "acco", "hold")),),
    "Customer / Transactor / Person Name": (
        Gate("a-z", ("tran", "sent", "send", "paid", "paye", "rece", "reci", "depo", "debi", "cred",
              "swip", "borr", "lent"), probe="withdrew"),
        Gate("tsprcd", ("tran", "sent", "paid", "rece", "cred", "debi")),
        Gate("ncupemd", ("name", "cust", "clie", "user", "pati", "emp", "empl", "mr", "mrs", "ms", "dr")),
        Gate("A-Z", probe="comma_id"),
        Gate("RVPSANDMKGHJBE", ("raje", "rahu", "vikr", "priy", "sneh", "amit", "sure", "rame", "roha", "pooj", "neha",
              "anan", "deep", "mano", "kavi", "suni", "anil", "sanj", "ajay", "alok", "nave", "alka",
              "gaur", "sach", "mani", "hars", "dev", "ravi", "john", "jane", "alic", "bob", "davi",
              "mich", "sara", "emma")),
    ),
    "Credit / Debit Card": (Gate(r"\p{Nd}", probe="digit_group"), Gate("c", ("card", "cc", "ccno", "ccnu"), also="number_run")),
    "Email Address": (Gate("A-Za-z0-9._%+-", probe="mail"),),
    "Phone Number": (
        Gate(r"+(\p{Nd}", probe="digit_group"),
        Gate("mpc", ("mob", "mobi", "mobn", "phon", "ph", "phno", "phnu", "cont"), also="number_run"),
    ),
    "UPI ID / VPA": (Gate("a-zA-Z0-9._-", probe="handle"),),
    "AWS Access Key": (Gate("A", ("akia", "asia")),),
    "Generic API / Secret Key": (Gate("sgxeA", ("sk", "ghp", "gho", "xoxb", "eyjh", "aiza")),),
    "IPv4 Address": (Gate("0-9", probe="dotted"),),
    "Indian IFSC Code": (_code,),
}

# The letters outside ASCII that equal an ASCII letter when case is ignored.
_FOLDED = "ſKİı"
_FOLDS_TO = "skii"


def folded(text: str) -> str:
    """Lower case, with the four non-ASCII case variants of s, k and i folded too."""
    special = " OR ".join(f"contains({text}, {sql_text(c)})" for c in _FOLDED)
    return (f"CASE WHEN {special} THEN lower(translate({text}, {sql_text(_FOLDED)}, {sql_text(_FOLDS_TO)})) "
            f"ELSE lower({text}) END")


def word_beginnings(text: str, words: tuple[str, ...]) -> str:
    """Which of ``words`` occur as the first PREFIX letters of a word of ``text``.

    The result is one short string, each word between blanks, which the gates search.
    """
    regex = sql_text(rf"([a-z]{{1,{PREFIX}}})[a-z]*+")
    listed = ", ".join(sql_text(w) for w in words)
    # A constant set: array_intersect would hash all the words anew for every text.
    present = f"filter(array_distinct(regexp_extract_all({folded(text)}, {regex}, 1)), w -> w IN ({listed}))" if words else sql_strings(())
    return f"concat(' ', array_join({present}, ' '), ' ')"


def has_word(words: tuple[str, ...] | list[str]) -> str:
    return f"_words RLIKE ' (?:{'|'.join(words)}) '"


def with_gates(df: DataFrame, text_col: str, gates: list[Gate | None]) -> DataFrame:
    """Add ``_words`` and one boolean ``_p_<probe>`` per probe used by ``gates``."""
    text, used = sql_name(text_col), [g for g in gates if g is not None]
    if not used:
        return df
    probes = sorted({p for g in used for p in (g.probe, g.also) if p})
    words = {w for g in used for w in g.words} | {w for p, w in _NEEDS_WORD.items() if p in probes}
    df = df.withColumns({
        "_digit": F.expr(rf"{text} RLIKE r'\p{{Nd}}'"),
        "_words": F.expr(word_beginnings(text, tuple(sorted(words))))})
    return df.withColumns({f"_p_{p}": F.expr(_probe(p, text, used)) for p in probes})


def _probe(probe: str, text: str, gates: list[Gate]) -> str:
    hit = f"{text} RLIKE {sql_text(PROBES[probe])}"
    if probe in _NEEDS_DIGIT:
        return f"_digit AND {hit}"
    if probe in _NEEDS_CHARACTER:
        return f"contains({text}, '{_NEEDS_CHARACTER[probe]}') AND {hit}"
    if probe in _NEEDS_WORD:
        return f"contains(_words, ' {_NEEDS_WORD[probe]} ') AND {hit}"
    if all(probe != g.probe for g in gates):  # only ever asked for together with a word
        words = sorted({w for g in gates if g.also == probe for w in g.words})
        return f"{has_word(words)} AND {hit}"
    return hit


def is_open(gate: Gate | None) -> str:
    """The condition under which the gate is open, over the columns of :func:`with_gates`."""
    if gate is None:
        return "true"
    hits = [f"_p_{gate.probe}"] if gate.probe else []
    if gate.words:
        hits.append(has_word(gate.words))
    opened = f"({' OR '.join(hits)})"
    return f"{opened} AND _p_{gate.also}" if gate.also else opened
