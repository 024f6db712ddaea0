"""Small text expressions shared by the operators (all native Spark columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditflow.functions.dialect import STRIP_REGEX


def strip(col: Column) -> Column:
    """Drop Unicode white space at both ends; ``trim`` would drop spaces only."""
    return F.regexp_replace(col, F.lit(STRIP_REGEX), F.lit(""))


def sql_text(value: str) -> str:
    """``value`` as a SQL string literal without escapes."""
    if "'" in value:
        raise ValueError("a raw literal cannot hold a single quote")
    return f"r'{value}'"


def sql_name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def sql_strings(values: tuple[str, ...] | list[str]) -> str:
    """``values`` as a SQL array of strings."""
    return f"cast(array({', '.join(sql_text(v) for v in values)}) as array<string>)"


def replace_tokens(text: Column, entries: Column) -> Column:
    """Apply ``entries`` (array of structs ``token, original``) one after the other.

    The replacement is sequential: a token inside a value restored earlier is
    replaced as well when its entry comes later.
    """
    return F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["token"], e["original"]))


def escape_html(col: Column) -> Column:
    """Escape ``& < > "``, ampersand first."""
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(raw), F.lit(escaped))
    return F.coalesce(col, F.lit(""))


def computed_once(col: Column) -> Column:
    """``col`` behind a one-row generator.

    A filter on a projected column is pushed below the projection as a second
    copy of its expression.  It is not pushed through a generator, so an
    expensive column is evaluated once however it is filtered later.
    """
    return F.explode(F.array(col))


def contains_any(col: Column, words: tuple[str, ...]) -> Column:
    """True where ``col`` contains one of the literal ``words``."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(col, F.lit(word))
    return hit
