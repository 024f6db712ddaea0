"""JSON as strict parsers read it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditflow.functions.text import strip

STRICT = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}


def is_json(col: Column) -> Column:
    """Whether ``col`` is one JSON value and nothing behind it.

    ``from_json`` stops reading behind the first value.  So the text is read as the only
    member of an object and as the only item of an array: what follows it breaks one of them.
    """
    member = F.from_json(F.concat(F.lit('{"v":'), col, F.lit("}")), "v string, _bad string", STRICT)
    items = F.from_json(F.concat(F.lit("["), col, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})
    return F.coalesce(member.isNotNull() & member["_bad"].isNull() & (F.size(items) == 1), F.lit(False))


def is_object(col: Column) -> Column:
    """Whether ``col`` is one JSON object and nothing behind it."""
    return F.coalesce(strip(col).startswith("{"), F.lit(False)) & is_json(col)


def truthy(body: Column, field: str) -> Column:
    """Whether a field of a JSON object counts as true: not null, false, zero or empty."""
    value = F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant")
    kind, text = F.schema_of_variant(value), value.cast("string")
    number = F.coalesce(text.try_cast("double") != 0, F.lit(False))
    return F.coalesce(
        F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true").when(kind == "VOID", False)
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}")).otherwise(number), F.lit(False))
