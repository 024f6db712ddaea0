"""Rewriting: replacement tags, numbered tokens, the sanitized text and the vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditflow.functions.folds import CHUNK, bind, chunks
from auditflow.functions.text import computed_once, sql_name

MASK_MODES = ("synthetic", "redacted")
TOKEN = "struct<start:int,finding_ord:int,len:int,category:string,tag:string,token:string,original:string>"

# The tag for an entity type that contains one of the words; the
# first line that fits decides.
ENTITY_TAGS: tuple[tuple[tuple[str, ...], str], ...] = (
    (("Password", "Credential"), "PASSWORD"),
    (("Aadhaar",), "AADHAAR"),
    (("Passport",), "PASSPORT"),
    (("Voter", "EPIC"), "VOTER_ID"),
    (("Driving License", "DL"), "DRIVING_LICENSE"),
    (("Vehicle", "RC"), "VEHICLE_RC"),
    (("GSTIN", "GST"), "GSTIN"),
    (("TAN",), "TAN"),
    (("CIN",), "CIN"),
    (("DIN",), "DIN"),
    (("UAN", "EPFO"), "UAN"),
    (("Health", "ABHA"), "HEALTH_ID"),
    (("Ration",), "RATION_CARD"),
    (("Legal", "Case", "FIR"), "LEGAL_DOC"),
    (("Amount",), "AMOUNT"),
    (("Bank", "Account"), "ACCOUNT"),
    (("Beneficiary", "Payee"), "BENEFICIARY"),
    (("Name", "Transactor"), "CUSTOMER"),
    (("PAN",), "PAN_CARD"),
    (("Card",), "CARD"),
    (("UPI",), "UPI_ID"),
    (("IFSC",), "IFSC"),
    (("Phone",), "PHONE"),
    (("Email",), "EMAIL"),
    (("Key",), "API_KEY"),
)


def tag_of(f: str) -> str:
    """SQL for the tag of finding ``f``: from its bracketed suggestion, else from its type.

    A tag holds no brackets, so that a token ends at its first one and is found again.
    """
    suggested, entity = f"coalesce({f}.suggested_synthetic, '')", f"coalesce({f}.entity_type, '')"
    chain = " ".join(
        "WHEN " + " OR ".join(f"contains({entity}, '{w}')" for w in words) + f" THEN '{tag}'"
        for words, tag in ENTITY_TAGS)
    return (f"CASE WHEN startswith({suggested}, '[') AND endswith({suggested}, ']') "
            rf"THEN regexp_replace(regexp_replace({suggested}, r'[\[\]]+', ''), r'_[^_]*\z', '') "
            f"{chain} ELSE translate(coalesce({f}.category, 'PII'), '[]', '') END")


def _tokens(mask_mode: str, mode_col: str | None = None) -> Column:
    """``spans`` with their tokens; numbering is per tag, in text order."""
    if mode_col is not None:
        return F.when(F.col(mode_col) == "redacted", _tokens("redacted")).otherwise(_tokens("synthetic"))

    def token(name: str) -> str:
        return f"cast(struct(s.start, s.finding_ord, s.len, s.category, s.tag, {name}, s.original) as {TOKEN})"

    if mask_mode == "redacted":
        return F.expr(f"""transform(spans, s -> {token("concat('[', translate(s.category, '[]', ''), ']')")})""")
    numbered = token("concat('[', t, '_', i + 1, ']')")
    return F.expr("array_sort(flatten(transform(array_distinct(spans.tag), t -> "
                  f"transform(filter(spans, s -> s.tag = t), (s, i) -> {numbered}))))")


def _spliced(text_col: str) -> Column:
    """The text with each span replaced by its token.

    Reaching a position in a string costs its distance from the start, so the text
    is cut once per chunk of spans and the spans are replaced within that part.
    """
    text = sql_name(text_col)
    # `from`: where the part begins, the end of the span before the chunk.
    parts = f"transform({chunks('spans')}, (g, n) -> struct(g, coalesce(get(spans, n * {CHUNK} - 1).start + get(spans, n * {CHUNK} - 1).len, 0) as from))"
    before = "coalesce(get(k.g, i - 1).start + get(k.g, i - 1).len, k.from)"
    replaced = (f"array_join(transform(k.g, (s, i) -> concat(substring(part, {before} - k.from + 1, s.start - {before}), s.token)), '')")
    cut = f"substring({text}, k.from + 1, element_at(k.g, -1).start - k.from)"
    spliced = f"array_join(transform({parts}, k -> {bind(cut, 'part', replaced)}), '')"
    tail = f"substring({text}, element_at(spans, -1).start + element_at(spans, -1).len + 1, length({text}))"
    return F.expr(f"CASE WHEN size(spans) = 0 THEN {text} ELSE concat({spliced}, {tail}) END")


def with_sanitized(df: DataFrame, text_col: str = "text", mask_mode: str = "synthetic",
                   mode_col: str | None = None) -> DataFrame:
    """Replace ``spans`` by spans with tokens and add ``sanitized_text``.

    With ``mode_col`` the mode is that of each row.
    """
    if mask_mode not in MASK_MODES:
        raise ValueError(f"mask_mode must be one of {MASK_MODES}")
    kept = [c for c in df.columns if c != "spans"]
    tokens = df.select(*kept, _tokens(mask_mode, mode_col).alias("spans"))
    return tokens.select(*kept, computed_once(
        F.struct("spans", _spliced(text_col).alias("sanitized_text"))).alias("_s")
    ).select(*kept, "_s.spans", "_s.sanitized_text")


def vault_entries(spans: Column) -> Column:
    """``spans`` as vault entries, one per token, in order of first appearance.

    Tokens of the redacted mode repeat: the last value in text order is the one
    kept, so that mode cannot be restored exactly.
    """
    def entry(t: Column) -> Column:
        same = F.filter(spans, lambda s: s["token"] == t)
        return F.struct(
            t.alias("token"), F.element_at(same, -1)["original"].alias("original"),
            F.element_at(same, 1)["start"].alias("start"),
        )

    unique = F.transform(spans, lambda s: F.struct(
        s["token"].alias("token"), s["original"].alias("original"), s["start"].alias("start")))
    repeated = F.size(F.array_distinct(spans["token"])) < F.size(spans)
    return F.when(repeated, F.transform(F.array_distinct(spans["token"]), entry)).otherwise(unique)


def vault(audited: DataFrame, key: str = "doc_id", scope: Column | None = None,
          seq: Column | None = None) -> DataFrame:
    """The vault table of audited texts: ``scope, key, token, original, start, seq``."""
    entries = audited.select(
        (F.col(key).cast("string") if scope is None else scope).alias("scope"),
        key, (F.col(key) if seq is None else seq).alias("seq"),
        F.explode(vault_entries(F.col("spans"))).alias("e"),
    )
    return entries.select("scope", key, "e.token", "e.original", "e.start", "seq")
