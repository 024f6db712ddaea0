"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text is normalised (A-Z become a-z) and cut where its own signs say so: behind the first
sign of a fixed set that stands at least MIN_CHUNK signs after the last cut, at MAX_CHUNK
signs at the latest.  Texts that share a passage so share its chunks, wherever it stands.

1. *Chunks to identifiers.*  A chunk's identifier is a pair of 64-bit hashes.  The distinct
   (identifier, chunk) pairs are gathered, copies being dropped in the map tasks before
   anything is shuffled; if one identifier stands for two chunks, all are drawn anew with
   further bits and another seed.  So equal identifiers are known to mean equal chunks.
2. *Recipes.*  A document becomes the ordered list of its identifiers, 16 bytes a chunk.
   Only lists are grouped, compared and joined; a text's signs travel once, in step 1.

The largest doc_id and the size of a group are partial aggregates, so a group that holds a
third of all rows meets as one row per map task.  Groups of one row are not kept; what
the others say is joined to the written recipes, a join that adaptive execution can
broadcast or split.

Defined cases: null text counts as empty, and empty texts are equal; a null doc_id is less
than any other; of rows that also share their doc_id one stays; a long text is a longer list;
an empty table gives no rows; further columns are not read.  Signs of invalid UTF-8 compare
as the replacement sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditflow.functions import lineage

MIN_CHUNK, MAX_CHUNK = 512, 4096
BITS = 128
#: The signs behind which a chunk may end: letters that are rare in most languages, digits and marks.  All
#: are ASCII, since a class with further signs costs ten times as much; texts without any are cut at MAX_CHUNK.
_CUT = r'jqxz0-9\n?!:;()"'
_CHUNK = rf"(?s).{{{MIN_CHUNK}}}[^{_CUT}]{{0,{MAX_CHUNK - MIN_CHUNK - 1}}}+.?|.{{1,{MAX_CHUNK}}}"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """``text`` with A-Z, and no other sign, in lower case; null is empty."""
    text = F.coalesce(text, F.lit(""))
    is_ascii = F.length(text) == F.octet_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def chunks(text: Column) -> Column:
    """The chunks of a normalised text in order; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(_CHUNK), F.lit(0))


def identifier(chunk: Column, bits: int, seed: int) -> list[Column]:
    """``bits`` (at most 128) of a chunk's hash as one or two numbers."""
    parts = []
    for k in range(0, bits, 64):
        whole = F.xxhash64(F.lit(seed + k), chunk)
        parts.append(whole if bits - k >= 64 else F.shiftrightunsigned(whole, 64 - (bits - k)))
    return parts


def _verified(texts: DataFrame, bits: int, seed: int) -> bool:
    """Whether each identifier stands for one chunk only."""
    each = texts.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    marks = [m.alias(f"m{k}") for k, m in enumerate(identifier(F.col("chunk"), bits, seed))]
    names = [f"m{k}" for k in range(len(marks))]
    distinct = each.select(*marks, "chunk").distinct()
    return distinct.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def recipes(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, row (a number of its own), text_sha256 and recipe of every document, written once."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    seed = 7
    while not _verified(texts, bits, seed):
        bits, seed = min(2 * bits, BITS), seed + 1000
    recipe = F.flatten(F.transform(chunks(F.col("norm")), lambda c: F.array(*identifier(c, bits, seed))))
    return lineage.written(texts.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), recipe.alias("recipe")))


def duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = recipes(docs, bits)
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("n")).where("n > 1")
    several = lineage.written(groups.select(F.col("recipe").alias("of"), "top", "n"))
    joined = rows.join(several, F.col("recipe") == F.col("of"), "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("top.row"))).alias("kept"), "text_sha256")
