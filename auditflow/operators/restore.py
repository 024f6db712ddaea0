"""Putting original values back in place of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditflow.functions.folds import bind
from auditflow.functions.index import below
from auditflow.functions.lineage import cut, unbroadcast
from auditflow.functions.text import computed_once, escape_html, replace_tokens, sql_name
from auditflow.operators.anonymize import vault_entries

TOKEN_REGEX = r"\[[^\[\]]+\]"
#: The same as a SQL literal.  Up to FEW entries are applied in turn.
TOKEN, FEW = f"r'{TOKEN_REGEX}'", 16


def restored(text_col: str, entries_col: str) -> Column:
    """``text_col`` with ``entries_col`` (token, original, start) applied, longest token first.

    Applied one after the other, each entry costs a pass over the text.  Where every token is a
    bracketed name and no value holds a bracket, no replacement can make or break
    another's token: then the text is cut once at everything that looks like a token, and
    each is looked up, whatever their number.
    """
    text, entries = sql_name(text_col), sql_name(entries_col)
    by_length = f"array_sort(transform({entries}, x -> struct(-length(x.token) as rank, x.start as start, x.token as token, x.original as original)))"
    in_turn = f"aggregate({by_length}, {text}, (acc, x) -> replace(acc, x.token, x.original))"
    by_token = f"array_sort(transform({entries}, x -> struct(x.token as token, x.start as start, x.original as original)))"
    known = bind(below("e", "x.token < t"), "at", "CASE WHEN get(e, at).token = t THEN get(e, at).original ELSE t END")
    values = f"transform(regexp_extract_all({text}, {TOKEN}, 0), t -> {known})"
    # The pieces between the tokens and the tokens take turns; no token stands behind the last piece.
    joined = bind(values, "v", f"array_join(transform(split({text}, {TOKEN}, -1), (p, i) -> concat(p, coalesce(get(v, i), ''))), '')")
    apart = rf"forall({entries}, x -> rlike(x.token, concat(r'\A', {TOKEN}, r'\z')) AND NOT rlike(x.original, r'[\[\]]'))"
    return F.expr(f"CASE WHEN size({entries}) > {FEW} AND {apart} THEN {bind(by_token, 'e', joined)} ELSE {in_turn} END")


def with_restored(audited: DataFrame) -> DataFrame:
    """Restore each text from its own spans; no join and no shuffle."""
    kept = audited.columns
    staged = audited.select(*kept, vault_entries(F.col("spans")).alias("_entries"))
    return staged.select(*kept, computed_once(
        restored("sanitized_text", "_entries")).alias("restored_text"))


def restore(texts: DataFrame, vault: DataFrame, key: str = "doc_id",
            text_col: str = "sanitized_text") -> DataFrame:
    """Restore texts from a vault table with the entries of each text.

    A group holds the tokens of one text, so it is bounded by that text.
    """
    entries = vault.groupBy(key).agg(
        F.collect_list(F.struct("token", "original", "start")).alias("_entries"))
    joined = texts.join(unbroadcast(entries), key, "left")
    return joined.withColumn("restored_text", F.when(
        F.col("_entries").isNull(), F.col(text_col)).otherwise(restored(text_col, "_entries"))
    ).drop("_entries")


def roundtrip(audited: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whether each text comes back, and whether it holds one of its own tokens literally."""
    checked = with_restored(audited)
    return checked.select(
        key, (F.col("restored_text") == F.col(text_col)).alias("exact"),
        F.exists("spans", lambda s: F.contains(F.col(text_col), s["token"])).alias("collision"),
    )


def upsert_vault(entries: DataFrame) -> DataFrame:
    """The latest value per scope and token; ``first_*`` keep the place of the first one."""
    at = F.struct("seq", "start")
    return entries.groupBy("scope", "token").agg(
        F.max_by("original", at).alias("original"), F.min(at).alias("_first"), F.max("seq").alias("seq"),
    ).select("scope", "token", "original", "seq",
             F.col("_first.seq").alias("first_seq"), F.col("_first.start").alias("first_start"))


def merge_vaults(stores: DataFrame) -> DataFrame:
    """Stores made by ``upsert_vault`` from different entries as one, as if made from all of them."""
    return stores.groupBy("scope", "token").agg(
        F.max_by("original", F.struct("seq", "first_seq", "first_start")).alias("original"), F.max("seq").alias("seq"),
        F.min(F.struct("first_seq", "first_start")).alias("_first"),
    ).select("scope", "token", "original", "seq", "_first.first_seq", "_first.first_start")


def _tokens_in(col: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(col, F.lit(TOKEN_REGEX), F.lit(0)))


def _nested(store: DataFrame) -> DataFrame | None:
    """(scope, token, inner): tokens that restoring ``token`` can bring into a text.

    Values that hold other tokens are rare, so this is usually empty at the first
    look.  Otherwise references are followed until no new one appears.
    """
    known = store.select("scope", F.col("token").alias("inner"))
    edges = store.where(F.contains("original", F.lit("["))).select(
        "scope", "token", F.explode(_tokens_in(F.col("original"))).alias("inner")
    ).join(unbroadcast(known), ["scope", "inner"], "left_semi")
    if edges.isEmpty():
        return None
    edges = cut(edges)
    reach, latest = edges, edges
    while True:
        onward = edges.select("scope", F.col("token").alias("inner"), F.col("inner").alias("next"))
        latest = cut(latest.join(unbroadcast(onward), ["scope", "inner"]).select(
            "scope", "token", F.col("next").alias("inner")).distinct().join(
            unbroadcast(reach), ["scope", "token", "inner"], "left_anti"))
        if latest.isEmpty():
            return reach
        reach = reach.unionByName(latest)


def store_entries(texts: DataFrame, store: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """For each text the entries of its scope's store that it needs, in store order.

    The tokens of a text are looked up by an equi-join, so neither a store nor a
    scope is ever collected; a group holds no more than the tokens of one text.
    """
    wanted = texts.select("scope", *key, F.explode(_tokens_in(F.col(text_col))).alias("token"))
    nested = _nested(store)
    if nested is not None:
        inner = wanted.join(unbroadcast(nested), ["scope", "token"]).select("scope", *key, F.col("inner").alias("token"))
        wanted = wanted.unionByName(inner).distinct()
    entry = F.struct("first_seq", "first_start", "token", "original")
    return wanted.join(unbroadcast(store), ["scope", "token"]).groupBy(*key).agg(
        F.array_sort(F.collect_list(entry)).alias("_entries"))


def restore_from_store(texts: DataFrame, store: DataFrame, key: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Replace the tokens known to the scope's store, oldest first; ``changed`` tells whether any was."""
    entries = store_entries(texts, store, [key], text_col)
    joined = texts.join(unbroadcast(entries), key, "left")
    done = joined.withColumn("restored_text", F.when(
        F.col("_entries").isNull(), F.col(text_col)).otherwise(replace_tokens(F.col(text_col), F.col("_entries"))))
    return done.withColumn("changed", F.col("restored_text") != F.col(text_col)).drop("_entries")


def decode_responses(messages: DataFrame, store: DataFrame, key: list[str],
                     text_col: str = "text") -> DataFrame:
    """Assistant messages with known tokens replaced by HTML-escaped values.

    ``n_decoded`` counts the different tokens replaced in a message.
    """
    said = messages.where(F.col("role") == "assistant")
    entries = store_entries(said, store, key, text_col)

    def step(acc: Column, e: Column) -> Column:
        hit = F.contains(acc["text"], e["token"])
        return F.struct(
            F.replace(acc["text"], e["token"], escape_html(e["original"])).alias("text"),
            (acc["n"] + hit.cast("int")).alias("n"),
        )

    start = F.struct(F.col(text_col).alias("text"), F.lit(0).alias("n"))
    applied = F.when(F.col("_entries").isNull(), start).otherwise(F.aggregate("_entries", start, step))
    decoded = said.join(unbroadcast(entries), key, "left").withColumn("_d", applied)
    return decoded.withColumn("decoded_text", F.col("_d.text")).withColumn(
        "n_decoded", F.col("_d.n")).drop("_entries", "_d")
