"""Reports over a whole audited corpus: the per-text results, lifted to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The risk levels, the lowest first.
LEVELS = ("MODERATE", "HIGH RISK", "CRITICAL RISK")


def exposure_rollup(found: DataFrame, source_col: str = "source") -> DataFrame:
    """Findings and texts by source, label and severity, with subtotals.

    ``found`` has a ``findings`` array per text.  What a text adds to each subtotal
    is worked out in its own row, so a text counts once everywhere without a
    distinct count: the only shuffle is that of the partial sums per group.
    ``level`` is the grouping id: 0 all three, 1 source and label, 3 source, 7 total.
    """
    def group(label: Column, severity: Column, level: int, n: Column) -> Column:
        return F.struct(label.alias("label"), severity.alias("severity"),
                        F.lit(level).alias("level"), n.cast("bigint").alias("n"))

    none = F.lit(None).cast("string")
    pairs = F.transform("findings", lambda f: F.struct(f["entity_type"].alias("l"), f["severity"].alias("s")))
    staged = found.where(F.size("findings") > 0).select(source_col, pairs.alias("_p"))
    groups = F.concat(
        F.transform(F.array_distinct("_p"), lambda c: group(
            c["l"], c["s"], 0, F.size(F.filter("_p", lambda x: x == c)))),
        F.transform(F.array_distinct("_p.l"), lambda c: group(
            c, none, 1, F.size(F.filter("_p", lambda x: x["l"] == c)))),
        F.array(group(none, none, 3, F.size("_p")), group(none, none, 7, F.size("_p"))),
    )
    flat = staged.select(source_col, F.explode(groups).alias("g")).select(
        F.when(F.col("g.level") < 7, F.col(source_col)).alias(source_col), "g.*")
    return flat.groupBy(source_col, "label", "severity", "level").agg(
        F.sum("n").alias("n_findings"), F.count("*").alias("n_docs"))


def top_risk_documents(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The ``k`` texts with the highest score; ties go to the lower key."""
    return scored.orderBy(F.col("risk_score").desc(), F.col(key)).limit(k).select(
        key, "risk_score", "risk_level", "n_findings")


def outgoing_text(audited: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What may leave: the text itself where nothing was found, else the sanitized text."""
    changed = (F.col("n_findings") > 0) & (F.col("sanitized_text") != F.col(text_col))
    return audited.select(
        key, F.when(changed, F.col("sanitized_text")).otherwise(F.col(text_col)).alias("outgoing"),
        changed.alias("intercepted"))


def releasable_corpus(audited: DataFrame, max_level: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text: as it is up to the risk level ``max_level``, sanitized beyond it."""
    if max_level not in LEVELS:
        raise ValueError(f"max_level must be one of {LEVELS}")
    as_it_is = F.col("risk_level").isin(list(LEVELS[: LEVELS.index(max_level) + 1]))
    return audited.select(key, F.when(as_it_is, F.col(text_col)).otherwise(F.col("sanitized_text")).alias("released"),
                          "risk_level", as_it_is.alias("as_it_is"))


def repeated_values(findings: DataFrame, min_docs: int = 2, key: str = "doc_id") -> DataFrame:
    """Values (hashed) that occur in several texts.

    Findings are distinct per text, so counting rows counts texts, and each map
    task combines its rows before the shuffle however often one value occurs.
    """
    counted = findings.groupBy(F.sha2("quote", 256).alias("value_hash"), "label").agg(
        F.count("*").alias("n_docs"))
    return counted.where(F.col("n_docs") >= min_docs)


def stable_token(tag: Column, original: Column, secret: str) -> Column:
    """A token that depends on the value only, so equal values share it everywhere.

    It holds the whole digest.  Each part of what is hashed has its length in front, so
    no two triples of secret, tag and value read the same.
    """
    sized = F.concat(F.lit(f"{len(secret)}:{secret}"), F.length(tag).cast("string"), F.lit(":"), tag, original)
    digest = F.upper(F.sha2(sized, 256))
    return F.concat(F.lit("["), tag, F.lit("_"), digest, F.lit("]"))


def stable_tokens(spans: DataFrame, scope: str, secret: str) -> DataFrame:
    """One token per different value of a scope, with the number of its occurrences.

    The token is computed in each row from a keyed hash: there is no numbering, no
    global sort and no join, and no two texts can overwrite each other's tokens.
    """
    token = stable_token(F.col("tag"), F.col("original"), secret).alias("token")
    return spans.groupBy(scope, "tag", F.sha2("original", 256).alias("value_hash"), token).agg(
        F.count("*").alias("n_spans"))


def spans_table(audited: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept spans, one per row."""
    return audited.select(key, *keep, F.explode_outer("spans").alias("s")).where("s is not null").select(
        key, *keep, "s.start", "s.len", "s.finding_ord", "s.category", "s.tag", "s.token", "s.original")
