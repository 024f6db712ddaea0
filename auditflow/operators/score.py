"""Severity counts, the risk score and the report of one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditflow.operators.anonymize import vault_entries, with_sanitized
from auditflow.operators.detect import with_findings
from auditflow.operators.merge import with_merged, with_spans
from auditflow.rules import RULES, Rule


def severity_count(findings: Column, severity: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["severity"] == severity))


def risk_score(critical: Column, high: Column, medium: Column) -> Column:
    return F.least(F.lit(100), critical * 30 + high * 15 + medium * 5)


def risk_level(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL RISK").when(score >= 40, "HIGH RISK").otherwise("MODERATE")


def with_scores(df: DataFrame) -> DataFrame:
    """Add the counts over all findings, also those whose span was dropped, and the score."""
    counted = df.withColumns({
        "n_findings": F.size("findings"),
        "critical": severity_count(F.col("findings"), "CRITICAL"),
        "high": severity_count(F.col("findings"), "HIGH"),
        "medium": severity_count(F.col("findings"), "MEDIUM"),
    })
    scored = counted.withColumn("risk_score", risk_score(F.col("critical"), F.col("high"), F.col("medium")))
    return scored.withColumn("risk_level", risk_level(F.col("risk_score")))


def scores(docs: DataFrame, semantic: DataFrame | None = None, key: str = "doc_id",
           text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings and scores only: nothing is located or rewritten."""
    return with_scores(with_merged(with_findings(docs, text_col, rules), semantic, key, text_col))


def audit(docs: DataFrame, semantic: DataFrame | None = None, mask_mode: str = "synthetic",
          key: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
          longest: bool = False, mode_col: str | None = None) -> DataFrame:
    """The whole audit of a table of texts; the columns of ``docs`` are kept.

    Adds ``findings``, ``spans`` (with token and original), ``sanitized_text``,
    ``mask_mode`` and the scores.  Without external findings this is one narrow
    stage: no row leaves the task that read it.  With ``mode_col`` each row names its
    own mode; any value but ``redacted`` means synthetic.
    """
    found = with_merged(with_findings(docs, text_col, rules), semantic, key, text_col)
    rewritten = with_sanitized(with_spans(found, text_col, longest), text_col, mask_mode, mode_col)
    return with_scores(rewritten).withColumn("mask_mode", F.col(mode_col) if mode_col else F.lit(mask_mode))


def report(audited: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One nested ``report`` per text: texts, findings, vault map and stats."""
    entries = vault_entries(F.col("spans"))
    optional = {"compliance_summary": "string", "is_benchmark": "boolean",
                "model_used": "string", "model_name": "string"}
    extras = [F.col(c) if c in audited.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()]
    stats = F.struct(
        F.col("n_findings").alias("total_risks_detected"), F.col("critical").alias("critical_risks"),
        F.col("high").alias("high_risks"), F.col("medium").alias("medium_risks"), "risk_score", "risk_level",
    )
    return audited.select(key, F.struct(
        F.col(text_col).alias("original_text"), "sanitized_text", "mask_mode", "findings",
        F.map_from_arrays(entries["token"], entries["original"]).alias("vault"),
        stats.alias("stats"), *extras,
    ).alias("report"))
