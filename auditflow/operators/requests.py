"""Audit requests from end to end: parsed requests in, audited texts with their summary out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditflow.operators.score import audit
from auditflow.operators.semantic import choose_semantic_source, resolve_model, semantic_findings


def audit_requests(requests: DataFrame, scenarios: DataFrame, parsed: DataFrame,
                   key: str = "request_id") -> DataFrame:
    """Audit accepted requests, each with its own mode, model and source of external findings.

    ``requests`` is the accepted part of ``normalise_requests``, ``parsed`` the output
    of ``parse_model_responses`` under the same key.  Adds to the audit
    ``compliance_summary, is_benchmark, model_used, model_name``.
    """
    wanted = requests.select(key, "scenario_id", F.col("use_cached_benchmark").alias("use_cached"), "has_key")
    chosen = choose_semantic_source(wanted, scenarios, parsed, key)
    named = resolve_model(requests).withColumn("model_used", F.col("model_id"))
    texts = named.select(key, "text", "mask_mode", "source", "model_used", "model_name").join(
        chosen.select(key, "origin", "compliance_summary", "is_benchmark"), key)
    return audit(texts, semantic_findings(chosen, key), key=key, mode_col="mask_mode")
