"""What the plans must look like to hold at scale."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from auditflow.operators import auditlog, corpus, restore
from auditflow.operators.anonymize import vault
from auditflow.operators.detect import findings, with_findings
from auditflow.operators.score import audit, scores
from auditflow.plans import inputs
from auditflow.rules import patterns
from auditflow.sources.tables import load


def plan(df, executed=True):
    spark = df.sparkSession
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    query = df._jdf.queryExecution()
    return (query.executedPlan() if executed else query.optimizedPlan()).toString()


@pytest.fixture(scope="module")
def docs(spark):
    return load(spark, SF, "documents").select("doc_id", "text")


ONCE = len(patterns()) + 1  # every pattern, and the word beginnings


def test_each_pattern_is_evaluated_once(docs):
    frames = {
        "findings": findings(docs).groupBy("label").count(),
        "audit": audit(docs),
        "filtered": audit(docs).where("n_findings > 0 and risk_level <> 'MODERATE' and sanitized_text <> text"),
        "log": auditlog.log_entries(audit(docs.withColumns({"ts": F.current_timestamp(), "source": F.lit("x")}))),
        "outgoing": corpus.outgoing_text(audit(docs)).where("intercepted"),
        "rollup": corpus.exposure_rollup(with_findings(docs.withColumn("source", F.lit("x")))),
        "top": corpus.top_risk_documents(scores(docs), 10),
    }
    for name, df in frames.items():
        assert plan(df).count("regexp_extract_all(") == ONCE, name


def test_the_words_of_the_catalogue_are_not_hashed_for_every_text(docs):
    assert "array_intersect(" not in plan(findings(docs)) and "INSET" in plan(findings(docs))


def test_audit_is_one_narrow_stage_without_python(docs):
    p = plan(audit(docs))
    assert "Exchange" not in p and "Python" not in p and "ArrowEval" not in p


def test_only_needed_columns_are_read(spark):
    p = plan(scores(load(spark, SF, "documents")).select("doc_id", "risk_score"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_filters_on_inputs_reach_the_scan(spark):
    found = audit(load(spark, SF, "documents")).where("source = 'src1' and doc_id > 10").select("doc_id", "risk_score")
    p = plan(found)
    assert "PushedFilters: [IsNotNull(source), IsNotNull(doc_id), EqualTo(source,src1), GreaterThan(doc_id,10)]" in p


def test_top_and_last_rows_are_cut_early(docs, spark):
    assert "TakeOrderedAndProject" in plan(corpus.top_risk_documents(scores(docs), 10))
    events = load(spark, SF, "events")
    assert "TakeOrderedAndProject" in plan(auditlog.retain_last(events, 500, ("ts",)))
    assert "WindowGroupLimit" in plan(auditlog.retain_last(events, 20, ("ts", "event_id"), by="user_id"))


def test_rollup_shuffles_groups_only(docs):
    p = plan(corpus.exposure_rollup(with_findings(docs.withColumn("source", F.lit("x")))))
    assert p.count("Exchange hashpartitioning") == 1 and "partial_sum" in p


def test_generated_sides_of_joins_are_not_broadcast(spark):
    notes, semantic = inputs.notes(spark, SF), inputs.note_semantic(spark, SF)
    audited = audit(notes, semantic)
    said = notes.select("doc_id", F.lit("assistant").alias("role"), F.col("doc_id").cast("string").alias("scope"), "text")
    store = restore.upsert_vault(vault(audit(notes)))
    frames = {
        "audit": audited,
        "restore": restore.restore(audited.select("doc_id", "sanitized_text"), vault(audited)),
        "store": restore.restore_from_store(said, store),
        "decode": restore.decode_responses(said, store, ["doc_id"]),
    }
    for name, df in frames.items():
        assert "Broadcast" not in plan(df), name
