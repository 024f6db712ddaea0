import json

from conftest import ROOT, SF, fixture_rows, texts
from pyspark.sql import functions as F

from auditflow.operators import semantic as sem
from auditflow.operators.requests import audit_requests
from auditflow.operators.score import audit
from auditflow.plans.queries import QUERIES
from auditflow.sources import tables

SCENARIOS = f"{ROOT}/tests/fixtures/scenarios.json"


def test_models(spark):
    assert [r.model_id for r in sem.models_frame(spark).collect()] == ["gemma-4-31b-it", "gemma-4-26b-a4b-it"]
    df = spark.createDataFrame([("gemma-4-26b-a4b-it",), ("other",), (None,)], "model_id string")
    rows = [(r.model_called, r.model_name) for r in sem.resolve_model(df).collect()]
    assert rows == [("gemma-4-26b-a4b-it", "Gemma 4 26B/4B (MoE)"), ("gemma-4-31b-it", "Gemma 4"), ("gemma-4-31b-it", "Gemma 4")]


def test_parse_responses(spark):
    cases = fixture_rows("semantic.jsonl")
    df = spark.createDataFrame([(i, "m", json.dumps(c["body"])) for i, c in enumerate(cases)] + [(99, "m", "not json")],
                               "doc_id bigint, model_id string, body string")
    rows = {r.doc_id: r for r in sem.parse_model_responses(df).collect()}
    for i, c in enumerate(cases):
        got = rows[i]
        assert ([f.verbatim_quote for f in got.findings], got.compliance_summary, got.error) == (
            c["quotes"], c["summary"], c["error"]), c
    assert rows[99].error == sem.NO_CANDIDATES
    flat = sem.semantic_findings(sem.parse_model_responses(df)).where("doc_id = 3").orderBy("ord").collect()
    assert [(r.ord, r.verbatim_quote) for r in flat] == [(1, "y"), (2, "z {1}")]


def test_prompt_requests(spark):
    row = sem.build_prompt_requests(texts(spark, ['say "hi"\n']), model_id="nope").first()
    body = json.loads(row.body)
    assert row.model_id == sem.DEFAULT_MODEL
    assert body["generationConfig"] == {"temperature": 0.1, "responseMimeType": "application/json"}
    assert '=== TEXT TO AUDIT FOR SENSITIVE DATA ===\nsay "hi"\n\n=== END TEXT ===' in body["contents"][0]["parts"][0]["text"]


def test_scenarios(spark):
    scenarios = sem.scenario_table(spark, SCENARIOS)
    assert sem.scenario_listing(scenarios).columns == ["id", "title", "description", "text"]
    rows = scenarios.collect()
    assert len(rows) >= 4 and all(len(r.text) > 100 and r.cached_audit.risk_score > 80 for r in rows)


def test_choose_source_and_audit(spark):
    scenarios = sem.scenario_table(spark, SCENARIOS)
    requests = spark.createDataFrame([
        (1, "card_dispute", True, True), (2, "card_dispute", False, False), (3, "unknown", True, False),
        (4, None, False, True), (5, "crash_log", False, True), (6, None, False, True), (7, "crash_log", False, True),
    ], "doc_id bigint, scenario_id string, use_cached boolean, has_key boolean")
    answer = json.dumps({"candidates": [{"content": {"parts": [{"text": '{"findings": [{"verbatim_quote": "q"}], "compliance_summary": "ok"}'}]}}]})
    responses = spark.createDataFrame([(4, "m", answer), (5, "m", '{"candidates": []}'), (6, "m", '{"candidates": []}')],
                                      "doc_id bigint, model_id string, body string")
    chosen = {r.doc_id: r for r in sem.choose_semantic_source(requests, scenarios, sem.parse_model_responses(responses)).collect()}
    assert {k: v.origin for k, v in chosen.items()} == {
        1: "cached", 2: "cached", 3: "none", 4: "model", 5: "cached", 6: "failed", 7: "cached"}
    assert chosen[3].compliance_summary.startswith("Pattern Firewall active")
    assert chosen[6].compliance_summary == (
        "Gemma 4 service notice: Gemma 4 returned no content candidates.. High-confidence pattern firewall active.")
    assert {k for k, v in chosen.items() if v.is_benchmark} == {1, 2, 5, 7}

    # The stored findings of a scenario, merged with the rules: at least six findings, a high score.
    docs = scenarios.where("scenario_id = 'card_dispute'").select(F.lit(1).cast("bigint").alias("doc_id"), "text")
    semantic = sem.semantic_findings(spark.createDataFrame([chosen[1]], sem.choose_semantic_source(
        requests, scenarios, sem.parse_model_responses(responses)).schema))
    r = audit(docs, semantic).first()
    assert r.n_findings >= 6 and r.risk_score > 80
    assert "[CUSTOMER_1]" in r.sanitized_text and "[CARD_1]" in r.sanitized_text


def test_requests(spark):
    bodies = ['{"text": " hi\\u00a0 "}', '{"text": ""}', "{}", "nope", '["text"]', '{"text": "x", "mask_mode": "redacted", "temperature": 0.7}']
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string")
    rows = {r.request_id: r for r in tables.normalise_requests(df).collect()}
    assert (rows[0].text, rows[0].mask_mode, rows[0].source, rows[0].temperature, rows[0].error) == ("hi", "synthetic", "web_app", 0.1, None)
    assert rows[1].error == rows[2].error == "Text cannot be empty."
    assert rows[3].error == rows[4].error == "Invalid JSON body"
    assert (rows[5].mask_mode, rows[5].temperature) == ("redacted", 0.7)
    good, bad = tables.split_requests(tables.normalise_requests(df))
    assert good.count() == 2 and bad.count() == 4


def test_audit_requests(spark):
    scenarios = sem.scenario_table(spark, SCENARIOS)
    card, memo = scenarios.where("scenario_id in ('card_dispute', 'deal_memo')").orderBy("scenario_id").collect()
    bodies = [
        {"text": card.text, "scenario_id": "card_dispute", "use_cached_benchmark": True, "mask_mode": "redacted"},
        {"text": f"  {memo.text} ", "scenario_id": "deal_memo", "mask_mode": "whatever"},
        {"text": "call 9812345678", "api_key": "k", "model_id": "gemma-4-26b-a4b-it"},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "request_id int, body string")
    accepted, _ = tables.split_requests(tables.normalise_requests(df))
    none = spark.createDataFrame([], "request_id int, model_id string, body string")
    rows = audit_requests(accepted, scenarios, sem.parse_model_responses(none, "request_id")).orderBy("request_id").collect()
    first, second, third = rows
    assert "[PERSONAL_CONTACT]" in first.sanitized_text and "_1]" not in first.sanitized_text
    assert first.risk_score > 80 and first.n_findings >= 6 and first.is_benchmark
    assert "[DEAL_1]; the founder [CUSTOMER_1]" in second.sanitized_text and second.model_used == sem.DEFAULT_MODEL
    assert third.sanitized_text == "call [PHONE_1]" and third.origin == "failed"
    assert (third.model_used, third.model_name) == ("gemma-4-26b-a4b-it", "Gemma 4 26B/4B (MoE)")


def test_answers_are_parsed_once_by_many_tasks(spark):
    """What asks for findings is not pushed below the parsing as a copy of all of it."""
    found = QUERIES["semantic_findings"](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(candidates") == 1
    assert plan.count("from_json(StructField(findings") == 1
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
