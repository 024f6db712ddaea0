import pytest
from conftest import SF, fixture_rows, texts
from pyspark.sql import functions as F

import brute
from auditflow.operators.detect import findings, with_findings
from auditflow.rules import RULES, Rule, patterns, rules_frame
from auditflow.sources.tables import load


def rule(label):
    return next(r for r in RULES if r.label == label)


def test_catalogue_shape(spark):
    assert len(RULES) == 27 and len(patterns()) == 49
    assert rules_frame(spark).count() == 27
    assert {r.severity for r in RULES} == {"CRITICAL", "HIGH", "MEDIUM"}


def test_each_rule_alone(spark):
    rows = fixture_rows("rules.jsonl")
    by_rule = {r.label: [x for x in rows if x["rule"] == r.label] for r in RULES}
    for r in RULES:
        cases = by_rule[r.label]
        assert sum(bool(c["expect"]) for c in cases) >= 2 and any(not c["expect"] for c in cases), r.label
        found = findings(texts(spark, [c["text"] for c in cases]), rules=(r,)).collect()
        for i, case in enumerate(cases):
            got = [f.quote for f in sorted(found, key=lambda f: f.finding_ord) if f.doc_id == i]
            assert got == case["expect"], (r.label, case)


def compare_with_brute(df, key="doc_id", text="text"):
    for row in with_findings(df.select(key, text), text).toLocalIterator():
        got = [(f.entity_type, f.verbatim_quote) for f in row.findings]
        assert got == [(r.label, v) for r, v in brute.values(row[text])], (row[key], row[text][:200])


def test_all_rules_on_fixtures(spark):
    compare_with_brute(texts(spark, [r["text"] for r in fixture_rows("rules.jsonl")]))


def test_unicode(spark):
    cases = [r["text"] for r in fixture_rows("unicode.jsonl")]
    compare_with_brute(texts(spark, cases))


@pytest.mark.parametrize("table,key,text", [
    ("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("benchmark", "item_id", "text")])
def test_whole_tables(spark, table, key, text):
    compare_with_brute(load(spark, SF, table).repartition(8), key, text)


def test_notes_against_brute(spark):
    from auditflow.plans import inputs
    compare_with_brute(inputs.notes(spark, SF).where("doc_id < 500"))


def test_finding_fields(spark):
    row = with_findings(texts(spark, ["adhar 6231 4470 9182, passwrd Qm!7731"])).first()
    assert [(f.id, f.category, f.severity, f.suggested_synthetic, f.source) for f in row.findings] == [
        ("p1", "SECRET", "CRITICAL", "[PASSWORD_1]", "pattern_rule"),
        ("p2", "GOVERNMENT_ID", "CRITICAL", "[AADHAAR_2]", "pattern_rule")]
    assert row.findings[0].risk_explanation == "Matches standard structure for sensitive Password / Credential."


def test_first_rule_wins(spark):
    # The same value as a credential and as a phone number: reported once, by the first rule.
    found = findings(texts(spark, ["secret 9812345678 call 9812345678"])).collect()
    assert [(f.label, f.quote) for f in found] == [("Password / Credential", "9812345678")]


def test_custom_rules(spark):
    ticket = Rule("Ticket", "BUSINESS_CONFIDENTIAL", "MEDIUM", "TICKET", (r"\bTCK-\d+\b",))
    found = findings(texts(spark, ["see TCK-12 and xTCK-13"]), rules=(ticket,)).collect()
    assert [(f.quote, f.severity) for f in found] == [("TCK-12", "MEDIUM")]


def test_null_and_empty_text(spark):
    rows = with_findings(texts(spark, [None, ""])).select(F.size("findings").alias("n")).collect()
    assert all((r.n or 0) <= 0 for r in rows)


def test_amounts_with_many_groups(spark):
    cases = ["$1,234", "x$1,234", "rs 1,234", "rs 1,23,456.75 net", "rs 1,234,5678", "rs 1,2", "rs 1,234a", "rs 1,234,56a",
             "rs 12,34.5 lakh", "rs 12,34 lakhx", "rs 1,234.567", "inr 1,234k", "inr 1,234kg", "usd 1,234,", "gbp 1,234,567 million",
             "rs 1234567", "eur 1,23_", "rs 1,234,56_,78", "rs 1" + ",123" * 60 + "x", "rs 1,22,", "rs 1,22,3", "rs 1,22 ,333"]
    compare_with_brute(texts(spark, cases))


def test_long_lists_do_not_overflow(spark):
    long_list = "x$1" + ",123" * 30000
    df = texts(spark, [long_list, long_list + "a", "rs 1" + ",12" * 30000 + "b", "name: " + "a " * 30000, "x@" + "a." * 20000])
    rows = with_findings(df).select(F.expr("transform(findings, f -> length(f.verbatim_quote))").alias("n")).collect()
    assert len(long_list) - 1 in rows[0].n and rows[1].n == [len(long_list) - 5]


def test_long_runs_before_an_at_sign(spark):
    encoded = "%E0%A4%B9" * 40000
    cases = [encoded + " x.y@mail.example.org", encoded + "@mail.example.org", "a-" * 300 + "@mail.example.org, b.c@d.ef"]
    rows = findings(texts(spark, cases), rules=(rule("Email Address"),)).orderBy("doc_id", "finding_ord").collect()
    assert [(r.doc_id, len(r.quote)) for r in rows] == [
        (0, 20), (1, len(encoded) + 16), (2, 617), (2, 8)]
    compare_with_brute(texts(spark, cases[2:] + ["é.a@b.cd .x@y.zz a@b@c.de a@b.c@d.ef x@y.z1 q@w.er|ty a@b.cdé"]))
