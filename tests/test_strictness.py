"""Strict JSON, ties in time, log ids, tokens without inner brackets, whole digests, work per text."""

import time

from conftest import texts
from pyspark.sql import functions as F

from auditflow.functions.json import is_json
from auditflow.functions.lineage import shared
from auditflow.operators import auditlog, corpus, events, restore
from auditflow.operators.anonymize import vault
from auditflow.operators.detect import with_findings
from auditflow.operators.score import audit
from auditflow.operators.semantic import NOT_JSON, parse_model_responses
from auditflow.sources.tables import BAD_BODY, normalise_requests

GOOD = ['{"a":1}', " [1] ", '"x"', "5", "true", '{"a":{"b":[1,"}"]}}']
BAD = ['{"a":1} junk', "{'a':1}", '{"a":1}}', '{"a":1},{"b":2}', '{"a":1}],[{"b":2}', '1,"w":2', "", "{x}", '{"a":1,}', '{"a":01}', None]


def test_is_json(spark):
    df = spark.createDataFrame([(k, j) for k, j in enumerate(GOOD + BAD)], "k int, j string")
    assert [r.ok for r in df.orderBy("k").select(is_json(F.col("j")).alias("ok")).collect()] == [True] * len(GOOD) + [False] * len(BAD)


def test_requests(spark):
    bodies = ['{"text":"abc"} junk', "{'text':'abc'}", "[1]", None, '{"text":"abc","temperature":"0.5"}', '{"text":"abc","use_cached_benchmark":"true"}',
              '{"text":"abc","use_cached_benchmark":0}', '{"text":"abc","use_cached_benchmark":"false"}', '{"text":"abc","use_cached_benchmark":[]}',
              '{"text":"abc","use_cached_benchmark":false,"temperature":1}', '{"text":null}', '{"text":"abc","use_cached_benchmark":null}']
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "request_id int, body string")
    rows = normalise_requests(df).orderBy("request_id").collect()
    assert [r.error for r in rows] == [BAD_BODY] * 4 + [None] * 6 + ["Text cannot be empty.", None]
    assert [r.use_cached_benchmark for r in rows[4:]] == [False, True, False, True, False, False, False, False]
    assert rows[4].temperature == 0.5 and rows[9].temperature == 1.0 and rows[5].temperature == 0.1


def test_model_answers(spark):
    answers = ['{"findings": []} and {x}', "{'findings': []}", '[{"a":1}]', 'see {"findings": [], "compliance_summary": "s"} above', '{"findings": []}']
    df = spark.createDataFrame([(k, "m", a) for k, a in enumerate(answers)], "doc_id int, model_id string, a string").select(
        "doc_id", "model_id", F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("a").alias("text"))).alias("parts")).alias("content"))).alias("candidates"))).alias("body"))
    rows = parse_model_responses(df).orderBy("doc_id").collect()
    assert [r.error for r in rows] == [NOT_JSON] * 3 + [None] * 2 and rows[3].compliance_summary == "s"


def test_control_rows_of_one_time(spark):
    rows = [("u", "2024-01-01 10:00:00", k, p) for k, p in ((3, None), (1, True), (2, None), (4, None))] + [("v", "2024-01-01 10:00:00", 2, False), ("v", "2024-01-01 10:00:00", 1, True)]
    control = spark.createDataFrame(rows, "user string, ts string, seq long, paused boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    users = spark.createDataFrame([("u",), ("v",), ("w",)], "user string")
    # u: paused, flipped three times; v: paused, then resumed.
    assert {r.user: r.is_paused for r in events.read_control(users, control).collect()} == {"u": False, "v": False, "w": False}
    copies = users.withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    assert {r.user: r.is_paused for r in events.with_pause_state(copies, control, ["user"]).collect()} == {"u": False, "v": False, "w": False}
    first = control.where("seq <= 2")
    assert {r.user: r.is_paused for r in events.read_control(users, first).collect()} == {"u": False, "v": False, "w": False}
    assert events.read_control(users, control.where("seq = 1")).where("is_paused").count() == 2


def test_bins_follow_the_ids(spark):
    log = spark.createDataFrame([(k, k) for k in (3, 10, 11, 700)], "id long, threats_count int")
    want = [0] * 7
    for k in (3, 10, 11, 700):
        want[(k - 1) % 7] += k
    assert [r.threats for r in auditlog.activity_bins(log).orderBy("bin").collect()] == want


def test_no_token_holds_brackets(spark):
    df = texts(spark, ["the code word is swordfish here"])
    semantic = spark.createDataFrame([(0, 1, "X]Y", "HIGH", "swordfish", "Thing", "[a[b]_7]", "r"), (0, 2, "P[Q", "HIGH", "code", "Thing", "none", "r")],
        "doc_id long, ord int, category string, severity string, verbatim_quote string, entity_type string, suggested_synthetic string, risk_explanation string")
    for mode in ("synthetic", "redacted"):
        audited = audit(df, semantic, mask_mode=mode)
        tokens = [s.token for s in audited.first().spans]
        assert all(t.count("[") == t.count("]") == 1 for t in tokens)
        store = restore.upsert_vault(vault(audited))
        back = restore.restore_from_store(audited.select("doc_id", F.col("doc_id").cast("string").alias("scope"), "sanitized_text"), store, text_col="sanitized_text")
        assert back.first().restored_text == df.first().text


def test_stable_tokens_hold_the_whole_digest(spark):
    one = spark.range(1).select(corpus.stable_token(F.lit("T"), F.lit("v"), "s").alias("a"), corpus.stable_token(F.lit("Tv"), F.lit(""), "s").alias("b"),
                                corpus.stable_token(F.lit("T"), F.lit("v"), "s1").alias("c")).first()
    assert len({one.a, one.b.replace("Tv", "T"), one.c}) == 3 and len(one.a) == len("[T_]") + 64


def test_shared_folder(spark):
    assert shared(spark) == shared(spark) == spark.sparkContext.getCheckpointDir()


def test_many_values_cost_linear_time(spark):
    def seconds(n):
        df = texts(spark, ["".join(f"u{k}@mail{k}.example.org, " for k in range(n))]).cache()
        df.count()
        start = time.perf_counter()
        assert with_findings(df).select(F.size("findings").alias("n")).first().n >= n
        return time.perf_counter() - start

    seconds(1000)
    small, large = min(seconds(8000) for _ in range(2)), min(seconds(16000) for _ in range(2))
    assert large < 2.5 * small + 0.5
