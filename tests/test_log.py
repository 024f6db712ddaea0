import json

from conftest import SF, texts
from pyspark.sql import functions as F

from auditflow.operators import auditlog
from auditflow.operators.score import audit
from auditflow.plans import queries
from auditflow.sources import tables

ROWS = "id bigint, threats_count int, categories array<string>, vault map<string,string>, original_text string, sanitized_text string"


def make_log(spark):
    return spark.createDataFrame([
        (1, 2, ["SECRET", "FINANCIAL_PII"], {"[PASSWORD_1]": "Zebra"}, "Pass Zebra", "Pass [PASSWORD_1]"),
        (2, None, ["BUSINESS_CONFIDENTIAL"], {"[AMOUNT_1]": "50k"}, "deal 50k", "deal [AMOUNT_1]"),
        (3, 1, ["my_passport", "Bank card", "Amount"], {}, "x", "y"),
        (4, 0, [], None, "é", "é"),
    ], ROWS)


def test_totals_and_buckets(spark):
    log = make_log(spark)
    assert tuple(auditlog.log_totals(log).first()) == (4, 3)
    assert tuple(auditlog.category_buckets(log).first()) == (2, 1, 2)
    assert tuple(auditlog.category_buckets(log, financial_first=True).first()) == (2, 0, 3)
    s = auditlog.audit_summary(log).first()
    assert tuple(s) == (4, 3, 2, 1, 2)
    empty = auditlog.audit_summary(log.where("id < 0")).first()
    assert tuple(empty) == (0, 0, 0, 0, 0)


def test_activity_bins(spark):
    log = spark.range(1, 31).select("id", F.when(F.col("id") != 30, F.col("id").cast("int")).alias("threats_count"))
    want = [0] * 7
    for i in range(11, 31):
        want[(i - 1) % 7] += 1 if i == 30 else i
    got = [r.threats for r in auditlog.activity_bins(log).orderBy("bin").collect()]
    assert got == want
    none = log.withColumn("threats_count", F.lit(0))
    assert [r.threats for r in auditlog.activity_bins(none).orderBy("bin").collect()] == [0] * 7


def test_filter_and_search(spark):
    log = make_log(spark)

    def ids(df):
        return sorted(r.id for r in df.collect())

    assert ids(auditlog.filter_category(log, "all")) == [1, 2, 3, 4]
    assert ids(auditlog.filter_category(log, "SECRET")) == [1]
    assert ids(auditlog.filter_category(log, "AMOUNT")) == [1, 2, 3]
    assert ids(auditlog.filter_category(log, "PASSWORD")) == [1]
    assert ids(auditlog.search(log, " ZEBRA ")) == [1]
    assert ids(auditlog.search(log, "[amount_1]")) == [2]
    assert ids(auditlog.search(log, "bank card amount")) == [3]
    assert ids(auditlog.search(log, "  ")) == [1, 2, 3, 4]
    assert [r.id for r in auditlog.page(log, 2).collect()] == [4, 3]
    assert auditlog.last_original(log).first().original_text == "é"


def test_retention_and_ids(spark):
    log = spark.range(0, 1200).select((F.col("id") * 7 % 1200).alias("k"), F.lit("u").alias("user"))
    kept = auditlog.retain_last(log, 500, ("k",))
    assert sorted(r.k for r in kept.collect()) == list(range(700, 1200))
    per_user = auditlog.retain_last(log, 3, ("k",), by="user")
    assert sorted(r.k for r in per_user.collect()) == [1197, 1198, 1199]
    numbered = auditlog.assign_log_ids(log.repartition(8), ["k"])
    assert all(r.id == r.k + 1 for r in numbered.collect())
    assert auditlog.assign_log_ids(log.where("k < 0"), ["k"]).count() == 0


def test_log_entries_keep_no_originals(spark):
    docs = texts(spark, ["call 9812345678", "nothing"]).withColumns({
        "ts": F.lit("2024-03-05 06:07:08").cast("timestamp"), "source": F.lit("desktop")})
    (entry,) = auditlog.log_entries(audit(docs)).collect()
    assert entry.original_text is None and entry.vault == {"[PHONE_1]": None}
    assert (entry.timestamp, entry.time_short, entry.date_short) == ("2024-03-05 06:07:08", "06:07:08", "Mar 05")
    assert (entry.machine, entry.user, entry.status) == ("LOCALHOST", "local_user", "SANITIZED")
    (full,) = auditlog.log_entries(audit(docs), keep_original=True).collect()
    assert full.original_text == "call 9812345678" and full.vault == {"[PHONE_1]": "9812345678"}


def test_counters(spark):
    audits = spark.createDataFrame([("desktop", 2), ("desktop", 0), ("extension", 3), ("web_app", 1)], "source string, n_findings int")
    assert tuple(auditlog.guardian_counters(audits).first()) == (4, 6, 1, 1)


def test_report_categories(spark):
    df = spark.createDataFrame([([("B", "e"), ("A", "e"), (None, "e"), ("", None), ("A", "x")],)], "f array<struct<category:string,entity_type:string>>")
    assert df.select(auditlog.report_categories(F.col("f")).alias("c")).first().c == ["A", "B", "PII", "e"]


def test_read_exported_log(spark, tmp_path):
    entry = {"id": 1, "timestamp": "2024-03-05 06:07:08", "source": "desktop", "threats_count": 2,
             "categories": ["SECRET"], "vault": {"[A_1]": "x"}, "extra": 1}
    (tmp_path / "ok.json").write_text(" " + json.dumps([entry, {"id": 2}], indent=2))
    (tmp_path / "bad.json").write_text("[{")
    (tmp_path / "object.json").write_text(json.dumps(entry))
    rows = tables.read_audit_log(spark, str(tmp_path / "ok.json")).orderBy("id").collect()
    assert [(r.id, str(r.ts), r.vault) for r in rows] == [(1, "2024-03-05 06:07:08", {"[A_1]": "x"}), (2, "None", None)]
    for name in ("bad.json", "object.json", "missing.json"):
        assert tables.read_audit_log(spark, str(tmp_path / name)).count() == 0


def test_append_and_export(spark, tmp_path):
    log = spark.range(1, 41).select("id", F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit(1).alias("threats_count"))
    tables.append_audit_log(log.where("id <= 20"), str(tmp_path / "log"))
    tables.append_audit_log(log.where("id > 20"), str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 40 and "event_date" in back.columns
    tables.export_audit_log(back, str(tmp_path / "out"), "2024-01-02")
    out = spark.read.json(str(tmp_path / "out"))
    assert sorted(r.id for r in out.collect()) == list(range(11, 41))


def test_ingest(spark):
    rows = [("a", "b", None, 3), ("a", "a", "x", None), ("", "b", None, None), (None, "b", None, 1)]
    df = spark.createDataFrame(rows, "original_text string, sanitized_text string, source string, threats_count int").withColumns({
        "categories": F.lit(None).cast("array<string>"), "vault": F.lit(None).cast("map<string,string>")})
    got = [(r.source, r.threats_count, r.categories, r.vault, r.logged) for r in tables.ingest_interceptions(df).collect()]
    assert got == [("desktop", 3, [], {}, True), ("x", 0, [], {}, False), ("desktop", 0, [], {}, False), ("desktop", 1, [], {}, False)]


def test_spread(spark):
    small = tables.load(spark, SF, "documents")
    assert tables.spread(small, "doc_id").rdd.getNumPartitions() >= 8
    wide = spark.range(0, 100, 1, 64)
    assert tables.spread(wide, "id") is wide


def test_a_changed_table_gives_a_new_log(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/customer.parquet")
    rows.limit(40).write.parquet(f"{tmp_path}/customer.parquet")
    first = queries._log(spark, str(tmp_path))
    assert queries._log(spark, str(tmp_path)).inputFiles() == first.inputFiles()
    n = first.count()
    rows.where("c_custkey > 50").limit(40).write.mode("append").parquet(f"{tmp_path}/customer.parquet")
    assert queries._log(spark, str(tmp_path)).count() > n


def test_appended_dates_are_not_split_over_all_tasks(spark, tmp_path):
    days = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.col("id") % 5)
    log = spark.range(1000).repartition(16).select("id", days.alias("ts"))
    tables.append_audit_log(log, str(tmp_path))
    assert len(list(tmp_path.glob("event_date=*/*.parquet"))) == 5
    assert spark.read.parquet(str(tmp_path)).count() == 1000
