import re
from collections import Counter

from cases import TEXTS, by_id, docs
from pyspark.sql import functions as F

from auditflow.llm import quality
from auditflow.llm import queries as Q

SF = "/root/testdata/sf0.01"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_counts_equal_brute_force(spark):
    found = by_id(quality.judge(docs(spark), None), *COUNTS)
    assert found == {k: brute(t) for k, t in enumerate(TEXTS)}


def test_counts_of_given_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = by_id(quality.judge(table, None), *COUNTS)
    assert found == {r["doc_id"]: brute(r["text"]) for r in table.collect()}


def test_verdict(spark):
    found = Q.QUERIES["op10_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where(~F.col("base_failed"))
    r = {x["quality"]: x["kept"] for x in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert r[1] >= 0.98 and r[0] <= 0.1
    assert found.where("score < 0 or score > 1 or score is null").count() == 0


def test_without_labels_the_base_rules_decide(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs(spark), labels) is None
    rows = quality.judge(docs(spark), None).collect()
    assert all(r["kept"] == (not r["base_failed"]) and r["score"] is None for r in rows)
    assert quality.judge(docs(spark, []), None).count() == 0


def test_filter_keeps_columns_and_null_ids(spark):
    table = docs(spark, ids=[None] * len(TEXTS))
    kept = quality.good(table, None)
    assert kept.columns == table.columns and kept.count() == sum(not brute(t)[-1] for t in TEXTS)
