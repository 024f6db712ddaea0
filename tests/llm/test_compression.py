import numpy as np
import pyarrow as pa
from cases import TEXTS, docs
from pyspark.sql import functions as F

from auditflow.llm import compression
from auditflow.llm import queries as Q

SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    found = Q.QUERIES["op6_compression_quality"](spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", "quality", "predicted").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    assert (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2 >= 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert found.where("score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0


def model():
    return compression.CompressionModel(b"plain words that go on and on in a line " * 50, b"### $$$ %%% buy now!!! ### " * 50, 20.0, 0.0)


def test_cases(spark):
    found = {r["doc_id"]: r for r in compression.score(docs(spark), model()).collect()}
    assert len(found) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in found.values())
    assert found[0]["difference"] == found[1]["difference"] == 0 and found[0]["score"] == 0.5
    assert found[5]["score"] == found[6]["score"]
    assert compression.score(docs(spark, []), model()).count() == 0
    assert {r["score"] for r in compression.score(docs(spark), None).collect()} == {0.5}


def test_the_end_of_a_long_text_counts():
    work = compression.Sizes(model())
    head = "neither one nor other kind, 0123456789 " * 2000
    a, b = work.differences(pa.array([head + "### $$$ %%% buy now!!! " * 4000, head + "words that go on and on in a line " * 4000]))
    assert a < b


def test_few_labels(spark):
    table = docs(spark)
    labels = table.where("doc_id in (4, 5)").select("doc_id", (F.col("doc_id") == 4).cast("int").alias("quality"))
    assert compression.train(table, labels.limit(0)) is None and compression.train(table, labels.where("quality = 1")) is None
    found = compression.train(table, labels)
    assert found is None or all(np.isfinite([found.slope, found.shift]))


def test_whole_texts_are_learned_once_for_an_id(spark):
    word = "closing words that stand at the very end only "
    rows = [(k, f"{'neither one nor other, 0123456789 ' * 300}{word * 40}{k}", k % 2) for k in range(40)] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    chosen = compression._chosen(table, table.select("doc_id", F.col("quality").alias("y")))
    assert chosen.count() == 40
    made = compression._trained(pa.table({"y": pa.array([1] * 40, pa.int32()), "text": [r[1] for r in rows[:40]]}))
    assert made.num_rows == 1 and word.encode() in made.column("words")[0].as_py()
