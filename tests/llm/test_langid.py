import random

import numpy as np
import pyarrow as pa
from cases import TEXTS, docs
from pyspark.sql import functions as F

from auditflow.llm import langid
from auditflow.llm import queries as Q

SF = "/root/testdata/sf0.01"
WORDS = {
    "en": "the and that with from have this which their would there about", "de": "der und die nicht mit sich auch werden eine einen durch über",
    "fr": "les des une dans pour avec sur était cette leur français être", "es": "los las una para con del más pero este también años niño",
}


def sample(spark, n=60):
    random.seed(5)
    rows = [(f"{lang}{k}", " ".join(random.choices(words.split(), k=30)), lang) for lang, words in WORDS.items() for k in range(n)]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string")


def test_families_then_pairs(spark):
    model = langid.train(sample(spark))
    assert sorted(x for f in model.families for x in f) == ["de", "en", "es", "fr"]
    assert len(model.pairs) == sum(len(f) * (len(f) - 1) // 2 for f in model.families)
    found = langid.identify(sample(spark), model).collect()
    assert all(r["doc_id"].startswith(r["lang_pred"]) and 0 <= r["score"] <= 1 for r in found)


def test_given_families(spark):
    model = langid.train(sample(spark), families=[["en", "de"], ["fr", "es"]])
    assert model.families == (("de", "en"), ("es", "fr")) and model.pairs == (("de", "en"), ("es", "fr"))


def test_cases(spark):
    model = langid.train(sample(spark))
    found = {r["doc_id"]: r for r in langid.identify(docs(spark), model).collect()}
    assert len(found) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        letters = any(c.isalpha() for c in text or "")
        assert (found[k]["lang_pred"] != "und") == letters
        assert found[k]["score"] == 0 if not letters else 0 <= found[k]["score"] <= 1
    assert found[5]["lang_pred"] == found[6]["lang_pred"] and found[5]["score"] == found[6]["score"]
    assert langid.identify(docs(spark, []), model).count() == 0
    kept = langid.identified(docs(spark), model, 0.0)
    assert kept.columns == docs(spark).columns and {r["doc_id"] for r in kept.collect()} == {k for k in found if found[k]["lang_pred"] != "und"}


def test_no_labels_one_label(spark):
    none = langid.train(docs(spark))
    assert {r["lang_pred"] for r in langid.identify(docs(spark), none).collect()} == {"und"}
    one = langid.train(docs(spark).withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in langid.identify(docs(spark), one).collect()} == {"en", "und"}


def test_long_text_counts_to_its_end():
    part = " ".join(WORDS["de"].split() * 40)
    a, b = langid.features(pa.array([part + WORDS["en"] * 2000, part]))
    assert np.abs(a - b).sum() > 0.5


def test_held_out_accuracy(spark):
    found = Q.QUERIES["op1_language_id"](spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    right = found.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = right.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert r[0] >= 0.97 and r[1] > 100 and right.count() == 1000
