import hashlib

import pytest
from cases import TEXTS, docs

import __spark_entry__
import corpus_pipeline
from auditflow.llm import decontam, simhash, vocab
from auditflow.llm import queries as Q

SF = "/root/testdata/sf0.01"


def test_registered():
    queries = __spark_entry__.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "bpe"]
    assert queries["pipeline"] is corpus_pipeline.run and set(Q.QUERIES) <= set(queries)
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, clean = [table.count()], table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        clean = stage(spark, clean, SF)
        assert clean.columns == table.columns
        clean = clean.cache()
        sizes.append(clean.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3] and sizes[4] > 400
    found = simhash.near_duplicates(clean)
    assert found.select("component_id").distinct().count() == sizes[4]
    assert decontam.leaks(clean, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    import public_tokenizers

    work = vocab.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["ids"] == work.encode(text, add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("texts", [TEXTS, []])
def test_odd_and_empty_tables_go_through(spark, texts):
    table = docs(spark, texts)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        assert table.columns == docs(spark).columns
    assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() <= len(texts)
