import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from cases import TEXTS, by_id, docs

from auditflow.llm import bpe, vocab
from auditflow.llm import queries as Q

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SIGNS = "abcdeé ñ'129!?.,#$ \n\t\x1c\x85\xa0 ς世🙂"


def library(text):
    return vocab.library_tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def odd_texts(n=1500):
    random.seed(4)
    return ["".join(random.choices(SIGNS, k=random.randint(1, 90))) for _ in range(n)] + ["it's  we'll\n\n 'RE  <|endoftext|>x", "ab" * 3000, " " * 300 + "x", "z\n" * 500]


@pytest.mark.parametrize("mean", [4, 16, 512])
def test_ids_equal_the_library(mean):
    work = bpe.Encoder(PATH)
    texts = [t for t in TEXTS if t is not None and len(t) < 10_000] + odd_texts()
    for text, chunks in zip(texts, bpe.chunked(pa.array(texts), mean), strict=True):
        assert "".join(chunks) == text and work.encode(chunks).tolist() == library(text)


def test_shared_chunks_are_encoded_once():
    work = bpe.Encoder(PATH)
    passage = " ".join(f"word{k * 7919 % 1000} of passage" for k in range(400))
    for text in (passage, "Something in front. " + passage, "Else " + passage + " and behind", passage):
        assert work.encode(next(bpe.chunked(pa.array([text])))).tolist() == library(text)
    assert work.stats["encoded"] < work.stats["chunks"] / 2


def test_little_memory_changes_nothing():
    work = bpe.Encoder(PATH, remembered=2000)
    for text in odd_texts(100):
        assert work.encode(next(bpe.chunked(pa.array([text]), 8))).tolist() == library(text)


def test_round_trip(spark):
    found = by_id(bpe.decode(bpe.encode(docs(spark), PATH), PATH), "ids", "decoded")
    assert found == {k: (library(t), t or "") for k, t in enumerate(TEXTS)}
    assert found == by_id(bpe.round_trip(docs(spark), PATH), "ids", "decoded")
    assert bpe.decode(bpe.encode(docs(spark, []), PATH), PATH).count() == 0


def test_decode_like_the_library(spark):
    rows = [(1, [50256, 0, 1]), (2, [447, 12]), (3, None), (4, []), (5, [60000, -1, 33])]
    found = by_id(bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH), "decoded")
    decode = vocab.library_tokenizer(PATH).decode
    assert found == {1: decode([50256, 0, 1], skip_special_tokens=False), 2: decode([447, 12], skip_special_tokens=False), 3: "", 4: "", 5: decode([33])}


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = by_id(Q.QUERIES["op3_bpe"](spark, SF), "n_tokens", "ids_sha256", "decoded_sha256")

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert found == {k: (len(library(t)), digest(",".join(map(str, library(t)))), digest(t)) for k, t in texts.items()}


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " \n", "\u2003"])
def test_long_runs_of_blanks(blank):
    work = bpe.Encoder(PATH)
    for text in (blank * 5_000_000, "a" + blank * 1_200_000 + "word" + blank * 3 + "end" + blank, blank * 2 + "x" + blank * 2, "a  b\n\n\nc \t d\x1c\x1c e\xa0 f"):
        chunks = next(bpe.chunked(pa.array([text])))
        assert work.encode(chunks).tolist() == vocab.library_tokenizer(PATH).encode(text, add_special_tokens=False).ids
