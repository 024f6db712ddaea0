"""Bit-packed token files and token counts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import TEXTS, by_id, docs

from auditflow.llm import packing, token_count, vocab
from auditflow.llm import queries as Q

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
SIGNS = "abcdeé ñ'129!?.,#$ \n\t\x1c\x85\xa0ÀİςσΣ世🙂ªµ½́"


def library(text):
    return vocab.library_tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def odd_texts(n=1500):
    random.seed(6)
    return ["".join(random.choices(SIGNS, k=random.randint(1, 60))) for _ in range(n)] + ["<|startoftext|>a<|endoftext|> b", "thttion" * 400, "é" * 900, "it'S WE'LL"]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    raw = packing.pack(ids, bits)
    assert len(raw) == (1000 * bits + 7) // 8 and (packing.unpack(raw, 1000, bits) == ids).all()
    assert packing.pack(ids[:0], bits) == b"" and len(packing.unpack(b"", 0, bits)) == 0


def test_width():
    assert [packing.width(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access_in_a_segment():
    ids = np.random.default_rng(1).integers(0, 5000, 20_000, dtype=np.uint64).astype(np.uint32)
    sizes = np.array([7000, 0, 12_999, 1])
    raw = packing.segment(3, 1, [4, None, 9, 9], sizes, ids, 13)
    (found,) = packing.segments(raw + b"\n")
    assert found.doc_ids == [4, None, 9, 9] and found.starts.tolist() == [0, 7000, 7000, 19_999, 20_000]
    for i, j in ((0, 1), (4095, 4097), (0, 20_000), (19_999, 20_000), (5, 5)):
        assert (found.ids(i, j) == ids[i:j]).all()
    with pytest.raises(ValueError):
        packing.Segment(memoryview(raw[:100] + bytes([raw[100] ^ 1]) + raw[101:]))


def test_ids_equal_the_library():
    texts = [t for t in TEXTS if t is not None] + odd_texts()
    ids, sizes = packing.WordEncoder(PATH, remembered=500).encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for text, end, n in zip(texts, ends, sizes, strict=True):
        assert ids[end - n : end].tolist() == library(text)


@pytest.mark.parametrize("segment_ids", [1000, packing.SEGMENT_IDS])
def test_files(spark, tmp_path, segment_ids):
    folder = f"file://{tmp_path}/t"
    rows = [*range(len(TEXTS)), None, 5]
    packing.write(docs(spark, [*TEXTS, "no id", "again"], rows), folder, PATH, 2, segment_ids)
    found = sorted(packing.read(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, 0, 1, 2, 3, 4, 5, 5, *range(6, len(TEXTS))]
    texts = ["no id", *TEXTS[:5], *sorted([TEXTS[5], "again"]), *TEXTS[6:]]
    start = 0
    for row, text in zip(found, texts, strict=True):
        want = [*library(text), 2]
        assert (row["start"], row["n_tokens"]) == (start, len(want))
        assert np.frombuffer(row["ids"], "<u4").tolist() == want
        start += len(want)


def test_no_documents(spark, tmp_path):
    packing.write(docs(spark, []), f"file://{tmp_path}/e", PATH, 2)
    assert packing.read(spark, f"file://{tmp_path}/e").count() == 0


def test_file_query(spark):
    found, start = by_id(Q.QUERIES["op5_token_files"](spark, SF), "start", "n_tokens", "ids_crc32"), 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        want = np.array([*library(r["text"]), 2], "<u4")
        assert found[r["doc_id"]] == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_counts_equal_the_library(spark):
    texts = [*TEXTS, *odd_texts()]
    found = by_id(token_count.count_tokens(docs(spark, texts), PATH), "n_bytes", "n_tokens")
    assert found == {k: (len((t or "").encode()), len(library(t))) for k, t in enumerate(texts)}
    assert token_count.count_tokens(docs(spark, []), PATH).count() == 0


@pytest.mark.parametrize("size", [1, 7, 50])
def test_chunk_maps_compose(size):
    work = token_count.Counter(PATH)
    for text in odd_texts(300):
        assert work.long(text, size) == len(library(text))


def test_chunk_maps_are_associative():
    work = token_count.Counter(PATH)
    for text in odd_texts(100):
        a, b, c = (work.chunk(text[k : k + 20]) for k in (0, 20, 40))
        left, right = a.then(b, work.word).then(c, work.word), a.then(b.then(c, work.word), work.word)
        assert left.total(work.word) == right.total(work.word) == len(library(text[:60]))


def test_few_states_change_nothing():
    work = token_count.Counter(PATH)
    work.transducer.limit = 50
    for text in odd_texts(200):
        assert work.column(pa.array([text]))[0] == len(library(text))


def test_count_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = by_id(Q.QUERIES["op8_token_counts"](spark, SF), "n_bytes", "n_tokens", "over_limit")
    assert found == {k: (len(t.encode()), n, n > 2048) for k, t in texts.items() for n in [len(library(t))]}


def test_words_of_all_kinds_equal_the_library():
    rnd = random.Random(5)
    pool = ["'s", "'re", "'", "''", '"', "a", "Word", "DON'T", "it'S", "l'été", "'llama", "'ll", "'v", "'ve9", "12", "3", "<|endoftext|>", "<|", "é", "É", "×", "÷", "ß", "ÿ", "Ö", "\x1c", "\x85",
            "\xa0", "İ", "é", "字", "🙂", "\n", " ", " ", "  ", "-", "--", "A", "z'd", "'d'm", "\x7f", "\x00", "¿"]
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 40))) for _ in range(4000)] + [None, "", "'", " '", "'s", "x'", "'l", "'r e"]
    ids, sizes = packing.WordEncoder(PATH).encode(pa.array(texts))
    library, at = vocab.library_tokenizer(PATH), 0
    for text, n in zip(texts, sizes, strict=True):
        assert ids[at : at + n].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
        at += n
