"""Source divergence audit: how the word use of each source departs from its language's and from other sources'.

Terms are runs of ASCII letters (in lower case) and of signs beyond ASCII.  A language keeps the terms that
stand in at least MIN_DOCS of its documents.  The kept terms, sorted, are compiled into minimal acyclic
transducers (``transducer.py``); then all texts are streamed through them and counted by the
terms' lexicographic ordinals.  From there on only ordinals travel: shares, divergences and ties
are worked out on numbers, and the few reported terms get their letters back at the end.

Sizes.  Terms are counted per slice of texts and combined in the map tasks before they are shuffled;
ordinals come from a range partitioning.  A transducer holds at most PIECE_TERMS terms, and is
built in a task.  The transducers go to the tasks PASS_BYTES at a time, measured: a vocabulary
beyond that is another run over the texts, not a larger broadcast.  Pairs of sources are
worked out by blocks of ordinals, each a matrix of at most BLOCK_CELLS cells, so a language that
holds most of the rows is many blocks; the result has a row for each two sources of a language, as asked.

Whole numbers throughout: shares have decimals of 38 digits inside, values are longs.

Defined cases: null text, lang and source count as empty strings; each row is a document, also one that repeats; a group
without kept terms has counts of zero; a language without kept terms gives its pairs the value 0 and no
terms; a source alone in its language has no pairs; ties stand in the order of UTF-8 bytes;
an empty table gives no rows; a run of letters of any length is one term; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditflow.functions import lineage
from auditflow.llm import text as T
from auditflow.llm import transducer
from auditflow.operators.auditlog import assign_log_ids

MIN_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
PIECE_TERMS = 1 << 18
PASS_BYTES = 64 << 20
BLOCK_TERMS, BLOCK_CELLS = 4096, 1_000_000
#: Groups and ordinals that a task holds before it hands them on.
_HELD = 1 << 20
_SLICE = 2 << 20
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[0x41:0x5B] = _NO_LETTER[0x61:0x7B] = _NO_LETTER[0x80:] = False


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, starts and ends of all terms, and the row of each."""
    data, offsets = T.utf8(column)
    data = T.LOWER[data]
    starts, ends, first = T.words(data, offsets, _NO_LETTER)
    return data, starts, ends, np.repeat(np.arange(len(column)), np.diff(first))


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = pc.fill_null(column, "").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term, n: in how many documents of its language a term stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text", _SLICE, 4096):
            data, starts, ends, row = _terms(batch.column("text"))
            if not len(starts):
                continue
            ends_of = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            letters = np.ascontiguousarray(data[~_NO_LETTER[data]])
            words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends_of), pa.py_buffer(letters)]).dictionary_encode()
            size = len(words.dictionary)
            once = np.unique(row * size + words.indices.to_numpy(zero_copy_only=False))  # a term counts once in a document
            lang, names = _codes(batch.column("lang"))
            key, n = np.unique(lang[once // size] * size + once % size, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(key // size)), words.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(n)], ["lang", "term", "n"])

    found = docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS, piece_terms: int = PIECE_TERMS) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, term, ordinal, piece) and the languages that have any (lang, terms)."""
    kept = document_frequencies(docs).where(F.col("n") >= min_docs).select("lang", "term")
    placed = lineage.written(assign_log_ids(kept, ["lang", "term"]))
    langs = placed.groupBy("lang").agg(F.min("id").alias("first"), F.count("*").alias("terms"))
    ordinal = F.col("id") - F.col("first")
    terms = placed.join(langs, "lang").select("lang", "term", ordinal.alias("ordinal"), F.floor(ordinal / piece_terms).cast("int").alias("piece"))
    return lineage.written(terms), langs.select("lang", "terms")


_PIECE = "lang string, piece int, size long, low binary, high binary, base binary, final binary, cells binary, start long"


def compiled(terms: DataFrame) -> DataFrame:
    """A transducer for each language and piece of ``terms``, written."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        sorted_terms = sorted(t.encode() for t in table.column("term").to_pylist())
        t = transducer.build(sorted_terms)
        row = [key[0].as_py(), key[1].as_py(), t.size, *(a.tobytes() for a in t[:5]), t.start]
        kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.int64()]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["lang", "piece", "size", "low", "high", "base", "final", "cells", "start"])

    return lineage.written(terms.groupBy("lang", "piece").applyInArrow(run, _PIECE))


def _passes(pieces: DataFrame, most: int) -> Iterator[list[tuple[str, int]]]:
    """The pieces, at most ``most`` bytes at a time (or a single one)."""
    held, size = [], 0
    for r in pieces.select("lang", "piece", "size").orderBy("piece", "lang").toLocalIterator():
        if held and size + r["size"] > most:
            yield held
            held, size = [], 0
        held.append((r["lang"], r["piece"]))
        size += r["size"]
    if held:
        yield held


def _loaded(pieces: DataFrame, names: list[tuple[str, int]]):
    """The named pieces as one transducer, and layers: for each a start state and a first ordinal's piece by language."""
    chosen = pieces.where(F.struct("piece", "lang").between(*(F.struct(F.lit(p).cast("int").alias("piece"), F.lit(lang).alias("lang")) for lang, p in (names[0], names[-1]))))
    rows = sorted(chosen.collect(), key=lambda r: (r["lang"], r["piece"]))
    kinds = (np.uint8, np.uint8, np.int64, bool, np.int64)
    parts = [transducer.Transducer(*(np.frombuffer(r[c], k) for c, k in zip(("low", "high", "base", "final", "cells"), kinds, strict=True)), r["start"]) for r in rows]
    whole, begin = transducer.together(parts)
    layers: list[dict[str, tuple[int, int]]] = []
    depth: dict[str, int] = {}
    for r, start in zip(rows, begin, strict=True):
        k = depth[r["lang"]] = depth.get(r["lang"], -1) + 1
        layers += [{}] * (k == len(layers))
        layers[k] = layers[k] | {r["lang"]: (start, r["piece"])}
    return whole, layers


def recounted(docs: DataFrame, pieces: DataFrame, piece_terms: int = PIECE_TERMS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """lang, source, ordinal, n: how often each kept term stands in each group; texts are streamed through the transducers."""
    spark = docs.sparkSession
    schema = "lang string, source string, ordinal long, n long"
    found = spark.createDataFrame([], schema)
    for names in _passes(pieces, pass_bytes):
        shipped = spark.sparkContext.broadcast(_loaded(pieces, names))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            whole, layers = shipped.value
            groups: dict[tuple[str, str], int] = {}
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def emit() -> pa.RecordBatch:
                keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)  # below 2^53: exact
                known, of = list(groups), pa.array(keys >> 40)
                return pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in known], pa.string()).take(of), pa.array([g[1] for g in known], pa.string()).take(of), pa.array(keys & ((1 << 40) - 1)), pa.array(counts)],
                    ["lang", "source", "ordinal", "n"])

            for batch in T.slices(batches, "text", _SLICE, 4096):
                lang, lang_names = _codes(batch.column("lang"))
                source, source_names = _codes(batch.column("source"))
                both, group = np.unique(lang * len(source_names) + source, return_inverse=True)
                group = np.array([groups.setdefault((lang_names[b // len(source_names)], source_names[b % len(source_names)]), len(groups)) for b in both])[group]
                data, starts, ends, row = _terms(batch.column("text"))
                hits = []
                for layer in layers:
                    first = np.array([layer.get(name, (0, 0)) for name in lang_names], np.int64)
                    mine = np.flatnonzero(first[lang[row], 0])
                    at = row[mine]
                    ordinal = transducer.ordinals(whole, first[lang[at], 0], data, starts[mine], ends[mine])
                    hit = ordinal >= 0
                    hits.append((group[at[hit]] << 40) + first[lang[at[hit]], 1] * piece_terms + ordinal[hit])
                held.append(np.unique(np.concatenate(hits), return_counts=True))
                if sum(len(k) for k, _ in held) > _HELD:
                    yield emit()
                    groups, held = {}, []
            if held:
                yield emit()

        langs = sorted({lang for lang, _ in names})
        mine = docs.where(F.col("lang").isin(langs)) if len(langs) <= 1000 else docs
        found = found.unionByName(lineage.written(mine.select("lang", "source", "text").mapInArrow(run, schema).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))))
        shipped.unpersist()
    return found


def share(count, total, terms):
    """1 + floor(UNIT (count + 1) / (total + terms)), exactly."""
    above = (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return (F.lit(1) + F.call_function("div", above, (total + terms).cast("decimal(20,0)"))).cast("long")


def departure(p, q):
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(key: tuple, table: pa.Table) -> pa.Table:
    """For one block of ordinals: the summed departure of each source from each other one."""
    coded = table.column("source").combine_chunks().dictionary_encode()
    names, who = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    at, p = (table.column(c).to_numpy() for c in ("at", "p"))
    usual = at < 0
    width = int(table.column("width").to_numpy().max())
    shares = np.zeros((len(names), width), np.int64)
    shares[who[usual]] = p[usual][:, None]
    shares[who[~usual], at[~usual]] = p[~usual]
    a, b, value = [], [], []
    for k in range(len(names)):
        gap = shares[k] - shares
        total = (gap * gap // shares).sum(axis=1)
        others = np.flatnonzero(np.arange(len(names)) != k)
        a.append(np.full(len(others), k)), b.append(others), value.append(total[others])
    a, b, value = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, value))
    return pa.table([pa.array([key[0].as_py()] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, piece_terms: int = PIECE_TERMS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source)."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    terms, langs = vocabulary(docs, min_docs, piece_terms)
    counts = recounted(docs, compiled(terms), piece_terms, pass_bytes)

    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = lineage.written(groups.select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms")))
    own = lineage.written(counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "ordinal", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")))

    # The terms that a source uses more than its language does.
    all_totals = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("terms").alias("terms"))
    usual = own.groupBy("lang", "ordinal").agg(F.sum("n").alias("n")).join(all_totals, "lang").select(
        "lang", "ordinal", share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    more = own.join(usual, ["lang", "ordinal"]).where("p > q").select("lang", "source", "ordinal", departure(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal"))  # ordinals stand as the terms do
    first = more.withColumn("rank", rank).where(F.col("rank") <= top)
    by_term = first.join(terms.select("lang", "ordinal", "term"), ["lang", "ordinal"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # Each two sources, by blocks of ordinals: a row for each share, and one for what all other terms of the block have.
    shape = groups.where("terms > 0").groupBy("lang").agg(F.count("*").alias("sources"), F.first("terms").alias("of")).select(
        "lang", F.col("of"), F.expr(f"greatest(1L, least({BLOCK_TERMS}L, {BLOCK_CELLS} div sources))").alias("wide"))
    none = groups.where("terms > 0").join(shape, "lang").select(
        "lang", "source", "wide", "of", F.explode(F.expr("sequence(0L, (of - 1) div wide)")).alias("block"), F.lit(-1).cast("long").alias("at"),
        share(F.lit(0), F.col("total"), F.col("terms")).alias("p"))
    some = own.join(shape, "lang").select("lang", "source", "wide", "of", F.expr("ordinal div wide").alias("block"), F.expr("ordinal % wide").alias("at"), "p")
    blocks = none.unionByName(some).select("lang", "block", "source", "at", "p", F.expr("least(wide, of - block * wide)").alias("width"))
    sums = blocks.groupBy("lang", "block").applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("terms = 0").select("lang", "source")
    nothing = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    by_pair = sums.unionByName(nothing).select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
    return by_pair.unionByName(by_term)
