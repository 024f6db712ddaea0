"""Rows that every operator must bear: nulls, empty, blank, long and repeated texts, further columns."""

from pyspark.sql import types as T

LONG = "a long line of plain words that goes on\n" * 4000

TEXTS = [
    None, "", "   \n\t ", "word", "Two words", "A sentence of some ten words that all differ from others here.",
    "A sentence of some ten words that all differ from others here.", "été à la française, déjà vu: garçon", "1234 5678 !!! ###",
    "日本語のテキスト と 中文 🙂", "x" * 5000, LONG, LONG + "tail", "it's <|endoftext|> we'll\x1c\x85 end", "İstanbul ΑΣ ﬁ",
]

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("component_id", T.StringType()),
    T.StructField("fp", T.StringType()), T.StructField("__x", T.StringType()),
])


def docs(spark, texts=None, ids=None):
    """A table of documents with columns whose names the operators use inside."""
    texts = TEXTS if texts is None else texts
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "s", None, "c", None, "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
