"""Small document tables for the tests of the operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: With columns whose names the operators use inside, and nulls in every column.
WIDE = DOCS + ", bucket string, kind int, fp string, spans string, slot int, `block` string, __id string, __score string, node string, `hash` int"


def docs(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["a"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)], DOCS)


def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows and clashing names."""
    long = "the quick brown fox jumps over the lazy dog again " * 4000
    rows = [(1, "same text here for all of us"), (2, "same text here for all of us"), (None, None), (None, "no id but text"), (3, None), (4, ""), (5, long), (6, long + "end"), (7, "é ß 😀 ü"), (7, "another with the same id"), (8, "x"), (8, "x")]
    return spark.createDataFrame([(i, t, None, None if i is None else "s", None, "b", None, "f", None, 1, "k", None, "q", "n", None) for i, t in rows], WIDE)


def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()] if columns else [tuple(r) for r in df.collect()]
