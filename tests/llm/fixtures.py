"""Small tables that hold the awkward rows, and brute-force versions."""

import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 977} and {i % 89}" for i in range(40_000))
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(texts, lang="en", source="s"):
    return [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]


AWKWARD = [None, "", "   \n\t", "a", "one two three", "é ü 中文 İstanbul ſ K", "!!! ... ---", LONG, "same text here twice", "same text here twice", "\x00nul\x1fbytes", "😀" * 50]


def documents(spark, texts=AWKWARD, more=()):
    """The texts by number, then repeated rows, a null id and nulls in all other columns."""
    data = [*rows(texts), (3, "a", "en", "s", 1), (None, "a null id has this text", None, None, None), *more]
    return spark.createDataFrame(data, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
