"""Small tables that hold every awkward case."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns whose names the operators use for their own.
CLASHING = [
    "start", "length", "loss", "ids", "offset", "sequence_id", "key", "rep", "n", "unit", "cuts", "grp", "qb", "rb", "part", "rank", "score",
    "component", "label", "n_shingles", "left", "right", "_block", "held_out", "accepted", "counts", "value", "order", "kind", "node", "quality",
]

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def words(n: int, seed: int, alphabet: str = "abcdefghij") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 8))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    base = words(60, 1)
    return [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base.replace(" ", "  ", 1) + "\n", None, None),
        (4, None, "en", "a"),
        (5, "", "en", "a"),
        (6, " \t\n ", None, "b"),
        (7, "one two", "en", "a"),
        (7, "one two", "en", "a"),
        (None, words(30, 2), "en", None),
        (8, words(20_000, 3), "en", "a"),
        (9, "x" * 5_000, "en", "a"),
        (10, "é ñ 日本語   😀́ it's we'll I'd\r\n", "fr", "b"),
        (11, "123 456 !!! <|endoftext|> <|startoftext|>x", None, "b"),
    ]


def awkward(spark, extra: bool = True):
    docs = spark.createDataFrame(awkward_rows(), DOCS)
    return docs.withColumns({c: F.lit(1) for c in CLASHING}) if extra else docs


def empty(spark):
    return spark.createDataFrame([], DOCS)


def sentences(language: str, n: int, seed: int) -> str:
    """Invented text with the syllables of a made-up language."""
    syllables = {"en": ["the", "ing", "and", "wh", "er", "st"], "fr": ["eau", "oi", "que", "re", "ent", "é"], "de": ["sch", "ung", "ver", "ein", "ß", "ü"]}[language]
    r = random.Random(seed)
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))
