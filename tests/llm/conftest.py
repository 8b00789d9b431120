import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    *[T.StructField(c, T.StringType()) for c in ("shard", "slot", "score", "h", "_d", "key", "rep", "evidence", "lang_pred", "copies")],
])
EXTRA = (None,) * 10


def prose(seed: int, n: int) -> str:
    """Words that hardly repeat from text to text."""
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 7))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls everywhere, empty and blank texts, one very long text, ties and repeated rows."""
    base, passage = prose(1, 120), prose(2, 45)
    texts = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, base + " tail", "en", "b"), (3, prose(3, 60) + " " + passage + " " + prose(4, 60), "de", "b"),
        (4, passage + " " + prose(5, 30), None, None), (5, "", "en", "a"), (6, None, "en", "a"), (7, " \t\n\x0b\x0c\r ", "de", "c"),
        (8, "one two", "de", "c"), (9, "123 ... 456", "en", "c"), (10, prose(6, 30_000), "en", "a"), (11, "ab " * 400, "de", "a"),
        (12, "éß \U0001f600 中文 " * 30, "de", "b"), (13, passage + " " + passage, "en", "b"),
        (None, prose(7, 50), "en", "a"), (None, None, None, None), (14, prose(8, 40), "en", "a"), (14, prose(8, 40), "en", "a"), (14, prose(9, 40), "en", "a"),
    ]
    return [(d, t, lang, s, None if t is None else len(t), *EXTRA) for d, t, lang, s in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)
