import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, class_id string, spans string, __key string, `keep` string, topic string, size string"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, odd white space, other scripts."""
    rng = random.Random(5)
    base = " ".join(words(rng, 90))
    long = " ".join(words(rng, 60_000))
    texts = [
        (1, base), (2, base), (2, base), (3, base + " tail end"), (4, None), (5, ""), (6, "   \t\n"), (7, "one two"), (8, "one two"), (9, long), (None, base), (None, None),
        (10, " ".join(["same"] * 200)), (11, "line\x0bone\x0ctwo\x1cthree four"), (12, "\U00020000\U00020001 漢字 слово"), (13, " ".join(words(rng, 40)) + " " + " ".join(base.split()[10:60])),
        (14, "12345 !!! ---"), (-(2**63), "least id"), (2**63 - 1, "largest id"), (15, "é" * 3000), (5, "other text under a used id"),
    ]
    rows = []
    for n, (i, t) in enumerate(texts):
        rows.append((i, t, None if n % 4 == 0 else "en" if n % 4 < 3 else "fr", None if n % 5 == 0 else f"s{n % 3}", None if t is None else len(t), "x", None, "y", None, "z", "k", None, "0"))
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(edge, spark):
    return spark.createDataFrame([], edge.schema)
