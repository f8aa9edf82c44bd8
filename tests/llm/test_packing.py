import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkspan.llm import common as C, packing as P


def padding(hist, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in hist)


@pytest.mark.parametrize("seed", range(60))
def test_bounds_equal_all_choices(seed):
    rng = random.Random(seed)
    hist = sorted((x, rng.randint(1, 9)) for x in rng.sample(range(0, 40), rng.randint(1, 9)))
    k = rng.randint(1, 5)
    got = P.best_bounds(hist, k)
    top = hist[-1][0]
    best = min(padding(hist, (*c, top)) for n in range(min(k, len(hist))) for c in itertools.combinations([x for x, _ in hist[:-1]], n))
    assert len(got) <= k and got == sorted(set(got)) and padding(hist, got) == best


def test_no_histogram():
    assert P.best_bounds([], 3) == []


def test_batches(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([0, 1, 5, 5, 5, 40, 300])) for i in range(400)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), buckets=3, budget=100).collect()
    assert {r["doc_id"] for r in got} == set(range(400))
    held = {}
    for r in got:
        assert 0 <= r["padding"] == r["bucket_len"] - r["n_tokens"]
        held.setdefault((r["bucket"], r["batch"]), []).append(r)
    for rs in held.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or len(rs) * rs[0]["bucket_len"] <= 100 or rs[0]["bucket_len"] <= 1
    for b in {k[0] for k in held}:
        order = [r for r in sorted(got, key=lambda r: (r["batch"], r["slot"])) if r["bucket"] == b]
        assert order == sorted(order, key=lambda r: (r["n_tokens"], r["doc_id"]))
        full = max(len(v) for k, v in held.items() if k[0] == b)
        assert sum(len(v) < full for k, v in held.items() if k[0] == b) <= 1


def test_long_lengths_are_rounded(spark, monkeypatch):
    monkeypatch.setattr(P, "BINS", 10)
    rows = [(i, "w " * (i * 3)) for i in range(50)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=4).collect()
    assert len(got) == 50 and all(r["padding"] >= 0 for r in got) and len({r["bucket"] for r in got}) <= 4


def test_one_huge_text_leaves_the_bounds_exact(spark):
    lengths = [*(1 + i % 100 for i in range(300)), 7 * P.BINS + 5]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    got = P.pack(rows.withColumn("text", F.lit(None).cast("string")), buckets=4, tokens=F.col("n")).collect()
    hist = sorted(Counter(lengths).items())
    tops = [x for x, _ in hist[:-1]]
    best = min(padding(hist, (*c, hist[-1][0])) for c in itertools.combinations(tops, 3))
    assert {r["bucket_len"] for r in got} <= set(lengths) and sum(r["padding"] for r in got) == best


def test_edges(edge, empty):
    got = P.pack(edge).collect()
    want = sorted(len(re.findall(C.WORD_PATTERN, r["text"] or "")) for r in edge.collect())
    assert sorted(r["n_tokens"] for r in got) == want
    assert P.pack(empty).count() == 0
