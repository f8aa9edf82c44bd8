import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.llm import mixing as M


def _docs(spark, n=1500, seed=1):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(1, 60) + rng.choice(["", "\n" * 5, "123456 7890"]), rng.choice(["en", "en", "en", "de"]), rng.choice(["hot", "hot", "a", "b"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)


def test_rake_meets_targets():
    rng = random.Random(2)
    cells = [(s, ln, t) for s in "abc" for ln in "xy" for t in "pq"]
    tokens = np.array([rng.randint(1, 900) for _ in cells], float)
    targets = {"source": {"a": 0.5, "b": 0.25, "c": 0.25}, "lang": {"x": 0.7}, "topic": 0.0}
    w = M.rake(cells, tokens, targets, rounds=200)
    assert np.isclose(w.sum(), tokens.sum())
    share = lambda i, c: w[[x[i] == c for x in cells]].sum() / w.sum()
    assert np.allclose([share(0, "a"), share(0, "b"), share(1, "x"), share(2, "p")], [0.5, 0.25, 0.7, 0.5])


def test_raking_stops_at_the_tolerance_and_reports():
    cells, tokens = [("a", "x", "p"), ("a", "y", "p"), ("b", "x", "p"), ("b", "y", "p")], np.array([10.0, 20, 30, 5])
    found: dict = {}
    w = M.rake(cells, tokens, {"source": 0.0, "lang": 0.0, "topic": 1.0}, report=found)
    assert found["residual"] <= M.TOLERANCE and 2 < found["rounds"] < 60 and np.allclose([w[:2].sum(), w[::2].sum()], 32.5)
    # contradicting targets: all of language x in b, none of it allowed there
    M.rake([("a", "y", "p"), ("b", "x", "p")], np.array([5.0, 5.0]), {"source": {"a": 1.0, "b": 0.0}, "lang": {"x": 1.0, "y": 0.0}, "topic": 1.0}, rounds=30, report=found)
    assert found["rounds"] == 30 and found["residual"] > 0.5


def test_probabilities_spend_the_budget():
    rng = np.random.default_rng(3)
    for fraction in (0.05, 0.5, 0.95):
        t, w = rng.integers(1, 99, 30).astype(float), rng.random(30)
        p = M.probabilities(w, t, fraction)
        assert (0 <= p).all() and (p <= 1).all() and np.isclose((p * t).sum(), fraction * t.sum())
        free = p < 1
        assert np.allclose((p * t / w)[free], (p * t / w)[free][0])
    assert (M.probabilities(np.array([0.0, 1.0]), np.array([5.0, 5.0]), 0.9) == [0, 1]).all()


def test_sample_meets_the_mix(spark):
    targets = {"source": {"hot": 0.2, "a": 0.4, "b": 0.4}, "lang": 1.0, "topic": 1.0}
    got = M.mix(_docs(spark, 6000), targets, fraction=0.4)
    assert got.count() == 6000
    kept = {r[0]: r[1] for r in got.where("keep").groupBy("source").agg(F.sum("n_tokens")).collect()}
    assert abs(kept["hot"] / sum(kept.values()) - 0.2) < 0.04
    assert abs(sum(kept.values()) / got.agg(F.sum("n_tokens")).first()[0] - 0.4) < 0.04
    more = M.mix(_docs(spark, 6000), targets, fraction=0.5).where("keep")
    assert got.where("keep").join(more, "doc_id", "left_anti").count() == 0


@pytest.mark.parametrize("targets", [{}, {"source": {"hot": 0.2, "none": 0.3}, "lang": {"de": 0.6, "en": 0.4}, "topic": 0.5}])
def test_many_cells_give_the_same(spark, targets):
    docs, a, b = _docs(spark, 300), {}, {}
    one = {r["doc_id"]: r["probability"] for r in M.mix(docs, targets, rounds=12, report=a).collect()}
    other = {r["doc_id"]: r["probability"] for r in M.mix(docs, targets, rounds=12, max_cells=0, report=b).collect()}
    assert one.keys() == other.keys() and np.allclose([one[i] for i in one], [other[i] for i in one])
    assert abs(a["residual"] - b["residual"]) < 1e-9 and abs(a["rounds"] - b["rounds"]) <= 1


def test_topics_from_a_column_and_narrow_facts(spark):
    docs = _docs(spark, 400).withColumn("theme", F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")))
    wide = M.mix(docs, topic="theme")
    narrow = M.mix(docs, topic="theme", columns=["doc_id"])
    assert narrow.columns == ["doc_id", "topic", "n_tokens", "probability", "keep"] and {r[0] for r in narrow.select("topic").distinct().collect()} == {"t0", "t1", "t2"}
    assert sorted(narrow.collect()) == sorted(wide.select(*narrow.columns).collect())
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "regexp_count" not in plan and "text" not in plan  # texts were scanned before, once


def test_topics(one):
    got = [one(lambda c: M.topic_of("t"), x) for x in (None, "", "a\nb", "no breaks here 1", "abc 12 " * 5, "x" * 100 + "\n")]
    assert got == ["empty", "empty", "lines", "figures", "figures", "prose"]


def test_edges(edge, empty):
    got = M.mix(edge)
    assert got.count() == edge.count() and got.where("probability is null or keep is null").count() == 0
    assert got.columns.count("topic") == 1 and {"score", "__key", "class_id"} <= set(got.columns)
    assert M.mix(empty).count() == 0
