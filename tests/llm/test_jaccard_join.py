import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.llm import common as C, jaccard_join as J


def shingles(text, k=5):
    w = re.findall(C.WORD_PATTERN, text or "")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, threshold=0.8):
    """Of each row (id, text): (class_id, n_links, n_copies)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    out = []
    for i, (_, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0] if not sets[i] else min(ids, default=None), links[i], sum(bool(sets[i]) and s == sets[i] for s in sets) or 1))
    return out


def corpus(seed, groups=25):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(5, 150))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:4] for r in J.jaccard_join(df).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)


@pytest.mark.parametrize("many", [48, 6])
def test_large_group_in_blocks(spark, monkeypatch, many):
    """A group of alike texts larger than leaves and blocks, and many texts that share a long passage."""
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "SKETCH_BLOCK", 20)
    monkeypatch.setattr(J, "_MANY", many)
    for name, value in {"FIRST": 1, "COPIES": 3, "SMALLEST": 5, "LARGEST": 30}.items():
        monkeypatch.setattr(J, name, value)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(70):
        copy = list(base)
        copy[rng.randrange(120)] = f"c{i}"
        rows.append(" ".join(copy))
    for i in range(40):
        rows.append(" ".join([*(f"u{i}.{j}" for j in range(40)), *base[:60]]))
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:4] for r in J.jaccard_join(df, leaf=8).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)


def test_copies_are_bounded(spark):
    got = {r["id"]: r["n"] for r in spark.createDataFrame([(x,) for x in (257, 2500, 20_000, 131_072, 10**7)], "id long").withColumn("n", J.blocks_of(F.col("id"))).collect()}
    assert got == {257: 5, 2500: 32, 20_000: 32, 131_072: 32, 10**7: 2442}


def test_least_of_components():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60):
        rows = np.sort(rng.choice(n, max(1, n // 2), replace=False))
        links = rng.random((len(rows), n)) < 1.2 / n
        root = np.arange(n)
        for r, c in zip(*np.nonzero(links), strict=True):
            a, b = root[rows[r]], root[c]
            root[(root == a) | (root == b)] = min(a, b)
        assert (J._least(links, rows) == root).all()


def test_later_runs_compare_what_is_open(spark):
    """Of a large node only the sets outside its largest component are minor; a node within one component is left out."""
    large = spark.createDataFrame([(1, n) for n in range(40)] + [(2, n) for n in range(30)] + [(3, 50), (3, 51)], "path long, node long")
    known = spark.createDataFrame([(n, 0) for n in range(30)] + [(n, 35) for n in range(35, 40)], "node long, root long")
    got = J._rest_of_large(large, known).collect()
    assert {r["path"] for r in got} == {1, 3}
    assert {r["node"] for r in got if r["path"] == 1 and r["minor"]} == set(range(30, 40))
    pairs: dict = {}
    for r in got:
        pairs.setdefault((r["path"], r["pair"]), []).append(r)
    met = {frozenset((a["node"], b["node"])) for rows in pairs.values() for a in rows for b in rows if a["path"] == 1 and a["minor"]}
    assert all(frozenset((a, b)) in met for a in range(30, 40) for b in range(40))
    assert J._rest_of_large(large.where("path = 2"), known) is None


def test_more_links_close_components(spark):
    comps = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, root long")
    links = lambda rows: spark.createDataFrame(rows, "u long, v long")
    assert sorted(map(tuple, J._with_links(comps, links([(2, 1), (9, 8)])).collect())) == sorted(map(tuple, comps.collect()))
    got = {r["node"]: r["root"] for r in J._with_links(comps, links([(6, 2), (7, 6), (20, 21)])).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8, 20: 20, 21: 20}


def test_differences_give_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(60, rng.integers(1, 50))).astype(np.uint64) for _ in range(30)]
    batch = J.pa.RecordBatch.from_pydict({"comp": [0] * 30, "node": list(range(30)), "n_docs": [1] * 30, "size": [30] * 30, "set": [s.tobytes() for s in sets], "ref": [sets[0].tobytes()] * 29 + [None]})
    d = next(J._differences(iter([batch, batch]))).to_pydict()
    for i in range(29):
        for j in range(29):
            a, b = (set(np.frombuffer(d["d"][x], np.uint64).tolist()) for x in (i, j))
            assert d["ref"][i] - d["miss"][i] - d["miss"][j] + len(a & b) == len(np.intersect1d(sets[i], sets[j]))
    assert d["n"] == [len(s) for s in sets] and d["miss"][29] == 0


def test_runs_reach_the_recall():
    assert J.runs_for(0.9999, 3, 0.8) == 13
    sketch = np.random.default_rng(0).integers(0, 2**63, (2000, J.COORDS)).astype(np.uint64)
    near = np.where(np.random.default_rng(1).random(sketch.shape) < 0.8, sketch, sketch + np.uint64(1))
    met = np.zeros(2000, bool)
    for r in range(13):
        root = C.mix(np.full(2000, r + 1, np.uint64))
        (ra, a), (rb, b) = J._children(root, sketch), J._children(root, near)
        met[ra[a == b]] = True
    assert met.mean() > 0.999


def test_edges(edge, empty):
    got = sorted((tuple(r)[:4] for r in J.jaccard_join(edge).collect()), key=repr)
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    want = sorted(((i, *b) for (i, _), b in zip(rows, brute(rows), strict=True)), key=repr)
    assert got == want
    assert J.jaccard_join(empty).count() == 0


def shared(edge):
    a, b = ({r["doc_id"]: r["text"] for r in edge.collect()}[i] for i in (1, 3))
    return len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))


def test_keep_one(edge):
    kept = J.keep_one(edge, J.jaccard_join(edge)).collect()
    texts = [r["text"] for r in kept]
    base = next(r["text"] for r in edge.collect() if r["doc_id"] == 1)
    assert texts.count(base) == 1 and "one two" in texts and texts.count("one two") == 1
    assert {r["doc_id"] for r in kept} == {None, 1, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, -(2**63), 2**63 - 1} - ({3} if shared(edge) else set())
    assert sum(r["doc_id"] == 5 for r in kept) == 2 and sum(r["doc_id"] is None for r in kept) == 1
    assert kept[0].asDict().keys() == set(edge.columns)
