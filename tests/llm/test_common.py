import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from inkspan.llm import common as C
from inkspan.llm.components import components

TEXTS = ["a b  c", None, "", " x\ty\x0bz\x0c\r\nq ", "é ü v", "tail", "one"]


def test_words_are_those_of_the_pattern():
    array = pa.array(["skip", *TEXTS])[1:]  # a slice, whose buffers start elsewhere
    w = C.Words(array)
    for d, t in enumerate(TEXTS):
        got = [bytes(w.data[w.start[i] : w.end[i]]).decode() for i in range(w.first[d], w.first[d + 1])]
        assert got == re.findall(C.WORD_PATTERN, t or "")


def test_hashes_depend_on_content_alone():
    rng = random.Random(1)
    vocabulary = ["a", "b", "ab", "ba", "aa", "é", "abc" * 9]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(30)]
    w = C.Words(pa.array(texts))
    h = w.hashes()
    flat = " ".join(texts).split()
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    g = C.gram_hashes(h, 3)
    grams = [tuple(flat[i : i + 3]) for i in range(len(flat) - 2)]
    assert len(set(zip(grams, g.tolist(), strict=True))) == len(set(grams)) == len(set(g.tolist()))
    whole, p2 = w.hashes(prefixes=(2,))
    assert (whole == h).all() and len(set(p2.tolist())) == len({t.encode()[:2] if len(t.encode()) >= 2 else 0 for t in flat})


def test_shingle_sets():
    texts = ["a b c d e f", "a b", None, "a b c d e f a b c d e f", "x"]
    values, first = C.shingle_sets(C.Words(pa.array(texts)), 5)
    sizes = np.diff(first).tolist()
    assert sizes == [2, 1, 0, 6, 1]
    assert set(values[:2].tolist()) <= set(values[first[3] : first[4]].tolist())


def test_chunks():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 100, "z", ""])], names=["t"])
    parts = [p.num_rows for p in C.chunks(batch, "t", 20)]
    assert sum(parts) == 5 and parts[0] == 2
    assert list(C.chunks(batch.slice(0, 0), "t")) == []


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(50)]), rng.randint(0, 9)) for _ in range(400)] + [(7, 3)] * 200
    df = spark.createDataFrame(rows, "k long, s long")
    got = C.running_totals(df, ["k", "s"], "s", partitions=5).orderBy("before_rows").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    total = 0
    for i, (r, want) in enumerate(zip(got, order, strict=True)):
        assert (r["k"], r["s"], r["before_rows"], r["before_size"], r["all_size"]) == (*want, i, total, sum(s for _, s in rows))
        total += want[1]
    assert C.running_totals(df.limit(0), ["k"], "s").count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [tuple(rng.sample(range(200, 260), 2)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shared_folder_is_the_clusters(spark):
    class Conf:
        def get(self, key, default=None):
            return "file:///shared/" if key == "spark.checkpoint.dir" else default

    assert C.shared_dir(SimpleNamespace(conf=Conf())) == "file:///shared"
    df = C.durable(spark.range(3).toDF("x"))
    assert C.shared_dir(spark).removeprefix("file://") in df.inputFiles()[0] and df.count() == 3
    assert C.forget(spark) >= 1
