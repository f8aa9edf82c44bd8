import hashlib
import random
import re
import time
from collections import Counter

import pytest

from inkspan.llm import common as C, substring_dedup as S


def brute(texts, window=35):
    docs = [re.findall(C.WORD_PATTERN, t or "") for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(d), gone, " ".join(w for i, w in enumerate(d) if i not in gone)))
    return out


def _check(df, texts, window=35, gram=8):
    rows = {r["doc_id"]: r for r in S.substring_dedup(df, window=window, gram=gram).collect()}
    for i, (n, gone, kept) in enumerate(brute(texts, window)):
        r = rows[i]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (n, len(gone), kept), i
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert {w for s in r["spans"] for w in range(s["first_word"], s["first_word"] + s["n_words"])} == gone


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [" ".join(f"p{rng.randrange(50)}" for _ in range(rng.randint(5, 90))) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(f"v{rng.randrange(30 if seed == 3 else 9000)}" for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts) if rng.random() > 0.1 else rng.choice(["", "x " * 120, "a b " * 60]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    _check(df, texts)
    _check(df, texts, window=12, gram=3)


def test_parts_of_equal_windows_at_every_place(spark):
    """Copies of one passage, shortened word by word on either side: boundaries within every phrase."""
    rng = random.Random(9)
    passage = [f"q{rng.randrange(500)}" for _ in range(80)]
    texts = [" ".join(passage)] + [" ".join([f"l{i}", *passage[i:], f"r{i}"]) for i in range(0, 60, 3)] + [" ".join([f"m{i}", *passage[: 80 - i]]) for i in range(0, 60, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    _check(df, texts)


def parse(docs, keys, window):
    """A plain greedy parse: each word by word, against a reference that holds each repeated window where it first occurs."""
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    owners = {}
    for k, i, d in sorted((k, i, d) for k, d in zip(keys, docs, strict=True) for i in range(len(d) - window + 1)):
        w = tuple(d[i : i + window])
        if seen[w] > 1:
            owners.setdefault(w, (k, i))
    reference: dict[int, dict[int, str]] = {}
    starts: dict[int, set[int]] = {}
    of = dict(zip(keys, docs, strict=True))
    for k, i in owners.values():
        starts.setdefault(k, set()).add(i)
        reference.setdefault(k, {}).update({j: of[k][j] for j in range(i, i + window)})
    out = []
    for d in docs:
        found, p = [], 0
        while p + window <= len(d):
            best = (0, 0, 0)
            for k, held in reference.items():
                for q in starts[k]:
                    n = window if all(held.get(q + x) == d[p + x] for x in range(window)) else 0
                    # a match goes on over windows that the reference holds
                    while n and p + n < len(d) and q + n - window + 1 in starts[k] and held.get(q + n) == d[p + n]:
                        n += 1
                    best = max(best, (n, k, q))
            if best[0]:
                found.append((best[1], best[2], p, best[0]))
            p += max(1, best[0] - window + 1)
        out.append(found)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_factors_are_those_of_a_greedy_parse(spark, seed):
    rng = random.Random(20 + seed)
    passages = [" ".join(f"p{rng.randrange(12)}" for _ in range(rng.randint(8, 40))) for _ in range(6)]
    texts = [" ".join(rng.choice(passages) if rng.random() < 0.6 else f"v{rng.randrange(900)}" for _ in range(rng.randint(0, 8))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(S.substring_dedup(df, window=10, gram=3).collect(), key=lambda r: r["doc_id"])
    want = parse([t.split() for t in texts], [r["row_key"] for r in rows], 10)
    assert [[(f["source"], f["position"], f["first_word"], f["n_words"]) for f in r["factors"]] for r in rows] == want
    assert sum(map(len, want)) > 20 and any(f["source"] != r["row_key"] for r in rows for f in r["factors"])
    assert all(0 <= f["block"] < S.BLOCKS for r in rows for f in r["factors"])


def test_null_and_repeated_ids_are_no_group(spark):
    """10 000 rows of 5000 repeated texts without an id: facts go to rows by their own words, not by their id."""
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(45)) for _ in range(5000)]
    df = spark.createDataFrame([(None, t) for t in texts * 2], "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    got = S.substring_dedup(df, with_text=False).select("n_removed").distinct().collect()
    assert [r[0] for r in got] == [45]
    assert time.perf_counter() - began < 40
    same = spark.createDataFrame([(7, texts[0])] * 3000 + [(8, texts[1])], "doc_id long, text string").repartition(4)
    assert {(r["doc_id"], r["n_removed"]) for r in S.substring_dedup(same, with_text=False).collect()} == {(7, 45), (8, 0)}


def test_edges(edge, empty):
    rows = S.substring_dedup(edge).collect()
    assert len(rows) == edge.count()
    texts = [r["text"] for r in rows]
    for r, (n, gone, kept) in zip(rows, brute(texts), strict=True):
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (n, len(gone), kept)
    assert rows[0]["source"] is None or isinstance(rows[0]["source"], str)
    assert S.substring_dedup(empty).count() == 0
    assert {"lang", "score", "__key"} <= set(S.substring_dedup(empty).columns)
