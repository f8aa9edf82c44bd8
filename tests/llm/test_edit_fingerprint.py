import functools
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from inkspan.llm import edit_fingerprint as E


@functools.cache
def _block(block, point):
    return E.moves(block * 1024, 1024, E.np.array([0, point]))[:, 1]


def move(step, point):
    return _block(step // 1024, point)[step % 1024]


def walk(text):
    """The embedding, one step at a time: the symbols at the sampled places."""
    points = [int(p) + 1 for p in E._points(text)]

    def symbol(i):
        g = 0
        for k in range(E.GRAM):
            g = ((g * 0x01000193) ^ ((points[i + k] if i + k < len(points) else 0) * 0x9E3779B1)) % 2**32
        g ^= g >> 15
        g = g * 0x85EBCA6B % 2**32
        return (g >> 16) % 15 + 1

    out, at, step, sample = [], 0, 0, 0
    while at < len(points):
        if E.PLACES[sample] == step:
            out.append("0123456789abcdef"[symbol(at)])
            sample += 1
        at += int(move(step, points[at]))
        step += 1
    return "".join(out)


def test_fingerprints_equal_the_plain_walk():
    rng = random.Random(1)
    texts = ["", "a", "ab", "é€\U0001f600", *("".join(rng.choice("abc dé") for _ in range(rng.randint(0, 900))) for _ in range(90)), "x" * 9000]
    points = [E._points(t) for t in texts]
    assert E.fingerprints(points) == [walk(t) for t in texts]
    assert E.fingerprints(points[:3]) == [walk(t) for t in texts[:3]]  # too few for lanes
    assert E.fingerprints([]) == []


def test_many_short_texts():
    rng = random.Random(4)
    texts = list(dict.fromkeys("".join(rng.choice("abcdefghij é") for _ in range(1 + i % 20)) for i in range(200)))
    assert len(texts) >= 100 and E.fingerprints([E._points(t) for t in texts]) == [walk(t) for t in texts]


@pytest.mark.parametrize("copies", [1, 60])
def test_slowest_texts(copies):
    """Each letter is the one that stays longest from its step on, so the walk is far longer than most."""
    slow, step, letters = "", 0, "abcdefghijklmnopqrstuvwxyz"
    while len(slow) < 300:
        stays = {c: next(n for n in range(999) if move(step + n, ord(c) + 1)) + 1 for c in letters}
        c = max(stays, key=stays.get)
        slow, step = slow + c, step + stays[c]
    assert step > 4 * len(slow) + 256
    texts = [slow[: len(slow) - i] for i in range(copies)]
    assert E.fingerprints([E._points(t) for t in texts]) == [walk(t) for t in texts]


def test_moves_have_no_period_and_tell_characters_apart():
    m = E.moves(0, 1 << 14, E.np.arange(1, 400)).astype(float)
    assert abs(m.mean() - 0.5) < 0.01
    assert abs(E.np.corrcoef(m[:4096].ravel(), m[4096:8192].ravel())[0, 1]) < 0.01
    assert abs(E.np.corrcoef(m.T) - E.np.eye(399)).max() < 0.06
    rng = random.Random(5)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n)) for n in (3, 50, 800)] * 25  # more than 256 characters
    assert E.fingerprints([E._points(t) for t in texts]) == [walk(t) for t in texts]


def test_likeness_follows_edits():
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefghij klmno") for _ in range(3000))

    def edited(k):
        t = list(base)
        for _ in range(k):
            i = rng.randrange(len(t))
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        return "".join(t)

    means = []
    for k in (0, 3, 20, 150):
        f = E.fingerprints([E._points(base), *[E._points(edited(k)) for _ in range(8)]])
        means.append(sum(E.likeness(f[0], x) for x in f[1:]) / 8)
    assert means[0] == 1.0 and means[1] > 0.9 and means[1] > means[2] > means[3] < 0.5
    assert E.likeness("", "") == 1.0 and E.likeness("", "a") == 0.0 == E.likeness("a", "")


def _brute(rows):
    rows = [(i, t or "") for i, t in rows]
    out = []
    for n, (i, t) in enumerate(rows):
        x = rows[(n + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        f, g, h = E.fingerprints([E._points(y) for y in (t, e, x)])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, E.likeness(f, g), E.likeness(f, h)))
    return out


@pytest.mark.parametrize("n", [1, 2, 300])
def test_pairs_equal_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i * 7, "".join(rng.choice("ab c\né") for _ in range(rng.choice([0, 1, 2, 3, 50, 400])))) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, E.fingerprint_pairs(df).collect())) == sorted(_brute(rows))


def test_small_chunks_change_nothing(monkeypatch):
    rows = [(0, 0, i, f"text number {i} " * (i % 40)) for i in range(200)] + [(0, 1, 200, "after")]
    batch = E.pa.RecordBatch.from_pydict(dict(zip(("part", "extra", "id", "text"), map(list, zip(*rows, strict=True)), strict=True)))
    digests = lambda: sorted(tuple(r.values()) for b in E._pairs(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist())
    want = digests()
    monkeypatch.setattr(E, "CHUNK", 100)
    assert digests() == want == sorted(_brute([r[2:] for r in rows])[:200])


def test_null_and_hot_ids_are_dealt(spark):
    """Rows without an id, or of one id, are dealt by a hash of their text; each meets the next one all the same."""
    rng = random.Random(11)
    rows = [(None if i % 3 else 5 + i % 2, f"text {rng.random()} " * 3) for i in range(400)] + [(-(2**63), "least"), (None, "x"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = lambda: df.withColumn("t", F.shiftrightunsigned(F.xxhash64("text"), 2)).orderBy(F.col("doc_id").asc_nulls_first(), "t")
    src = [(r["doc_id"], r["text"]) for r in order().collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, E.fingerprint_pairs(df).collect()), key=key) == sorted(_brute(src), key=key)


def test_edges(edge, empty):
    rows = E.fingerprint_pairs(edge).collect()
    src = [(r["doc_id"], r["text"] or "") for r in edge.collect()]
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == sorted((i or 0, len(t)) for i, t in src)
    prints = {}
    for r, n in ((r, r["n_chars"]) for r in rows):
        prints.setdefault((n, r["fingerprint"]), 0)
    assert E.fingerprint_pairs(empty).count() == 0


def test_near_groups(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = "".join(rng.choice("abcdefgh ijk") for _ in range(rng.randint(200, 2500)))
        for _ in range(4):
            t = list(base)
            for _ in range(2):
                t[rng.randrange(len(t))] = "z"
            rows.append((len(rows), g, "".join(t)))
    rows += [(len(rows), 90, rows[0][2]), (len(rows) + 1, 91, ""), (len(rows) + 2, 91, "")]
    prints = E.fingerprints([E._points(t) for _, _, t in rows])
    df = spark.createDataFrame([(i, f) for (i, _, _), f in zip(rows, prints, strict=True)], "doc_id long, fingerprint string")
    got = {r["doc_id"]: r["class_id"] for r in E.near_groups(df, threshold=0.6).collect()}
    # the walk of a text may lose step for good at an edit, so groups are held against the closure of alike fingerprints
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if E.likeness(prints[i], prints[j]) >= 0.6:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    want = {(i, j) for i in range(len(rows)) for j in range(i) if root[i] == root[j]}
    found = {(i, j) for i in range(len(rows)) for j in range(i) if got[i] == got[j]}
    assert found <= want and len(found) >= 0.95 * len(want)
    assert got[48] == got[0] and got[49] == got[50]
    odd = spark.createDataFrame([(None, "1234"), (3, "1234"), (3, "1234"), (4, None), (None, "")], "doc_id long, fingerprint string")
    assert sorted((r["doc_id"] or 0, r["class_id"]) for r in E.near_groups(odd).collect()) == [(0, 3), (0, 4), (3, 3), (3, 3), (4, 4)]
    assert E.near_groups(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [256, 4])
def test_near_groups_in_hot_bands(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = random.Random(6)
    digits, start = "123456789abcdef", [int(E.np.searchsorted(E.OCTAVE_OF, k)) for k in range(11)]
    text = lambda n: "".join(rng.choice(digits) for _ in range(n))
    hot = text(start[7] - start[6])  # all share the octave 6
    prints = [text(start[6]) + hot + text(start[10] - start[7]) for _ in range(21)]
    for i in range(1, 21, 2):  # pairs are alike, but differ in a sample of every band of the octaves 7 to 9
        twin = list(prints[i])
        for k, b in ((k, b) for k in (7, 8, 9) for b in range(4)):
            at = start[k] + int(E.np.random.default_rng((E.SEED, k, b)).permutation(int(E.OCTAVE_SIZE[k]))[0])
            twin[at] = digits[(digits.index(prints[i][at]) + 1) % 15]
        prints[i + 1] = "".join(twin)
    assert all(E.likeness(prints[i], prints[i + 1]) >= 0.6 > E.likeness(prints[0], prints[i]) for i in range(1, 21, 2))
    got = {r["doc_id"]: r["class_id"] for r in E.near_groups(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string"), threshold=0.6, bands=4).collect()}
    assert got == {0: 0} | {i: i - (i % 2 == 0) for i in range(1, 21)}
