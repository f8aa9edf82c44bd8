import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkspan.llm import toxicity as X


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, moves, real = rng.normal(size=(6, 4)), rng.normal(size=(2, 2)), np.ones((6, 4), bool)
    real[4:, 1] = real[1:, 2] = False
    p, expected, total = X.forward_backward(e, real, moves)
    z_sum, pairs = 0.0, np.zeros((2, 2))
    for c in range(4):
        n = int(real[:, c].sum())
        z, m, own = 0.0, np.zeros(n), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[t, c] * s[t] for t in range(n)) + sum(moves[s[t], s[t + 1]] for t in range(n - 1)))
            z += w
            m += w * np.array(s)
            for t in range(n - 1):
                own[s[t], s[t + 1]] += w
        z_sum += np.log(z)
        pairs += own / z
        assert np.allclose(m / z, p[:n, c]) and np.allclose(m / z, X._marginals_only(e, real, moves)[:n, c])
    assert np.allclose(pairs, expected) and np.isclose(total, z_sum)


def test_chains_are_not_cut():
    """Stretches of a chain give what the chain gives as a whole."""
    rng = np.random.default_rng(4)
    for lengths in ((1, 4, 5, 23), (16, 3, 8), (40,)):
        e, moves = [rng.normal(size=n) * 3 for n in lengths], rng.normal(size=(2, 2))
        parts = [(c, k, x[k : k + 4]) for c, x in enumerate(e) for k in range(0, len(x), 4)]
        grid, real = np.zeros((4, len(parts))), np.zeros((4, len(parts)), bool)
        for i, (_, _, x) in enumerate(parts):
            grid[: len(x), i], real[: len(x), i] = x, True
        depth = np.array([k // 4 for _, k, _ in parts])
        p, expected, total = X.forward_backward(grid, real, moves, depth)
        whole = [X.forward_backward(x[:, None], np.ones((len(x), 1), bool), moves) for x in e]
        assert np.allclose(expected, sum(w[1] for w in whole)) and np.isclose(total, sum(w[2] for w in whole))
        alone = X._marginals_only(grid, real, moves, depth)
        for i, (c, k, x) in enumerate(parts):
            assert np.allclose(p[: len(x), i], whole[c][0][k : k + len(x), 0]) and np.allclose(alone[: len(x), i], p[: len(x), i])


def test_long_documents_are_one_chain():
    rows = corpus(5, 300)
    model = X.fit([r[1] for r in rows], np.array([r[2] for r in rows], bool), 0.15)
    text = " ".join(r[1] for r in rows[:40])
    tokens = X.Tokens(pa.array([text, "one", None, text]))
    n = int(tokens.words.counts()[0])
    e = tokens.emissions(model)[:n, None]
    want = X.forward_backward(e, np.ones((n, 1), bool), model.moves)[0][:, 0]
    got = X.marginals(tokens, model)
    assert n > 40 * X.STRETCH and np.allclose(got[:n], want) and np.allclose(got[-n:], want)


def test_document_score_is_that_of_a_plain_field(spark):
    rows = corpus(6, 200)
    model = X.fit([r[1] for r in rows], np.array([r[2] for r in rows], bool), 0.15)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in X.score(df, model, with_spans=False).collect()}
    for i, t, _ in rows[:40]:
        tokens = X.Tokens(pa.array([t]))
        e = tokens.emissions(model)
        f, b = [], [(1.0, 1.0)]
        m = np.exp(model.moves)
        for k, x in enumerate(np.exp(e)):
            a = (1.0, x) if not k else ((f[-1][0] * m[0, 0] + f[-1][1] * m[1, 0]), (f[-1][0] * m[0, 1] + f[-1][1] * m[1, 1]) * x)
            f.append((a[0] / sum(a), a[1] / sum(a)))
        for x in np.exp(e)[:0:-1]:
            a = (m[0, 0] * b[-1][0] + m[0, 1] * x * b[-1][1], m[1, 0] * b[-1][0] + m[1, 1] * x * b[-1][1])
            b.append((a[0] / sum(a), a[1] / sum(a)))
        p = np.array([x1 * y1 / (x0 * y0 + x1 * y1) for (x0, x1), (y0, y1) in zip(f, b[::-1], strict=True)])
        z = model.rule @ [1, np.log1p(p.sum()), p.max()]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_field_beats_its_lexicon():
    """A marked word now and then stands in clean company. The field sees its neighbours, a list of marked words doesn't."""
    rng = random.Random(7)
    fill = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]

    def make(n):
        out = []
        for i in range(n):
            toxic = i % 2 == 0
            if toxic:
                words = fill(20) + ["you", "slug", "go"] + fill(20)
            else:
                words = fill(20) + (["garden", "slug", "trap"] if i % 40 == 1 else fill(3)) + fill(20)
            out.append((" ".join(words), toxic, "slug" in words))
        return out

    train, test = make(800), [r for r in make(2000) if r[2]]
    toxic = np.array([r[1] for r in train])
    tokens = X.Tokens(pa.array([r[0] for r in train]))
    assert X.token_labels(tokens, toxic).sum() >= 400  # the word is on the list
    model = X.fit([r[0] for r in train], toxic, 0.5)
    tokens = X.Tokens(pa.array([r[0] for r in test]))
    score = X._features_of_docs(X.marginals(tokens, model), tokens, len(test)) @ model.rule
    bad = np.array([r[1] for r in test])
    auc = (score[bad][:, None] > score[~bad][None, :]).mean() + 0.5 * (score[bad][:, None] == score[~bad][None, :]).mean()
    assert (~bad).sum() >= 40 and auc > 0.95  # by the list all of these are alike: 0.5


def test_layout_leaves_no_token_out():
    texts = [" ".join(f"t{i}" for i in range(n)) for n in (0, 1, 63, 64, 65, 200)]
    t = X.Tokens(pa.array([*texts, None]))
    placed = np.sort(t.place[t.place >= 0])
    assert (placed == np.arange(393)).all() and (t.doc[t.place.max(axis=0)] == t.doc[t.place[0]]).all()


def test_folding():
    a, b = X.Tokens(pa.array(["Élan VITAL ß×÷"])), X.Tokens(pa.array(["élan vital ß×÷"]))
    assert (a.hashes == b.hashes).all()


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 160))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["Idiot", "scum,", "moronic" + rng.choice("abc") + "x"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out(spark):
    rows = corpus(1, 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, toxic int")
    model = X.learn(docs.where(~X.C.held_out()), labels.where(~X.C.held_out()))
    got = X.score(docs, model).where(X.C.held_out()).collect()
    truth = {r[0]: r[2] for r in rows}
    wrong = [r["doc_id"] for r in got if r["predicted"] != truth[r["doc_id"]]]
    assert len(wrong) <= 0.03 * len(got)
    for r in got:
        assert r["predicted"] == int(r["score"] >= 0.3)
        for s in r["spans"]:
            piece = r["text"][s["start"] : s["end"]]
            assert piece.lower().startswith(("idiot", "scum", "moronic")), piece
    again = X.learn(docs.where(~X.C.held_out()).repartition(5), labels.where(~X.C.held_out()).repartition(2))
    assert np.allclose(again.rule, model.rule)


def test_bound_is_kept(spark):
    rows = corpus(2, 200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    m = X.learn(docs, labels, per_class=10)
    assert m.fitted and m.share == pytest.approx(sum(r[2] for r in rows) / 200)


def test_one_long_text_leaves_room(spark):
    rows = corpus(9, 400)
    rows += [(1000 + i, "word " * 30_000, i % 2) for i in range(4)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5, f"again {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    m = X.learn(docs, labels, per_class_chars=60_000)
    assert m.fitted and m.weights.any()


def test_edges(edge, empty, spark):
    rows = corpus(3, 300)
    model = X.fit([r[1] for r in rows], np.array([r[2] for r in rows], bool), 0.15)
    got = X.score(edge, model).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    blank = {round(r["score"], 12) for r in got if not (r["text"] or "").strip()}
    assert len(blank) == 1 and blank.pop() < 0.3
    assert X.score(empty, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    none = X.learn(edge, labels)
    assert {r["score"] for r in X.score(edge, none, with_spans=False).collect()} == {0.0}
    one = X.learn(edge, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert {r["score"] for r in X.score(edge, one).collect()} == {1.0}
    assert X.score(edge.where(F.col("doc_id") == 1), model, with_spans=False).columns.count("score") == 1
