import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkspan.llm import language_id as L

SYLLABLES = {"en": "the ing and ion er th of".split(), "de": "der sch ung ein ich keit ü".split(), "fr": "eau que le les oi é è".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain_bundle(t):
    """Letter by letter, as the method says."""
    sym, out = [0], np.zeros(L.DIM)
    for c in t or "":
        s = int(L.symbols(np.array([ord(c)], np.uint32))[0])
        if s or sym[-1]:
            sym.append(s)
    if sym[-1]:
        sym.append(0)
    letters = {s: L.letter_vectors(np.array([s], np.uint32))[0] for s in set(sym)}
    for a, b, c in zip(sym, sym[1:], sym[2:], strict=False):
        if b:
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


def test_bundle_is_the_sum_of_bound_trigrams():
    for t in ("Ab, cé!", "x", "no 漢 \U00020000", "a" * 50, "слово дело"):
        got, has = L.bundles(pa.array(["zz top", t, None]))
        assert (got[1] == plain_bundle(t)).all() and has.tolist() == [True, True, False]
        assert (got[1] == L.bundles(pa.array([t]))[0][0]).all()


def test_letters_have_vectors_of_their_own():
    cps = np.array([*range(0x430, 0x450), *range(0x4E00, 0x4F00), *range(0x3B1, 0x3CA), *range(97, 123), 0x20000, 0x20044], np.uint32)
    v = L.letter_vectors(cps)
    assert set(np.unique(v)) == {-1, 1} and abs(v @ v.T / L.DIM - np.eye(len(cps))).max() < 0.2
    # letters whose code points leave the same rest by 68 are told apart, and each letter only from its other case
    assert L.symbols(np.array([ord("Ж"), ord("ж"), 0x4E00, 0x4E44, ord("1"), 0x20000], np.uint32)).tolist() == [ord("ж"), ord("ж"), 0x4E00, 0x4E44, 0, 0x20000]


def test_many_scripts_use_the_other_numbering():
    """A chunk with more letters than a dense table of trigrams is made for."""
    rng = random.Random(3)
    t = "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(600))
    assert (L.bundles(pa.array(["abc abd", t]))[0] == [plain_bundle("abc abd"), plain_bundle(t)]).all()


def test_prediction_equals_a_plain_loop(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, lang, rng.randint(1, 30)) if i % 9 else None, lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), [5, 2, 1], k=80))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    totals = {lang: sum((plain_bundle(t) for _, t, x in rows if x == lang), np.zeros(L.DIM)) for lang in sorted(SYLLABLES)}
    prototypes = L.learn(df)
    assert all((prototypes[k] == totals[k]).all() for k in totals)
    unit = {k: v / np.linalg.norm(v) for k, v in totals.items()}
    mean = sum(unit.values()) / len(unit)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(df, prototypes).collect()}
    for i, t, _ in rows:
        v = plain_bundle(t)
        if not np.any(v):
            assert got[i] == ("und", 0.0)
            continue
        v = v / np.linalg.norm(v) - mean
        cosines = {k: float(v @ (u - mean) / np.linalg.norm(v) / np.linalg.norm(u - mean)) for k, u in unit.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert got[i][0] == best and abs(got[i][1] - (1 + cosines[best]) / 2) < 1e-9


def test_memory_of_many_short_texts():
    import tracemalloc

    rng = random.Random(2)
    batch = pa.RecordBatch.from_arrays([pa.array([text(rng, "en", 12) for _ in range(10_000)])], names=["t"])
    tracemalloc.start()
    for part in L.C.chunks(batch, "t", L.CHUNK_BYTES, L.CHUNK_ROWS):
        L.profiles(part.column("t"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(4, 80)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), [5, 2, 1], k=600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = L.learn(df.where(L.learning_rows()))
    assert list(prototypes) == ["de", "en", "fr"]
    one = L.learn(df.where(L.learning_rows()).repartition(7))
    assert all((one[k] == prototypes[k]).all() for k in one)
    got = L.identify(df, prototypes)
    wrong = got.where(L.C.held_out() & (F.col("lang") != F.col("lang_pred"))).count()
    assert wrong <= 0.02 * got.where(L.C.held_out()).count()
    assert got.agg(F.min("score"), F.max("score")).first()[0] > 0.4


def test_edges(edge, empty, spark):
    prototypes = L.learn(edge)
    got = L.identify(edge, prototypes)
    assert got.count() == edge.count() and got.where("lang_pred = 'und'").select("text").distinct().count() == 4
    assert got.schema["score"].dataType.simpleString() == "double"
    assert got.where("lang_pred = 'und' and score <> 0").count() == 0
    assert got.where("text like '%漢字%'").first()["lang_pred"] in ("en", "fr")
    assert L.identify(empty, prototypes).count() == 0
    nothing = L.learn(empty)
    assert nothing == {} and {r["lang_pred"] for r in L.identify(edge, nothing).collect()} == {"und"}
    single = L.identify(edge.where("doc_id = 1"), {"en": prototypes["en"]}).first()
    assert single["lang_pred"] == "en"
