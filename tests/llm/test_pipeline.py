"""The pipeline, stage by stage, against what each stage's operator decides on its own input and against brute force."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from inkspan.llm import registry

from .test_jaccard_join import brute as brute_links
from .test_substring_dedup import brute as brute_passages


def _corpus(seed=1):
    rng = random.Random(seed)
    syllables = {"en": "the ing and ion er".split(), "de": "der sch ung keit ich".split()}

    def body(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))

    passage = body("en", 60)
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "en", "de"])
        t = body(lang, rng.randint(20, 150))
        if i % 10 == 0:
            t += " " + passage
        rows.append((t, None if i % 17 == 0 else lang))
    rows += [(rows[i][0], "en") for i in range(0, 30, 3)] + [(rows[i][0] + " more", "en") for i in range(1, 30, 3)]
    rows += [("", "en"), (None, None), ("123 !!", "en")]
    rng.shuffle(rows)
    return [(i, t, lang, f"s{i % 4 if i % 3 else 0}", None if t is None else len(t), "extra") for i, (t, lang) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def test_names():
    assert [n for n, _ in P.STAGES] == ["language", "near_copies", "repeated_passages", "mixture", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 11))


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(_corpus(), SCHEMA)
    columns, frames = docs.columns, [docs]
    for n, stage in P.STAGES:
        stage(spark, frames[-1], "").write.parquet(str(tmp_path / n))
        frames.append(spark.read.parquet(str(tmp_path / n)))
    rows = [sorted(f.collect(), key=lambda r: r["doc_id"]) for f in frames]
    assert all(f.columns == columns for f in frames[1:5])
    # language: only texts without a letter go, and no lang is missing
    gone = {r["doc_id"] for r in rows[0]} - {r["doc_id"] for r in rows[1]}
    assert gone == {r["doc_id"] for r in rows[0] if not any(c.isalpha() for c in r["text"] or "")}
    assert all(r["lang"] for r in rows[1])
    # near copies: one a class, the least id
    links = brute_links([(r["doc_id"], r["text"]) for r in rows[1]])
    assert [r["doc_id"] for r in rows[2]] == [r["doc_id"] for r, (c, *_) in zip(rows[1], links, strict=True) if c == r["doc_id"]]
    # repeated passages
    want = {}
    for r, (n, cut, kept) in zip(rows[2], brute_passages([r["text"] for r in rows[2]]), strict=True):
        if not (cut and len(cut) == n):
            want[r["doc_id"]] = (kept, len(kept)) if cut else (r["text"], r["n_chars"])
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows[3]} == want
    assert any(r["text"] != a["text"] for r in rows[3] for a in rows[2] if a["doc_id"] == r["doc_id"])
    # mixture: some documents, as they were
    assert 0.4 * len(rows[3]) < len(rows[4]) < len(rows[3]) and set(rows[4]) <= set(rows[3])
    # packing: all of them
    assert {r["doc_id"]: r["n_tokens"] for r in rows[5]} == {r["doc_id"]: len(r["text"].split()) for r in rows[4]}


def test_language_rejects_junk_and_unlearned_languages(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (20, 60, 200, 900) * 5]
    finnish = [" ".join("".join(rng.choice("kaa tta yö ssä lle nii mme vuo".split()) for _ in range(rng.randint(2, 4))) for _ in range(n)) for n in (20, 60, 150) * 5]
    clean = [r for r in _corpus(4) if any(c.isalpha() for c in r[1] or "")]
    odd = [(1000 + i, t, "en" if i == 0 else None, "s", len(t), "x") for i, t in enumerate(junk + finnish)]
    got = {r["doc_id"]: r["lang"] for r in P.language(spark, spark.createDataFrame(clean + odd, SCHEMA), "").collect()}
    assert set(got) == {r[0] for r in clean} and all(got.values())


def test_run_and_empty(spark, tmp_path):
    spark.createDataFrame(_corpus(2), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() > 20
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_take_odd_rows(edge, spark):
    docs = edge
    for n, stage in P.STAGES[:4]:
        docs = P.durable.durable(stage(spark, docs, ""))
        assert docs.columns == edge.columns, n
    assert P.pack(spark, docs, "").count() == docs.count()


#: Names that some operator writes or uses inside.
CLASHING = ("score", "lang_pred", "known", "__known", "n_words", "n_removed", "kept_text", "kept_sha256", "spans", "factors", "row_key", "topic", "n_tokens", "probability", "keep", "class_id", "class_key", "text_hash", "__key", "__hash", "__id", "node", "id", "__source")


def test_clashing_columns_keep_their_values(spark):
    """After every stage but the last, each row that stays has the values it came with, in columns of any name."""
    docs = spark.createDataFrame(_corpus(3), SCHEMA).drop("score")
    docs = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    columns = docs.columns
    for n, stage in P.STAGES[:4]:
        docs = P.durable.durable(stage(spark, docs, ""))
        assert docs.columns == columns, n
        rows = docs.collect()
        assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHING), n
    assert P.pack(spark, docs, "").count() == len(rows)


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, DATA)
    assert set(got.columns) == set(want.columns)
    rows = lambda df: sorted(tuple("" if str(x) in ("nan", "<NA>", "None") else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df[list(want.columns)].astype(object).itertuples(index=False))
    assert rows(got.toPandas()) == rows(want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize(("name", "columns"), [("op3_language_id", {"doc_id", "held_out", "lang_pred", "score"}), ("op9_toxicity", {"doc_id", "held_out", "score", "predicted", "spans"})])
def test_models_on_held_out_rows(spark, name, columns):
    got = registry.QUERIES[name](spark, DATA)
    assert set(got.columns) == columns and got.count() == 200
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    if "lang_pred" in columns:
        joined = got.join(docs, "doc_id").where("held_out")
        assert joined.where(F.col("lang") == F.col("lang_pred")).count() >= 0.95 * joined.count()
