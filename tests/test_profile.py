from collections import Counter

from inkspan.operators import profile

TEXTS = ["abé  ", "Net income % 10-K", "x" * 300, "", "net income net income"]


def _docs(spark):
    return spark.createDataFrame([(i, t, "A" if i < 2 else None) for i, t in enumerate(TEXTS)], "doc_idx long, text string, ticker string")


def test_frequencies(spark):
    docs = _docs(spark)
    want = Counter("".join(TEXTS))
    assert {r["character"]: r["frequency"] for r in profile.characters(docs).collect()} == want
    assert {r["byte"]: r["frequency"] for r in profile.byte_values(docs).collect()} == Counter("".join(TEXTS).encode())
    top = [tuple(r)[:2] for r in profile.most_common(profile.characters(docs, order="doc_idx"), 8).collect()]
    assert top == want.most_common(8)
    rare = {r["character"]: r["code_point"] for r in profile.rare_characters(profile.characters(docs), 1).collect()}
    assert rare["é"] == "U+00E9" and "x" not in rare
    kinds = {(r["kind"], r["character"]) for r in profile.vocabulary_candidates(profile.characters(docs)).collect()}
    assert ("whitespace", " ") in kinds and ("numeric", "%") in kinds and ("punctuation", "-") in kinds


def test_lengths(spark):
    r = profile.length_statistics(_docs(spark)).first()
    s = sorted(map(len, TEXTS))
    assert (r[0], r[1], r[2], r[3]) == (0, 300, sum(s) / 5, s[2])
    assert [r[n] for n in profile.QUANTILES] == [s[int(5 * q)] for q in profile.QUANTILES.values()]
    assert tuple(profile.length_statistics(_docs(spark).limit(0)).first()) == (0,) * 2 + (0.0,) + (0,) * 7


def test_patterns_and_companies(spark):
    got = {r["pattern"]: r["n"] for r in profile.pattern_counts(_docs(spark)).collect()}
    assert (got["net income"], got["income"], got["%"], got["10-K"], got["$"]) == (3, 3, 1, 1, 0)
    assert {r[0]: r[1] for r in profile.companies(_docs(spark)).collect()} == {"A": 2, "UNKNOWN": 3}
    assert tuple(profile.company_statistics(_docs(spark)).first()) == (2, 2, 3)
