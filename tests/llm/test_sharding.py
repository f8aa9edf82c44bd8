import random
import zlib

from inkspan.llm import sharding as S


def test_law(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.choice([0, 1, 10, 100, 900])) for i in rng.sample(range(10**6), 700)]
    got = sorted(S.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    texts = dict(rows)
    per = {}
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        per.setdefault(r["shard"], []).append(r)
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    share = sum(r["size"] for r in got) / 16
    for rs in per.values():
        assert [r["slot"] for r in rs] == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - share) <= 1801


def test_plan_is_native(spark):
    plan = S.shard(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_edges(edge, empty):
    got = S.shard(edge).collect()
    assert sorted(r["size"] for r in got) == sorted(len((r["text"] or "").encode()) + 1 for r in edge.collect())
    assert min(got, key=lambda r: (r["shard"], r["slot"]))["doc_id"] is None
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert S.shard(empty).count() == 0


def test_one_hot_text(spark):
    rows = [(i, "hot " * 50 if i % 3 == 0 else f"t{i}") for i in range(600)]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg({"size": "sum"}).collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * 201
