import gzip
import hashlib
import random

from pyspark.sql import functions as F

from inkspan.llm import warc_fixity as Wf


def _pages(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"http://h{i % 3}.example/é{i}", "<html>" + "é\r\n\r\nx" * rng.randint(0, 40)) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def test_manifest_is_the_file(spark, tmp_path):
    pages = _pages(spark)
    Wf.write_warc(pages, str(tmp_path / "w"), file_bytes=4000)
    back = Wf.read_warc(spark, str(tmp_path / "w")).collect()
    want = {r["url"]: r["html"] for r in pages.collect()}
    assert {r["url"]: bytes(r["body"]).decode() for r in back} == want and len(back) == 120
    data = b"".join(p.read_bytes() for n in sorted((tmp_path / "w").glob("file=*"), key=lambda p: int(p.name[5:])) for p in n.glob("part-*"))
    for r in Wf.manifest(pages).collect():
        assert hashlib.sha256(data[r["offset"] : r["offset"] + r["length"]]).hexdigest() == r["digest"]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.warc.gz").write_bytes(gzip.compress(data))
    assert Wf.read_warc(spark, str(tmp_path / "g")).count() == 120


def test_audit_finds_what_differs_and_looks_nowhere_else(spark):
    whole = Wf.manifest(_pages(spark, 300)).cache()
    offsets = [r["offset"] for r in whole.orderBy("offset").collect()]
    changed, lost = offsets[70], offsets[200]
    bad = whole.where(F.col("offset") != lost).withColumn("digest", F.when(F.col("offset") == changed, "0").otherwise(F.col("digest")))
    bad = bad.unionByName(spark.createDataFrame([(999, offsets[-1] + 10**6, 5, "1")], "page_id long, offset long, length long, digest string"))
    found, compared = Wf.audit(whole, bad, leaf_bytes=1000, fanout=4)
    assert {(r["offset"], r["status"]) for r in found.collect()} == {(changed, "changed"), (lost, "lost"), (offsets[-1] + 10**6, "added")}
    assert all(n <= 4 * 3 for n in compared)
    same, compared = Wf.audit(whole, whole, leaf_bytes=1000, fanout=4)
    assert same.count() == 0 and compared[0] == 1 and sum(compared[1:]) == 0


def test_root_is_the_plain_tree(spark):
    whole = Wf.manifest(_pages(spark, 60))
    rows = sorted((r["offset"], r["length"], r["digest"]) for r in whole.collect())
    level = {}
    for o, n, d in rows:
        level.setdefault(o // 500, []).append((o, f"{o} {n} {d}"))
    end = rows[-1][0] // 500 + 1
    nodes = {k: hashlib.sha256("\n".join(x for _, x in sorted(v)).encode()).hexdigest() for k, v in level.items()}
    n_levels = 1
    while end > 1:
        up = {}
        for k, h in sorted(nodes.items()):
            up.setdefault(k // 4, []).append(h)
        nodes = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in up.items()}
        end = -(-end // 4)
        n_levels += 1
    assert [tuple(r) for r in Wf.tree(whole, n_levels, 500, 4)[-1].collect()] == list(nodes.items())


def test_edges(spark):
    rows = [(None, None, None, "x"), (1, "u", "a", None), (1, "u", "a", "y"), (1, "u", "b", "z"), (2, None, "", None), (3, "u", "q" * 10**6, "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    m = Wf.manifest(pages).orderBy("offset").collect()
    assert len(m) == 6 and [r["page_id"] for r in m] == [None, 1, 1, 1, 2, 3]
    assert all(b["offset"] == a["offset"] + a["length"] for a, b in zip(m, m[1:], strict=False))
    none = Wf.manifest(pages.limit(0))
    found, _ = Wf.audit(none, none)
    assert none.count() == 0 and found.count() == 0
    assert Wf.audit(Wf.manifest(pages), none)[0].where("status = 'lost'").count() == 6
