import json
import random

import pytest
from pyspark.sql import functions as F

from inkspan.operators import splits
from inkspan.plans.config import Ingestion, Preparation, Tokenizer
from inkspan.sources import sinks


def _docs(spark, n=100):
    return spark.range(n).select(F.col("id").alias("doc_idx"), F.format_string("doc_%06d", "id").alias("document_id"), F.concat(F.lit("T"), (F.col("id") % 9).cast("string")).alias("ticker"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("2024-1-"), (F.col("id") % 28 + 1).cast("string"))).otherwise("never").alias("filing_date"))


@pytest.mark.parametrize("bad", [{"train_ratio": 0.5}, {"split_strategy": "x"}, {"boundary_mode": "x"}, {"train_ratio": 1.1, "validation_ratio": -0.1, "test_ratio": 0.0}])
def test_config_rejects(bad):
    with pytest.raises(ValueError):
        Preparation(**bad)


def test_other_configs():
    for bad in ({"vocab_size": 200}, {"min_frequency": 0}, {"encoding": "ascii"}, {"trainer": "x"}):
        with pytest.raises(ValueError):
            Tokenizer(**bad)
    with pytest.raises(ValueError, match="max_extracted_file_size.*max_total_extracted_size"):
        Ingestion(max_extracted_file_size=-1, max_total_extracted_size=-1)


def test_value_at_rank(spark):
    rng = random.Random(1)
    values = [rng.choice([-(2**62), 2**62, rng.randint(-9, 9), rng.randint(-(10**15), 10**15)]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    for rank in (0, 1, 150, 299):
        assert splits.value_at_rank(df, "v", rank) == sorted(values)[rank]
    assert splits.value_at_rank(df, "v", 300) is None
    assert splits.value_at_rank(df.limit(0), "v", 0) is None


def test_document_split(spark):
    c = Preparation("document")
    got = splits.split_documents(_docs(spark), c)
    assert {r[0]: r[1] for r in got.groupBy("split").count().collect()} == {"train": 80, "validation": 10, "test": 10}
    assert not splits.leakage(got).first()["has_leakage"]
    other = splits.split_documents(_docs(spark), Preparation("document", seed=1))
    assert got.join(other, ["document_id", "split"]).count() < 100
    tiny = splits.split_documents(_docs(spark, 1), c)
    assert tiny.first()["split"] == "test"
    assert splits.split_documents(_docs(spark, 0), c).count() == 0


def test_company_split(spark):
    got = splits.split_companies(_docs(spark), Preparation())
    per = got.groupBy("ticker").agg(F.countDistinct("split").alias("n"), F.min("split").alias("s")).collect()
    assert all(r["n"] == 1 for r in per)
    assert sorted(r["s"] for r in per) == ["test"] * 2 + ["train"] * 7
    assert not splits.leakage(got, ticker="ticker").first()["has_leakage"]


def test_temporal_split(spark):
    got = splits.split_temporal(_docs(spark), Preparation("temporal"))
    assert got.count() == 80
    rows = sorted(((int(r["filing_date"].split("-")[2]), r["doc_idx"]), r["split"]) for r in got.collect())
    assert [s for _, s in rows] == ["train"] * 64 + ["validation"] * 8 + ["test"] * 8
    undated = _docs(spark).withColumn("filing_date", F.lit(None).cast("string"))
    assert splits.split_temporal(undated, Preparation("temporal")).count() == 100


def test_seeded_split_is_pythons(spark):
    c = Preparation("document", seed=7)
    got = {r["doc_idx"]: r["split"] for r in splits.split_seeded(_docs(spark, 20), c).collect()}
    order = list(range(20))
    random.Random(7).shuffle(order)
    assert [got[i] for i in order] == ["train"] * 16 + ["validation"] * 2 + ["test"] * 2
    by = splits.split_seeded(_docs(spark, 20), c, key="ticker")
    assert by.groupBy("ticker").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_dispatch(spark):
    for s in ("company", "document", "temporal"):
        assert "split" in splits.split(_docs(spark), Preparation(s)).columns


def test_leakage_and_manifest(spark, tmp_path):
    c = Preparation("company")
    got = splits.split_companies(_docs(spark), c)
    path = str(tmp_path / "m.json")
    sinks.write_manifest(got, c, path, "ticker")
    found = splits.load_manifest(path)
    assert found["strategy"] == "company" and found["train"] == sorted(found["train"]) and len(found["company_assignments"]) == 9
    listed = splits.manifest_frame(spark, found)
    ok = splits.validate_manifest(listed, got).first()
    assert ok["is_valid"] and ok["missing_documents"] == 0
    found["test"].append(found["train"][0])
    found["test"].append("ghost")
    bad = splits.validate_manifest(splits.manifest_frame(spark, found), _docs(spark, 101)).first()
    assert not bad["is_valid"] and (bad["missing_documents"], bad["extra_documents"], bad["document_train_test"]) == (1, 1, 1)
    assert json.dumps(found)
    leaky = got.unionByName(got.where("split = 'train'").limit(3).withColumn("split", F.lit("validation")))
    r = splits.leakage(leaky, ticker="ticker").first()
    assert r["document_train_validation"] == 3 and r["company_train_validation"] >= 1 and r["has_leakage"]
