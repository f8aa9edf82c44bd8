"""Every operator's query, on the smallest tables: whole results with the columns that are promised."""

from pathlib import Path

import pytest

from inkspan.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_learned_partitions": {"query_id", "rank", "vec_id", "score"},
    "op2_packing": {"doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot", "padding"},
    "op3_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op4_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op5_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op6_jaccard_join": {"doc_id", "class_id", "n_links", "n_copies"},
    "op7_warc_fixity": {"page_id", "offset", "length", "digest", "status"},
    "op8_mixing": {"doc_id", "source", "lang", "topic", "n_tokens", "probability", "keep"},
    "op9_toxicity": {"doc_id", "held_out", "score", "predicted", "spans"},
    "op10_edit_fingerprint": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "near_fingerprints": {"doc_id", "class_id"},
}
KINDS = {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double", "held_out": "boolean", "lang_pred": "string", "n_removed": "bigint", "size": "bigint", "text_crc32": "bigint", "shard": "int", "slot": "bigint", "grown_shard": "int", "predicted": "int", "n_chars": "bigint", "near_edited": "double", "near_next": "double"}


def test_one_query_an_operator():
    assert set(COLUMNS) == set(registry.QUERIES) and set(registry.SQL) <= set(COLUMNS)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    got = registry.QUERIES[name](spark, DATA)
    assert set(got.columns) == COLUMNS[name]
    assert all(KINDS.get(c, k) == k for c, k in got.dtypes)
    key = next(c for c in ("doc_id", "page_id", "query_id") if c in got.columns)
    if key != "query_id":
        table = {"doc_id": "documents", "page_id": "pages"}[key]
        want = spark.read.parquet(f"{DATA}/{table}.parquet").select(key)
        assert sorted(got.select(key).collect()) == sorted(want.collect())
    for c in {"score", "near_edited", "near_next", "probability"} & set(got.columns) if key != "query_id" else ():
        assert got.where(f"{c} is null or {c} < 0 or {c} > 1").count() == 0
