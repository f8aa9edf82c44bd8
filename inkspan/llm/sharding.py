"""Shards of near equal bytes: prefix sums of sizes over all documents in id order, cut at equal targets.

A document goes to the shard in whose share of the bytes its middle lies, so shards are contiguous in the order of ids and
each differs from an equal share by no more than one document's size. Native throughout: the range exchange carries ids,
sizes and checksums only, one row per partition is summed in order, and nothing depends on how rows fall into partitions.

A size is the text's UTF-8 bytes (null: none) plus 1. Null ids come first; rows that share an id are ordered by checksum and
size, and equal rows get the places among them. An empty table gives an empty table; only id and text are read. A document
larger than a share fills its shard alone, and shards may stay empty if there are fewer documents than shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

SHARDS = 16


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (its place in the shard) and grown_shard (null: this law promises nothing)."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = C.running_totals(rows, ["doc_id", "text_crc32", "size"], "size")
    cut = placed.withColumn("shard", F.least(F.expr(f"((2 * before_size + size) * {int(shards)}) div (2 * all_size)"), F.lit(shards - 1)).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("before_rows").alias("first"))  # a row a shard
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before_rows") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(C.read(spark, sf_dir, "documents"))


#: The checksum is made by the bitwise rule from the reflected polynomial 0xEDB88320.
OP5_SQL = r"""
with tab as (select list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
d as (select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as bytes from documents),
c as (select doc_id, size, xor(list_reduce(list_transform(bytes, lambda x: ('0x' || x)::bigint), lambda crc, x: xor(crc >> 8, t[(xor(crc, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as crc from d, tab),
p as (select *, coalesce(sum(size) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as b, sum(size) over () as total, row_number() over (order by doc_id) - 1 as r from c),
s as (select *, least((2 * b + size) * 16 // (2 * total), 15)::int as shard from p)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard, r - min(r) over (partition by shard) as slot, null::int as grown_shard from s
"""

QUERIES = {"op5_sharding": op5_sharding}
SQL = {"op5_sharding": OP5_SQL}
