"""Packing into optimal length buckets.

Dynamic programming over the histogram of all documents' lengths picks at most ``buckets`` upper bounds that give the least
padding in total, if each document is padded to its bucket's bound. The cost of the next bucket is a line in the bound, so
each round is a pass over a convex hull: lengths times buckets steps, in whole numbers. Inside a bucket documents stand in
order of (length, id); each batch takes as many as fit a budget of padded tokens, one at least.

Only the histogram reaches the driver, exact at every size: d distinct lengths need at least d (d - 1) / 2 tokens in all, so
there are at most about the square root of twice the tokens of them, some 100 000 over 30 GB of text. Places in the order
come from prefix sums of partition totals, over narrow rows, and each bucket's first place from the histogram.

Tokens are words, of the pattern ``[^\\x20\\x09-\\x0D]+``, or what ``tokens`` says. Null and empty texts have none and are
packed with bound 0 or that of their bucket. Documents that exceed the budget make batches of their own. Null ids come first
among equals; equal rows get the places among them. An empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

BUCKETS, BUDGET = 8, 16384
#: Bounds nothing any more: lengths aren't rounded. The name is kept for those who set it.
BINS = 65536


def best_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """The upper bounds, ascending, of at most ``buckets`` buckets with the least padding. histogram: (length, documents), ascending."""
    n = len(histogram)
    if not n:
        return []
    bound = [x for x, _ in histogram]
    count, weight = [0], [0]
    for x, c in histogram:
        count.append(count[-1] + c)
        weight.append(weight[-1] + x * c)
    best: list[int | None] = [0, *[None] * n]
    came: list[list[int]] = []
    for _ in range(min(buckets, n)):
        new: list[int | None] = [None] * (n + 1)
        origin = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, constant, i) of the lines of earlier cuts
        at = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                m, k = -count[j - 1], best[j - 1] + weight[j - 1]
                # the last line goes if the new one overtakes it no later than it overtakes the one before
                while len(hull) - at >= 2 and (k - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, k, j - 1))
            if not hull:
                continue
            x = bound[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            m, k, origin[j] = hull[at]
            new[j] = m * x + k + x * count[j] - weight[j]
        came.append(origin)
        best = new
    cuts, j = [], n
    for origin in reversed(came):
        cuts.append(bound[j - 1])
        j = origin[j]
    return cuts[::-1]


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET, tokens: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), bucket_len (its bound), batch and slot within the bucket, and padding."""
    spark = docs.sparkSession
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(C.WORD_PATTERN)) if tokens is None else tokens, F.lit(0)).cast("long")
    rows = C.durable(docs.select(F.col(doc_id).alias("doc_id"), n.alias("n_tokens")))
    histogram = sorted((r["n_tokens"], r["count"]) for r in rows.groupBy("n_tokens").count().collect())
    bounds = best_bounds(histogram, buckets)
    facts, first, low = [], 0, -1
    for b, top in enumerate(bounds):
        facts.append((b, top, first, max(1, budget // max(1, top))))
        first += sum(c for x, c in histogram if low < x <= top)
        low = top
    table = spark.createDataFrame(facts, "bucket int, bucket_len long, first long, per_batch long")  # a row a bucket
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("n_tokens"))) if bounds else F.lit(0)
    placed = C.running_totals(rows, ["n_tokens", "doc_id"], "n_tokens").withColumn("bucket", bucket.cast("int")).join(F.broadcast(table), "bucket")
    at = F.col("before_rows") - F.col("first")
    return placed.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(at / F.col("per_batch")).cast("long").alias("batch"), (at % F.col("per_batch")).alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.read(spark, sf_dir, "documents"))


def packing_sql(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """Plain dynamic programming over all pairs of lengths; ties go to the earlier cut."""
    steps = "".join(
        f"b{k} as materialized (select j.i as j, min(p.v + j.x * (j.c - i.c) - (j.w - i.w)) as v, arg_min(i.i, (p.v + j.x * (j.c - i.c) - (j.w - i.w)) * 1000000 + i.i) as o from h j join h i on i.i < j.i join b{k - 1} p on p.j = i.i where p.v is not null group by j.i),\n" for k in range(1, buckets + 1)
    )
    last = f"(select least({buckets}, max(i)) as k from h)"
    back = "".join(f"k{k} as (select case when {k} > m.k then (select max(i) from h) else (select o from b{k} where j = (select j from k{k + 1})) end as j from {last} m),\n" for k in range(buckets, 0, -1))
    ends = " union all ".join(f"select j from k{k + 1}" for k in range(1, buckets + 1))
    return f"""
with d as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '{C.WORD_PATTERN}')) as n_tokens from documents),
g as (select n_tokens as x, count(*) as n from d group by 1),
h as materialized (select row_number() over (order by x) as i, x::hugeint as x, sum(n) over (order by x) as c, sum(n * x) over (order by x) as w from g union all select 0, 0, 0, 0),
b0 as (select 0 as j, 0::hugeint as v),
{steps}k{buckets + 1} as (select max(i) as j from h),
{back}e as (select distinct h.x as bucket_len from ({ends}) join h on h.i = j),
bk as (select bucket_len, row_number() over (order by bucket_len) - 1 as bucket, greatest(1, {budget} // greatest(1, bucket_len)) as per from e),
p as (select d.*, (select min(bucket_len) from e where bucket_len >= d.n_tokens) as bl from d),
r as (select p.doc_id, p.n_tokens, bk.bucket, bk.bucket_len, bk.per, row_number() over (partition by bk.bucket order by n_tokens, doc_id) - 1 as at_row from p join bk on bk.bucket_len = p.bl)
select doc_id, n_tokens::bigint as n_tokens, bucket::int as bucket, bucket_len::bigint as bucket_len, (at_row // per)::bigint as batch, (at_row % per)::bigint as slot, (bucket_len - n_tokens)::bigint as padding from r
"""


QUERIES = {"op2_packing": op2_packing}
SQL = {"op2_packing": packing_sql()}
