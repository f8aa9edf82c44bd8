"""Train, validation and test splits, leakage checks and manifests.

A split by rank needs no global sort: the value at a rank is found from histograms of at most ``BINS`` bins (one pass for
each 12 bits of the values' range), and documents are then told apart by comparison, a projection without an exchange.
"""

from __future__ import annotations

import json
import random
from pyspark.sql import Column, DataFrame, functions as F

from inkspan.plans.config import SPLITS, Preparation

BINS = 4096
UNKNOWN = "UNKNOWN"


def value_at_rank(df: DataFrame, column: str, rank: int) -> int | None:
    """The value of a long column at ``rank`` (from 0) of its order; None if there are not so many rows. Nulls don't count."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if rank >= n:
        return None
    while low < high:
        width = max(1, -(-(high - low + 1) // BINS))
        # differences of far apart longs need more than 64 bits
        value = column if high - low < 1 << 63 else f"cast({column} as decimal(20, 0))"
        bins = df.where(F.col(column).between(low, high)).groupBy(F.expr(f"({value} - ({low})) div {width}").cast("long").alias("b")).count().collect()
        for b, c in sorted(tuple(r) for r in bins):
            if rank < c:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            rank -= c
    return low


def rank_key(seed: int, key: Column) -> Column:
    """60 bits of a hash of seed and key, as a long: a shuffle that doesn't depend on how rows are dealt."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 15), 16, 10).cast("long")


def cut_points(n: int, config: Preparation) -> tuple[int, int]:
    """Ranks at which validation and test begin; products are rounded down in double arithmetic."""
    train = int(n * config.train_ratio)
    return train, train + int(n * config.validation_ratio)


def _by_value(df: DataFrame, column: str, config: Preparation) -> Column:
    first, second = cut_points(df.where(F.col(column).isNotNull()).count(), config)
    cuts = [value_at_rank(df, column, r) for r in (first, second)]
    later = [F.lit(False) if c is None else F.col(column) >= F.lit(c) for c in cuts]
    return F.when(later[1], "test").when(later[0], "validation").otherwise("train")


def split_documents(docs: DataFrame, config: Preparation, doc_id: str = "document_id") -> DataFrame:
    """Adds split: documents in the order of a hash of seed and id, cut at the ratios."""
    keyed = docs.withColumn("__k", rank_key(config.seed, F.col(doc_id)))
    return keyed.withColumn("split", _by_value(keyed.select("__k"), "__k", config)).drop("__k")


def split_companies(docs: DataFrame, config: Preparation, ticker: str = "ticker") -> DataFrame:
    """Adds split: all documents of a company go the same way, companies in the order of a hash."""
    name = F.coalesce(F.col(ticker), F.lit(UNKNOWN))
    keyed = docs.withColumn("__k", rank_key(config.seed, name))
    return keyed.withColumn("split", _by_value(keyed.select("__k").distinct(), "__k", config)).drop("__k")


def split_temporal(docs: DataFrame, config: Preparation, date: str = "filing_date", order: str = "doc_idx", doc_id: str = "document_id") -> DataFrame:
    """Adds split: by date, then ``order``. Rows without a valid date are dropped, unless none has one: then by document."""
    dated = docs.withColumn("__d", F.unix_date(F.try_to_date(F.col(date), "yyyy-M-d")).cast("long")).where(F.col("__d").isNotNull())
    n = dated.count()
    if not n:
        return split_documents(docs, config, doc_id)
    split: Column = F.lit("train")
    for name, at in zip(SPLITS[1:], cut_points(n, config), strict=True):
        if at >= n:
            continue
        day = value_at_rank(dated, "__d", at)
        before = dated.where(F.col("__d") < day).count()
        within = value_at_rank(dated.where(F.col("__d") == day), order, at - before)
        split = F.when((F.col("__d") > day) | ((F.col("__d") == day) & (F.col(order) >= F.lit(within))), name).otherwise(split)
    return dated.withColumn("split", split).drop("__d")


def split_seeded(docs: DataFrame, config: Preparation, order: str = "doc_idx", key: str | None = None) -> DataFrame:
    """The split that Python's shuffle with this seed makes: of documents in ``order``, or of the values of ``key`` in the
    order they are first seen. Only positions or keys reach the driver; meant for parity on small corpora."""
    col = F.col(order) if key is None else F.coalesce(F.col(key), F.lit(UNKNOWN))
    firsts = docs.groupBy(col.alias("k")).agg(F.min(order).alias("o")).orderBy("o")
    keys = [r["k"] for r in firsts.collect()]
    random.Random(config.seed).shuffle(keys)
    first, second = cut_points(len(keys), config)
    rows = [(k, SPLITS[(i >= first) + (i >= second)]) for i, k in enumerate(keys)]
    table = docs.sparkSession.createDataFrame(rows, docs.select(col.alias("__key")).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", split string")
    return docs.withColumn("__key", col).join(table, "__key").drop("__key")


def split(docs: DataFrame, config: Preparation, **columns: str) -> DataFrame:
    kinds = {"company": split_companies, "document": split_documents, "temporal": split_temporal}
    return kinds[config.split_strategy](docs, config, **columns)


def _overlap(df: DataFrame, key: str) -> list[Column]:
    bit = {s: 1 << i for i, s in enumerate(SPLITS)}
    pairs = [("train", "validation"), ("train", "test"), ("validation", "test")]
    return [F.count_if(F.col("__s").bitwiseAND(bit[a] | bit[b]) == bit[a] | bit[b]).alias(f"{key}_{a}_{b}") for a, b in pairs]


def leakage(docs: DataFrame, doc_id: str = "document_id", ticker: str | None = None) -> DataFrame:
    """One row: ids, and with ``ticker`` companies, that are in two splits, for each pair of splits, and has_leakage."""
    code = F.when(F.col("split") == "train", 1).when(F.col("split") == "validation", 2).otherwise(4)
    one = docs.groupBy(doc_id).agg(F.bit_or(code).alias("__s")).agg(*_overlap(docs, "document"))
    if ticker:
        name = F.coalesce(F.col(ticker), F.lit(UNKNOWN)).alias("t")
        one = one.crossJoin(F.broadcast(docs.groupBy(name).agg(F.bit_or(code).alias("__s")).agg(*_overlap(docs, "company"))))
    total = sum((F.col(c) for c in one.columns[1:]), F.col(one.columns[0]))
    return one.withColumn("has_leakage", total > 0)


def manifest(docs: DataFrame, doc_id: str = "document_id") -> DataFrame:
    """(split, document_id): which documents each split has. Files list the ids in order; rows need none."""
    return docs.select("split", F.col(doc_id).alias("document_id"))


def load_manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def manifest_frame(spark, found: dict) -> DataFrame:
    rows = [(i, s) for s in SPLITS for i in found.get(s, [])]
    return spark.createDataFrame(rows, "document_id string, split string")


def validate_manifest(listed: DataFrame, docs: DataFrame, doc_id: str = "document_id") -> DataFrame:
    """One row: missing_documents, extra_documents, the three overlaps, is_valid (extra ones are only a warning)."""
    ids = docs.select(F.col(doc_id).alias("document_id")).distinct()
    there = listed.select("document_id").distinct()
    missing = ids.join(there, "document_id", "left_anti").agg(F.count(F.lit(1)).alias("missing_documents"))
    extra = there.join(ids, "document_id", "left_anti").agg(F.count(F.lit(1)).alias("extra_documents"))
    found = missing.crossJoin(F.broadcast(extra)).crossJoin(F.broadcast(leakage(listed)))
    return found.withColumn("is_valid", (F.col("missing_documents") == 0) & ~F.col("has_leakage")).drop("has_leakage")
