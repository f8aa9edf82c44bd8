"""Corpus statistics, each an aggregate with a map-side part; nothing is gathered but the small tables they end in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Substrings counted as they are, and those counted in lower case.
PATTERNS = ("%", "$", "10-K", "10-Q", "ITEM", "PART")
TERMS = ("million", "billion", "revenue", "assets", "liabilities", "income", "cash flow", "net income", "operating", "quarter")
# Characters that vocabulary candidates look for.
PUNCTUATION = ".,:;%$-/()\"'&+=*"
NUMERIC = "0123456789.,%"
#: Percentiles that length statistics report, by index into the sorted lengths.
QUANTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def characters(docs: DataFrame, text: str = "text", order: str | None = None) -> DataFrame:
    """(character, frequency), and with ``order`` first_seen: the least (order, position), which breaks ties of top lists.

    Code points are counted by Arrow batch, so a row a distinct character and batch goes on, not one a character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                if order is not None:
                    part = part.take(pc.sort_indices(part.column("o")))
                texts = [t or "" for t in part.column("t").to_pylist()]
                flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                if order is None:
                    times = np.bincount(flat)
                    kinds, times = np.flatnonzero(times), times[times > 0]
                else:
                    kinds, first, times = np.unique(flat, return_index=True, return_counts=True)
                made = [pa.array([chr(c) for c in kinds.tolist()], pa.string()), pa.array(times.astype(np.int64))]
                if order is not None:
                    ends = np.cumsum([len(t) for t in texts])
                    row = np.searchsorted(ends, first, "right")
                    made += [part.column("o").take(pa.array(row)), pa.array((first - np.concatenate([[0], ends])[row]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(made, names=["character", "n", "o", "p"][: len(made)])

    own = [] if order is None else [F.col(order).alias("o")]
    kind = "" if order is None else f", o {docs.schema[order].dataType.simpleString()}, p long"
    seen = docs.select(F.col(text).alias("t"), *own).mapInArrow(run, f"character string, n long{kind}")
    return seen.groupBy("character").agg(F.sum("n").alias("frequency"), *([F.min(F.struct("o", "p")).alias("first_seen")] if own else []))


def with_percentage(freq: DataFrame, count: str = "frequency") -> DataFrame:
    total = freq.agg(F.sum(count).alias("__total"))  # one row
    return freq.crossJoin(F.broadcast(total)).withColumn("percentage", F.col(count) / F.col("__total") * 100).drop("__total")


def byte_values(docs: DataFrame, text: str = "text") -> DataFrame:
    """(byte, frequency) over the UTF-8 bytes, counted by task, so at most 256 rows a task go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(256, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                flat = b"".join(batch.column("t").slice(at, 1024).drop_null().cast(pa.large_binary()).to_pylist())
                times += np.bincount(np.frombuffer(flat, np.uint8), minlength=256)
        kinds = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(times[kinds])], names=["byte", "n"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("frequency"))


def most_common(freq: DataFrame, k: int, count: str = "frequency", first: str = "first_seen") -> DataFrame:
    """The k largest counts; of equal ones those seen first."""
    return freq.orderBy(F.desc(count), first).limit(k)


def rare_characters(freq: DataFrame, threshold: int = 10) -> DataFrame:
    point = F.ascii("character")
    code = F.concat(F.lit("U+"), F.when(point < 0x10000, F.lpad(F.hex(point), 4, "0")).otherwise(F.hex(point)))
    return with_percentage(freq).where(F.col("frequency") <= threshold).select("character", "frequency", "percentage", code.alias("code_point"))


def length_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: minimum, maximum, mean, the middle length and percentiles, all picks from the sorted lengths.

    The table of distinct lengths carries counts, so ordering it is cheap whatever the number of documents.
    """
    by = docs.groupBy(F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy("len")
    ranked = by.withColumns({"upto": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})

    def pick(index: Column) -> Column:
        return F.coalesce(F.min(F.when(F.col("upto") > index, F.col("len"))), F.lit(0))

    zero = lambda c: F.coalesce(c, F.lit(0))
    return ranked.agg(
        zero(F.min("len")).alias("minimum_document_length"),
        zero(F.max("len")).alias("maximum_document_length"),
        F.coalesce(F.sum(F.col("len") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("mean_document_length"),
        pick(F.expr("all div 2")).alias("median_document_length"),
        *[pick(F.floor(F.col("all").cast("double") * F.lit(q))).alias(name) for name, q in QUANTILES.items()],
    )


def _occurrences(c: Column, sub: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))) / len(sub)).cast("long")


def pattern_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, n): occurrences that don't overlap, counted in one pass."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(t.alias("t"), F.lower(t).alias("l"))
    one = d.agg(*[F.coalesce(F.sum(_occurrences(F.col("t" if p in PATTERNS else "l"), p)), F.lit(0)).alias(f"c{i}") for i, p in enumerate((*PATTERNS, *TERMS))])
    pairs = ", ".join(f"'{p}', c{i}" for i, p in enumerate((*PATTERNS, *TERMS)))
    return one.selectExpr(f"stack({len(PATTERNS) + len(TERMS)}, {pairs}) as (pattern, n)")


def companies(docs: DataFrame, ticker: str = "ticker") -> DataFrame:
    return docs.groupBy(F.coalesce(F.col(ticker), F.lit("UNKNOWN")).alias("ticker")).agg(F.count(F.lit(1)).alias("filings"))


def company_statistics(docs: DataFrame, ticker: str = "ticker") -> DataFrame:
    return companies(docs, ticker).agg(F.count(F.lit(1)).alias("total_companies"), F.count_if(F.col("filings") > 1).alias("companies_with_multiple_filings"), F.coalesce(F.max("filings"), F.lit(0)).alias("most_filings"))


def vocabulary_candidates(freq: DataFrame) -> DataFrame:
    """(kind, character): which white space, punctuation and numeric characters occur."""
    space = F.col("character").rlike(r"(?U)\A[\s\x1c-\x1f]\z")
    kinds = {"whitespace": space, "punctuation": F.col("character").isin(*PUNCTUATION), "numeric": F.col("character").isin(*NUMERIC)}
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull())
    return freq.select(F.explode(found).alias("kind"), "character")


def split_statistics(docs: DataFrame, text: str = "text", ticker: str = "ticker", split: str = "split") -> DataFrame:
    """Of each split that has documents: documents, characters, bytes and distinct companies."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.groupBy(split).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length(t)).cast("long").alias("characters"), F.sum(F.octet_length(t)).cast("long").alias("bytes"), F.countDistinct(F.coalesce(F.col(ticker), F.lit("UNKNOWN"))).alias("companies"))
