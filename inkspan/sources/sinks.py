"""Writers. Parquet is the native form. Marker files and JSON are exports for other tools: the rows are written by Spark, in
ranges of their order, and the parts then joined to one file by copying bytes, in any store that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkspan.operators.durable import scratch
from inkspan.plans.config import SPLITS

from .files import END, START, _path, created, write_whole


def write_native(docs: DataFrame, path: str, split: bool = False) -> None:
    """Parquet, a folder a split if asked for, so that readers of one split skip the others."""
    w = docs.write.mode("overwrite")
    (w.partitionBy("split") if split else w).parquet(str(path))


def write_parts(rows: DataFrame, value: Column, end: str, order: str, folder: str, between: bool = False) -> None:
    """Text files of ``value``, which ends in the character ``end``, that end to end are all rows in ``order``. ``between``: two
    line ends come before each row but the first."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if between:
        first = rows.agg(F.min(order)).first()[0]  # not joined: a sort below a join is dropped by the optimizer
        value = F.concat(F.when(F.col(order) == F.lit(first), F.lit("")).otherwise(F.lit("\n\n")), value)
    ordered = rows.repartitionByRange(n, order).sortWithinPartitions(order)
    # the sink puts its separator after each row, so that is each value's own last character
    ordered.select(value.substr(F.lit(1), F.length(value) - 1).alias("value")).write.option("lineSep", end).text(folder)


def join_parts(spark: SparkSession, path: str, parts: list[str | bytes]) -> None:
    """One file from folders of part files, in the order of their names, and bytes between them. Folders are deleted."""
    jvm = spark._jvm
    with created(spark, path) as out:
        for part in parts:
            if isinstance(part, bytes):
                out.write(bytearray(part))
                continue
            folder, fs = _path(spark, part)
            names = sorted(f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
            for name in names:
                held = fs.open(jvm.org.apache.hadoop.fs.Path(name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 20, False)
                held.close()
            fs.delete(folder, True)


def _framed(text: str, tail: str = "") -> Column:
    return F.concat(F.lit(f"{START}\n"), F.coalesce(F.col(text), F.lit("")), F.lit(f"\n{END}{tail}"))


def write_markers(docs: DataFrame, path: str, text: str = "text", order: str = "doc_idx") -> int:
    """Framed documents, a blank line between them, no newline at the end. Returns how many. Read ``docs`` from a table: it is used three times."""
    folder = scratch(docs.sparkSession)
    write_parts(docs, _framed(text), END[-1], order, folder, between=True)
    join_parts(docs.sparkSession, path, [folder])
    return docs.count()


def write_splits(docs: DataFrame, folder: str, boundary: str = "special", text: str = "text", order: str = "doc_idx") -> None:
    """train.txt, validation.txt and test.txt: framed documents, or texts alone, each followed by a blank line."""
    for s in SPLITS:
        parts = scratch(docs.sparkSession)
        value = _framed(text, "\n\n") if boundary == "special" else F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n\n"))
        write_parts(docs.where(F.col("split") == s), value, "\n", order, parts)
        join_parts(docs.sparkSession, f"{folder}/{s}.txt", [parts])


def write_lines(rows: DataFrame, path: str, order: str) -> None:
    """A JSON object a line, in ``order``; absent values have no key."""
    parts = scratch(rows.sparkSession)
    write_parts(rows, F.concat(F.to_json(F.struct(*rows.columns)), F.lit("\n")), "\n", order, parts)
    join_parts(rows.sparkSession, path, [parts])


def write_manifest(docs: DataFrame, config, path: str, ticker: str | None = None, doc_id: str = "document_id") -> None:
    """The manifest of a split as one JSON file: strategy, seed, the sorted ids of each split and, of companies, where each went."""
    spark = docs.sparkSession

    def listed(df: DataFrame, value: Column, order: str) -> str:
        parts = scratch(spark)
        first = F.broadcast(df.agg(F.min(order).alias("__first")))
        comma = F.when(F.col(order) == F.col("__first"), F.lit("")).otherwise(F.lit(", "))
        rows = df.crossJoin(first).select(order, F.concat(comma, value).alias("v"))
        write_parts(rows, F.col("v"), '"', order, parts)
        return parts

    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    out: list[str | bytes] = [("{\n" + f'  "strategy": {json.dumps(config.split_strategy)},\n  "seed": {config.seed}').encode()]
    for s in SPLITS:
        ids = docs.where(F.col("split") == s).select(F.col(doc_id).cast("string").alias("i"))
        out += [f',\n  "{s}": ['.encode(), listed(ids, quoted("i"), "i"), b"]"]
    if ticker and config.split_strategy == "company":
        rows = docs.select(F.coalesce(F.col(ticker), F.lit("UNKNOWN")).alias("t"), "split").distinct()
        out += [b',\n  "company_assignments": {', listed(rows, F.concat(quoted("t"), F.lit(": "), quoted("split")), "t"), b"}"]
    join_parts(spark, path, [*out, b"\n}\n"])


def split_metadata(docs: DataFrame, text: str = "text") -> DataFrame:
    """What is known of each document but its text, and its length."""
    return docs.withColumn("length", F.length(text).cast("long")).drop(text)


def write_json(spark: SparkSession, found: object, path: str) -> None:
    """A small report."""
    write_whole(spark, path, json.dumps(found, indent=2, ensure_ascii=False, default=str))


def one_row(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict(recursive=True) if row else {}
