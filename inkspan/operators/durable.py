"""Tables in the folder that driver and executors share, and places in an order over all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

_own: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it is unset, as in tests, a fresh local one.

    A local one is of use to one machine only, so a cluster without that setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="inkspan-"))
    return _own[0]


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder, for files that the caller deletes."""
    return f"{shared_dir(spark)}/inkspan-tables/{uuid.uuid4().hex}"


def durable(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet, with the writer's ``options``, to the shared folder and read it again.

    Lineage ends there, the files survive lost executors, and reading them needs no shuffle. The folder is the job's own,
    so it goes with it; :func:`forget` removes the tables of this process earlier.
    """
    path = scratch(df.sparkSession)
    df.write.options(**options).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables :func:`durable` has written and not forgotten in this process."""
    return len(_written)


def forget(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Delete the tables that :func:`durable` wrote from number ``since`` on, but the last ``but``; returns how many.

    Results that still read them must be consumed first.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _written[since : len(_written) - but]
    del _written[since : len(_written) - but]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def running_totals(df: DataFrame, order: list[str], size: str, partitions: int | None = None, held: bool = False) -> DataFrame:
    """``df`` with ``before_rows`` and ``before_size``: rows, and the sum of ``size``, that stand before each row in ``order``; ``all_size``: the sum over all.

    A range exchange deals the rows into partitions, which is written to the shared folder with the partition's number, so
    both passes see the same cuts. Each partition is counted on its own; only one row per partition is summed in order,
    and that table, bounded by the number of partitions, is broadcast. ``order`` should be a total order; equal rows get
    the places among them in any order. The frame must be narrow: it is written twice, first as it is, as the range exchange
    reads its input once to sample it and once more to deal it; ``held`` says that it is written already.
    """
    spark, part = df.sparkSession, "__part"
    df = df if held else durable(df)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in order]
    placed = durable(df.repartitionByRange(n, *by).withColumn(part, F.spark_partition_id()))
    totals = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__s"))
    whole, before = W.orderBy(part), W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        part,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"),
        F.sum("__s").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all_size"),
    )
    inner = W.partitionBy(part).orderBy(*by)
    own = placed.withColumn("before_rows", F.row_number().over(inner) - 1).withColumn("before_size", F.sum(size).over(inner.rowsBetween(W.unboundedPreceding, 0)) - F.col(size))
    return own.join(F.broadcast(bases), part).withColumns({"before_rows": (F.col("before_rows") + F.col("__n0")).cast("long"), "before_size": (F.col("before_size") + F.col("__s0")).cast("long")}).drop(part, "__n0", "__s0")


def ranks(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``before_rows``, the place of each row in ``order``, from 0."""
    return running_totals(df.withColumn("__one", F.lit(1)), order, "__one").drop("__one", "before_size", "all_size")
