"""WARC records, and a fixity audit of replicas by Merkle trees.

An archive is a run of records in a fixed order, each with its offset. Records are hashed; a leaf of the tree hashes, in
order, all (offset, length, digest) of the records that begin in one range of ``LEAF_BYTES``; a node above hashes ``FANOUT``
ranges next to each other; up to one root. Ranges are of offsets, not of record numbers, so a record that is lost or added
changes its own range only. Two replicas are compared from the root down: only children of nodes that differ are looked at,
and only the records of leaves that differ are compared one by one.

Each level is an aggregate over groups of at most ``FANOUT`` nodes, or of the records that fit a leaf (their number is bounded
by the range and the least size of a record), whatever host or page repeats. A level has a ``FANOUT``-th of the rows of the
one below and is written to the shared folder. The driver sees row counts alone.

:func:`write_warc` and :func:`read_warc` are the file side: UTF-8 bodies are written by Spark's own text sink, a file a range
of bytes, and read back from any store that Spark reads.

Defined results: null urls and bodies count as empty; rows with equal ids are ordered by url and digest, and all are records;
null ids come first. An empty archive has no nodes and no findings. Columns other than id, url and body are not archived.
"""

from __future__ import annotations

import gzip
import io
import itertools
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

LEAF_BYTES, FANOUT, FILE_BYTES = 1 << 18, 16, 1 << 26


def record_of(url: Column, body: Column, page_id: Column) -> Column:
    """A WARC/1.0 resource record, as text."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    key = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit(" "), url))
    uuid = F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page_id, offset, length, digest) of each record, in order of (page_id, url, digest)."""
    record = record_of(F.col(url), F.col(body), F.col(page_id))
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("__url"), record.alias("__r"))
    rows = rows.select("page_id", F.sha2("__url", 256).alias("__url"), F.octet_length("__r").cast("long").alias("length"), F.sha2("__r", 256).alias("digest"))
    return C.running_totals(rows, ["page_id", "__url", "digest"], "length").select("page_id", F.col("before_size").alias("offset"), "length", "digest")


def tree(records: DataFrame, levels: int, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """(node, hash) of each level, leaves first; ``levels`` of them."""
    line = F.concat_ws(" ", F.col("offset").cast("string"), F.col("length").cast("string"), "digest")
    rows = records.select(F.expr(f"offset div {leaf_bytes}").alias("node"), F.struct("offset", line.alias("h")).alias("child"))
    out = []
    for _ in range(levels):
        whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda c: c["h"]), "\n"), 256)
        out.append(C.durable(rows.groupBy("node").agg(whole.alias("hash"))))
        rows = out[-1].select(F.expr(f"node div {fanout}").alias("node"), F.struct(F.col("node").alias("offset"), F.col("hash").alias("h")).alias("child"))
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose hashes differ, or that one side lacks."""
    return a.alias("a").join(b.alias("b"), "node", "full").where(~F.col("a.hash").eqNullSafe(F.col("b.hash"))).select("node")


def audit(primary: DataFrame, replica: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> tuple[DataFrame, list[int]]:
    """Records in which two manifests (offset, length, digest) differ: (offset, status), status 'changed', 'lost' or 'added'.

    Also returns how many nodes were compared at each level, root first.
    """
    end = max((x.agg(F.max("offset")).first()[0] or 0) for x in (primary, replica))
    levels, ranges = 1, end // leaf_bytes + 1
    while ranges > 1:
        levels, ranges = levels + 1, -(-ranges // fanout)
    one, other = tree(primary, levels, leaf_bytes, fanout), tree(replica, levels, leaf_bytes, fanout)
    compared, wrong = [], None
    for level in range(levels - 1, -1, -1):
        a, b = one[level], other[level]
        if wrong is not None:
            above = wrong.withColumnRenamed("node", "__above")
            a, b = (x.join(above, F.expr(f"node div {fanout}") == F.col("__above"), "left_semi") for x in (a, b))
        compared.append(a.count())
        wrong = C.durable(_differing(a, b))
    leaf = F.expr(f"offset div {leaf_bytes}")
    left, right = (x.join(wrong, leaf == F.col("node"), "left_semi").select("offset", F.struct("length", "digest").alias("is")) for x in (primary, replica))
    both = left.alias("a").join(right.alias("b"), "offset", "full").where(~F.col("a.is").eqNullSafe(F.col("b.is")))
    return both.select("offset", F.when(F.col("b.is").isNull(), "lost").when(F.col("a.is").isNull(), "added").otherwise("changed").alias("status")), compared


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", body: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Write records, in order, as text files below ``path``/file=N; each holds the records that begin in N's range of bytes."""
    rows = pages.select(F.col(page_id).alias("page_id"), record_of(F.col(url), F.col(body), F.col(page_id)).alias("value"))
    sized = rows.select("page_id", "value", F.octet_length("value").cast("long").alias("length"))
    placed = C.running_totals(sized, ["page_id", "value"], "length").withColumn("file", F.expr(f"before_size div {file_bytes}"))
    # a record ends in \r\n\r\n, the last character of which is the sink's line separator
    value = F.expr("substring(value, 1, length(value) - 1)").alias("value")
    placed.repartition("file").sortWithinPartitions("file", "before_size").select("file", value).write.partitionBy("file").option("lineSep", "\n").text(path)


def _parse(stream: BinaryIO) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, body) of each record, one at a time."""
    at = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        size, headers = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        if "content-length" not in headers:
            raise ValueError(f"no length in the WARC record at byte {at}")
        n = int(headers["content-length"])
        body, end = stream.read(n), stream.read(4)
        if len(body) < n or end != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} is cut short")
        size += len(line) + n + 4
        yield at, size, headers, body
        at += size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, type, url, body) of the records of WARC files, plain or gzipped (offsets are then of the unpacked
    bytes). A task holds a file as it is stored, which must be below 2 GB, and some records; what is gzipped is unpacked as it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "offset", "length", "type", "url", "body"], (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column("path")[i].as_py(), batch.column("content")[i].as_buffer()
                stream = io.BytesIO(data)
                if bytes(data[:2]) == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
                rows = ((name, o, n, h.get("warc-type"), h.get("warc-target-uri"), b) for o, n, h, b in _parse(stream))
                while some := list(itertools.islice(rows, 64)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, offset long, length long, type string, url string, body binary")


#: In the query's replica, the body of each page whose id leaves 7 modulo 251 has another first character.
DAMAGE = (251, 7)


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, audit a replica damaged by the rule above, and give each record's place, digest and state."""
    pages = C.read(spark, sf_dir, "pages")
    body = F.coalesce(F.col("html"), F.lit(""))
    hit = (F.pmod("page_id", F.lit(DAMAGE[0])) == DAMAGE[1]) & (F.length(body) > 0)
    damaged = F.when(hit, F.concat(F.when(F.substring(body, 1, 1) == "#", "%").otherwise("#"), F.expr("substring(coalesce(html, ''), 2)"))).otherwise(body)
    primary, replica = C.durable(manifest(pages)), C.durable(manifest(pages.withColumn("html", damaged)))
    found, _ = audit(primary, replica)
    return primary.join(found, "offset", "left").select("page_id", "offset", "length", "digest", F.coalesce("status", F.lit("intact")).alias("status"))


OP7_SQL = r"""
with r as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html, md5(coalesce(page_id::varchar, '') || ' ' || coalesce(url, '')) as k from pages),
t as (select page_id, html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || k[1:8] || '-' || k[9:12] || '-' || k[13:16] || '-' || k[17:20] || '-' || k[21:32] || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) as rec from r),
d as (select page_id, html, octet_length(encode(rec)) as length, sha256(rec) as digest from t)
select page_id, coalesce(sum(length) over (order by page_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset", length::bigint as length, digest, case when page_id % 251 = 7 and html <> '' then 'changed' else 'intact' end as status from d
"""

QUERIES = {"op7_warc_fixity": op7_warc_fixity}
SQL = {"op7_warc_fixity": OP7_SQL}
