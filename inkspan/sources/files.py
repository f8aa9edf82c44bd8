"""Readers: directories of documents, ZIP archives, marker files and metadata lines."""

from __future__ import annotations

import contextlib
import hashlib
import io
import itertools
import json
import logging
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from inkspan.operators.durable import durable, ranks
from inkspan.plans.config import Ingestion

_log = logging.getLogger(__name__)
START, END = "<DOCUMENT_START>", "<DOCUMENT_END>"
#: The table that cleaning leaves beside its exports.
HANDED_OVER = "documents.parquet"
#: Shortest content that preparation and training keep.
LEAST = 100
METADATA = "document_id string, original_length long, steps_completed array<string>, errors array<string>, encoding_issues array<string>, table_count long, html_elements_removed long, xbrl_elements_removed long, cleaned_length long, status string, is_duplicate boolean, duplicate_of string, ticker string, filing_date string"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as the binary reader writes it."""
    p, fs = _path(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def require_dir(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"Input directory not found: {path}")
    if not fs.getFileStatus(p).isDirectory():
        raise NotADirectoryError(f"Input path is not a directory: {path}")


def require_files(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p, fs = _path(spark, path)
        if not fs.exists(p):
            raise FileNotFoundError(f"Required file not found: {path}")


def decoded(content: Column) -> Column:
    """UTF-8 with U+FFFD for what is malformed, and line ends as newlines."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), F.lit("\r\n?"), F.lit("\n"))


#: File names by extension, in either case; what doesn't match is not even opened.
_TEXTS, _ARCHIVES = "*.{[tT][xX][tT],[hH][tT][mM],[hH][tT][mM][lL]}", "*.zip"
_IS_TEXT = r"(?i)\.(txt|html?)$"
#: Where members of archives are kept, and which archives were read, below the folder of extracted files.
MEMBERS, MANIFEST = "members.parquet", ".extraction_manifest.json"
_MEMBER = "archive string, sha256 string, member_idx long, base_name string, content binary, stem string, file_name string"


def _files(spark: SparkSession, names: str, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(list(paths))


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def size_of(spark: SparkSession, path: str) -> int:
    p, fs = _path(spark, path)
    return fs.getFileStatus(p).getLen()


def find_documents(spark: SparkSession, path: str, extract_dir: str = "_extracted") -> DataFrame:
    """(path, content) of the .txt, .html and .htm files below ``path``. Spark passes over hidden folders, so the folder of
    extracted members is read by name."""
    require_dir(spark, path)
    inner = f"{path}/{extract_dir}"
    return _files(spark, _TEXTS, str(path), *[inner] * bool(extract_dir and _exists(spark, inner))).select("path", "content")


def load_documents(spark: SparkSession, path: str, config: Ingestion | None = None) -> DataFrame:
    """(doc_idx, path, text) in the order of path components; with ``extract_zip``, :func:`extract` comes first, and members
    count as files below ``_extracted``/archive."""
    config = config or Ingestion()
    if config.extract_zip:
        extract(spark, path, config)
    docs = find_documents(spark, path, config.extract_dir).select("path", decoded(F.col("content")).alias("text"))
    if config.extract_zip:
        place = F.concat(F.lit(f"{_qualified(spark, path)}/{config.extract_dir}/"), F.col("stem"), F.lit("/"), F.col("file_name"))
        members = extracted(spark, path, config).where(F.col("file_name").rlike(_IS_TEXT))
        docs = docs.unionByName(members.select(place.alias("path"), decoded(F.col("content")).alias("text")))
    if docs.isEmpty():
        raise ValueError(f"No supported documents found in {path}")
    # positions come from the paths alone, which are unique; texts join them by path
    order = ranks(docs.select("path", F.split("path", "/").alias("parts")), ["parts"]).select("path", F.col("before_rows").alias("doc_idx"))
    return docs.join(order, "path").select("doc_idx", "path", "text")


def _members(limit: int, total: int):
    def rows(name: str, data: bytes) -> Iterator[tuple]:
        digest = hashlib.sha256(data).hexdigest()
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                infos = z.infolist()
                if total and sum(i.file_size for i in infos) > total:
                    yield name, digest, None, None, None, f"Archive {name} would exceed the limit of {total} bytes"
                    return
                for n, info in enumerate(infos):
                    parts = info.filename.replace("\\", "/").split("/")
                    link = info.external_attr >> 16 & 0xF000 == 0xA000
                    unsafe = ".." in parts or info.filename.startswith(("/", "\\")) or parts[0].endswith(":")
                    if info.is_dir() or link or unsafe or limit and info.file_size > limit:
                        continue
                    try:
                        yield name, digest, n, parts[-1], z.read(info), None
                    except Exception as e:  # a member that can't be read is passed over, the others count
                        _log.warning("%s: can't read %s: %s", name, info.filename, e)
                yield name, digest, -1, None, None, None  # the archive was read, even if it is empty
        except zipfile.BadZipFile as e:
            yield name, digest, None, None, None, f"Corrupt ZIP archive {name}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "sha256", "member_idx", "base_name", "content", "error"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for row in rows(path, data):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    return run


def unpack(zips: DataFrame, config: Ingestion) -> DataFrame:
    """(archive, sha256, member_idx, base_name, content, error) of the members of archives (path, content). An archive that
    can't be read, or holds too much, is one row with an error; one that was read has a row with member -1."""
    return zips.select("path", "content").mapInArrow(_members(config.max_extracted_file_size, config.max_total_extracted_size), "archive string, sha256 string, member_idx long, base_name string, content binary, error string")


def read_archives(spark: SparkSession, path: str, config: Ingestion | None = None) -> DataFrame:
    """:func:`unpack` for all ``*.zip`` below ``path``."""
    require_dir(spark, path)
    return unpack(_files(spark, _ARCHIVES, str(path)), config or Ingestion(extract_zip=True))


def named_members(found: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Members with (stem, file_name): the archive's name and the member's base name. A name that is taken in its stem, by an
    earlier member (in the order of archive and place) or in ``taken`` (stem, file_name), gets the first of _1, _2... that is
    free. Names are given apart from the contents; (archive, member_idx) is unique, so the join multiplies nothing."""
    stem = F.regexp_replace(F.element_at(F.split("archive", "/"), -1), r"\.zip$", "")
    named = found.where("member_idx >= 0").withColumn("stem", stem)
    rows = named.select("stem", "archive", "member_idx", "base_name")
    if taken is not None:
        rows = rows.unionByName(taken.select("stem", F.lit("").alias("archive"), F.lit(-1).cast("long").alias("member_idx"), F.col("file_name").alias("base_name")))

    def name(group: pd.DataFrame) -> pd.DataFrame:
        group, used, out = group.sort_values(["archive", "member_idx"], kind="stable"), set(), []
        for wanted in group["base_name"]:
            base, dot, ext = wanted.rpartition(".")
            base, ext = (base, dot + ext) if base else (wanted, "")
            free = next(x for n in itertools.count() if (x := f"{base}_{n}{ext}" if n else wanted) not in used)
            used.add(free)
            out.append(free)
        return group.assign(file_name=out)[group["member_idx"] >= 0][["archive", "member_idx", "file_name"]]

    names = rows.groupBy("stem").applyInPandas(name, "archive string, member_idx long, file_name string")
    return named.join(names, ["archive", "member_idx"])


def _members_path(path: str, config: Ingestion) -> str:
    return f"{path}/{config.extract_dir}/{MEMBERS}"


def extracted(spark: SparkSession, path: str, config: Ingestion | None = None) -> DataFrame:
    """All members that :func:`extract` has kept below ``path``, with stem and file_name."""
    held = _members_path(path, config or Ingestion())
    return spark.read.schema(_MEMBER).parquet(held) if _exists(spark, held) else spark.createDataFrame([], _MEMBER)


def extract(spark: SparkSession, path: str, config: Ingestion | None = None) -> dict:
    """Unpack the archives below ``path`` that the manifest doesn't list with their present hash, and report on it.

    Members are added to the Parquet table ``_extracted``/members.parquet, by the tasks that read the archives; the manifest,
    {archive: sha256}, is written after it. The driver sees counts, names of archives and error texts only.
    """
    config = config or Ingestion(extract_zip=True)
    report = {"enabled": config.extract_zip, "archives_discovered": 0, "archives_extracted": 0, "archives_skipped": 0, "archives_failed": 0, "files_extracted": 0, "errors": [], "extract_dir": config.extract_dir}
    if not config.extract_zip:
        return report
    listing = f"{path}/{config.extract_dir}/{MANIFEST}"
    done = load_archive_manifest(spark, listing)
    rows = durable(read_archives(spark, path, config).join(F.broadcast(done.withColumn("skipped", F.lit(True))), ["archive", "sha256"], "left"))
    per = rows.groupBy("archive", "sha256", "skipped").agg(F.count_if(F.col("member_idx") >= 0).alias("n"), F.max("error").alias("error")).orderBy("archive").collect()  # a row an archive
    fresh = [r for r in per if not r["skipped"]]
    good = [r for r in fresh if r["error"] is None]
    if any(r["n"] for r in good):
        inner = f"{path}/{config.extract_dir}"
        taken = extracted(spark, path, config).select("stem", "file_name")
        on_disk = _files(spark, "*", inner).select(F.split("path", "/").alias("p")).select(F.element_at("p", -2).alias("stem"), F.element_at("p", -1).alias("file_name")) if _exists(spark, inner) else taken.limit(0)
        new = named_members(rows.where("skipped is null and error is null"), taken.unionByName(on_disk))
        new.select(*[c.split()[0] for c in _MEMBER.split(", ")]).write.mode("append").parquet(_members_path(path, config))
    if good:
        save_archive_manifest(spark, {r["archive"]: r["sha256"] for r in done.collect()} | {r["archive"]: r["sha256"] for r in good}, listing)
    return report | {"archives_discovered": len(per), "archives_extracted": len(good), "archives_skipped": len(per) - len(fresh), "archives_failed": len(fresh) - len(good), "files_extracted": sum(r["n"] for r in good), "errors": [r["error"] for r in fresh if r["error"] is not None]}


def load_archive_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest as JSON, {archive: sha256}; an unreadable one counts as empty."""
    try:
        rows = list(json.loads(read_whole(spark, path)).items()) if _exists(spark, path) else []
    except (ValueError, AttributeError) as e:
        _log.warning("unreadable manifest %s: %s", path, e)
        rows = []
    return spark.createDataFrame(rows, "archive string, sha256 string")


def save_archive_manifest(spark: SparkSession, found: dict[str, str], path: str) -> None:
    write_whole(spark, path, json.dumps(found, indent=2))


def read_whole(spark: SparkSession, path: str) -> str:
    """A small file of any store, such as a report."""
    p, fs = _path(spark, path)
    held = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(held)).decode("utf-8", "replace")
    finally:
        held.close()


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    with created(spark, path) as out:
        out.write(bytearray(text.encode()))


@contextlib.contextmanager
def created(spark: SparkSession, path: str):
    """A new file of any store, without a checksum file beside it."""
    p, fs = _path(spark, path)
    fs.setWriteChecksum(False)
    try:
        out = fs.create(p, True)
    finally:
        fs.setWriteChecksum(True)
    try:
        yield out
    finally:
        out.close()


# --- marker files ------------------------------------------------------------------------------------------------------


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(at, p): what stands between separators in a file, by many tasks, with its place, from 0.

    A block of the file is read by one task, in order, so a piece's place is its place in its block after the pieces of all
    blocks before; only one row a block is summed in order.
    """
    require_files(spark, path)
    block = F.col("_metadata.file_block_start")
    held = durable(spark.read.option("lineSep", separator).text(str(path)).select(block.alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("p")))
    per = held.groupBy("b").agg(F.min("i").alias("i0"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(per.select("b", (before - F.col("i0")).alias("base"))), "b").select((F.col("i") + F.col("base")).cast("long").alias("at"), "p")


_STRIP = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(_STRIP), F.lit(""))


def split_raw(parts: DataFrame) -> DataFrame:
    """(doc_idx, document_id, text) of the pieces (at, p) of a raw corpus, cut at start markers in capitals; those in other
    cases are cut here. End markers and empty pieces are dropped. Positions are counted apart from the texts."""
    cut = parts.select("at", F.posexplode(F.split(decoded(F.col("p")), "(?i)<document_start>")).alias("sub", "p"))
    texts = durable(cut.select("at", "sub", _strip(F.regexp_replace("p", "(?i)<document_end>", "")).alias("text")).where("text <> ''"))
    placed = ranks(texts.select("at", "sub"), ["at", "sub"]).withColumnRenamed("before_rows", "doc_idx")
    return texts.join(placed, ["at", "sub"]).select("doc_idx", F.format_string("doc_%06d", "doc_idx").alias("document_id"), "text")


def split_prepared(parts: DataFrame) -> DataFrame:
    """(part_idx, document_id, text) of pieces (at, p): those with an end marker, up to it; ids count all pieces, the one
    before the first marker too."""
    p = decoded(F.col("p"))
    return parts.where(F.col("p").contains(END)).select(F.col("at").alias("part_idx"), F.format_string("doc_%06d", "at").alias("document_id"), _strip(F.substring_index(p, END, 1)).alias("text"))


def raw_marker_file(spark: SparkSession, path: str) -> DataFrame:
    return split_raw(pieces(spark, path, START))


def prepared_marker_file(spark: SparkSession, path: str) -> DataFrame:
    return split_prepared(pieces(spark, path, START))


def long_enough(prepared: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_idx, text) of contents of at least ``least`` characters."""
    return prepared.where(F.length("text") >= least).select(F.col("part_idx").alias("doc_idx"), "text")


def training_marker_file(spark: SparkSession, path: str, least: int = LEAST) -> DataFrame:
    return long_enough(prepared_marker_file(spark, path), least)


def last_records(lines: DataFrame, schema: str = METADATA) -> DataFrame:
    """Records of (line, v), v a JSON object, with their line: by document_id, the last of each; blank lines and records
    without an id are dropped."""
    rows = lines.where(F.trim("v") != "").select("line", F.from_json("v", schema).alias("r")).where(F.col("r.document_id").isNotNull())
    return rows.groupBy(F.col("r.document_id").alias("__id")).agg(F.max_by(F.struct("line", "r"), "line").alias("x")).select("x.line", "x.r.*")


def metadata_lines(spark: SparkSession, path: str, schema: str = METADATA) -> DataFrame:
    return last_records(pieces(spark, path, "\n").select(F.col("at").alias("line"), F.col("p").alias("v")), schema)


def load_cleaned(spark: SparkSession, folder: str, least: int = LEAST) -> DataFrame:
    """Prepared documents of a cleaned folder; failed, marked and short ones are left out.

    The Parquet hand-over (:data:`HANDED_OVER`), if the folder has it, carries ids and flags itself. Otherwise corpus.txt and metadata.jsonl
    are joined. The corpus holds the documents that were kept, the metadata those that succeeded, and each counts ids its own
    way; so if there are as many kept records as documents, the k-th goes to the k-th, and ids are those of the metadata. Else
    records belong to the documents whose id, by place in the corpus, they name.
    """
    require_files(spark, f"{folder}/corpus.txt", f"{folder}/metadata.jsonl")
    if _exists(spark, f"{folder}/{HANDED_OVER}"):
        found = spark.read.parquet(f"{folder}/{HANDED_OVER}")
        absent = [f for f in spark.createDataFrame([], METADATA).schema if f.name not in found.columns]
        found = found.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}) if absent else found
    else:
        parts = pieces(spark, f"{folder}/corpus.txt", START)
        docs, meta = split_prepared(parts).withColumnRenamed("part_idx", "doc_idx"), durable(metadata_lines(spark, f"{folder}/metadata.jsonl"))
        kept = meta.where((F.coalesce("status", F.lit("")) != "failed") & ~F.coalesce("is_duplicate", F.lit(False)))
        if kept.count() == parts.where("at > 0").count():
            # the piece of place 0 stands before the first marker
            placed = ranks(kept.select("line"), ["line"]).select("line", (F.col("before_rows") + 1).alias("doc_idx"))
            found = docs.drop("document_id").join(kept.join(placed, "line"), "doc_idx").drop("line")
        else:
            found = docs.join(meta.drop("line"), "document_id", "left")
    return found.where((F.coalesce("status", F.lit("")) != "failed") & ~F.coalesce("is_duplicate", F.lit(False)) & (F.length("text") >= least))
