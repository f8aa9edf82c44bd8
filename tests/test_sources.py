import json
import zipfile

import pytest

from inkspan.plans.config import Ingestion
from inkspan.sources import files, sinks


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    for name, data in {"b/c.htm": "<html>C", "b.txt": "B\r\nb", "a/FILE.HtM": "F", "x.pdf": "no", "_extracted/old/e.txt": "E"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data.encode())
    (root / "bad.txt").write_bytes(b"\xe9a\xf0\x9f\x98")
    return root


def test_discovery_order_and_decoding(spark, folder):
    rows = files.load_documents(spark, str(folder)).orderBy("doc_idx").collect()
    names = [r["path"].split("/in/")[1] for r in rows]
    assert names == ["_extracted/old/e.txt", "a/FILE.HtM", "b/c.htm", "b.txt", "bad.txt"]
    assert rows[3]["text"] == "B\nb"
    assert rows[4]["text"] == b"\xe9a\xf0\x9f\x98".decode("utf-8", "replace")


def test_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.find_documents(spark, str(tmp_path / "none"))
    (tmp_path / "f").write_text("x")
    with pytest.raises(NotADirectoryError):
        files.find_documents(spark, str(tmp_path / "f"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.pdf").write_text("x")
    with pytest.raises(ValueError):
        files.load_documents(spark, str(tmp_path / "empty"))
    with pytest.raises(FileNotFoundError):
        files.load_cleaned(spark, str(tmp_path))


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members:
            z.writestr(name, data)


def test_archives(spark, folder):
    _zip(folder / "a.zip", [("d1/f.txt", "one"), ("d2/f.txt", "two"), ("../etc/passwd", "no"), ("big.txt", "x" * 5000), ("dir/", "")])
    _zip(folder / "empty.zip", [])
    _zip(folder / "bomb.zip", [(f"{i}.txt", "y" * 900) for i in range(30)])
    (folder / "broken.zip").write_bytes(b"not a zip")
    c = Ingestion(extract_zip=True, max_extracted_file_size=1000, max_total_extracted_size=20000)
    r = files.extract(spark, str(folder), c)
    assert (r["archives_discovered"], r["archives_extracted"], r["archives_skipped"], r["archives_failed"], r["files_extracted"]) == (4, 2, 0, 2, 2)
    assert len(r["errors"]) == 2
    names = {r["file_name"]: bytes(r["content"]) for r in files.extracted(spark, str(folder), c).collect()}
    assert names == {"f.txt": b"one", "f_1.txt": b"two"}
    # a second run passes over what was read, and fails again on what wasn't
    r = files.extract(spark, str(folder), c)
    assert (r["archives_extracted"], r["archives_skipped"], r["archives_failed"], r["files_extracted"]) == (0, 2, 2, 0)
    assert files.extract(spark, str(folder), Ingestion())["enabled"] is False
    for _ in range(2):
        docs = [r["text"] for r in files.load_documents(spark, str(folder), c).orderBy("doc_idx").collect()]
        assert docs == ["one", "two", "E", "F", "<html>C", "B\nb", b"\xe9a\xf0\x9f\x98".decode("utf-8", "replace")]


def test_colliding_names(spark, folder):
    """Names that are taken already, by members of this archive, another of its name, or files on disk, are passed over."""
    (folder / "_extracted" / "a").mkdir()
    (folder / "_extracted" / "a" / "g.txt").write_text("on disk")
    (folder / "b").mkdir(exist_ok=True)
    _zip(folder / "a.zip", [("1/f.txt", "0"), ("2/f.txt", "1"), ("f_1.txt", "2"), ("g.txt", "3"), ("noext", "4"), ("x/noext", "5")])
    _zip(folder / "b" / "a.zip", [("f.txt", "6")])
    c = Ingestion(extract_zip=True)
    files.extract(spark, str(folder), c)
    got = sorted((r["content"].decode(), r["file_name"]) for r in files.extracted(spark, str(folder), c).collect())
    assert got == [("0", "f.txt"), ("1", "f_1.txt"), ("2", "f_1_1.txt"), ("3", "g_1.txt"), ("4", "noext"), ("5", "noext_1"), ("6", "f_2.txt")]
    _zip(folder / "a.zip", [("f.txt", "7")])
    files.extract(spark, str(folder), c)
    assert files.extracted(spark, str(folder), c).where("file_name = 'f_3.txt'").first()["content"] == b"7"
    texts = [r["text"] for r in files.load_documents(spark, str(folder), c).collect()]
    assert len(texts) == 5 + 1 + 6 and sorted(t for t in texts if len(t) == 1 and t.isdigit()) == ["0", "1", "2", "3", "6", "7"]


def test_archive_manifest_file(spark, folder, tmp_path):
    path = str(tmp_path / "m.json")
    files.save_archive_manifest(spark, {"a.zip": "00"}, path)
    assert [tuple(r) for r in files.load_archive_manifest(spark, path).collect()] == [("a.zip", "00")]
    (tmp_path / "bad.json").write_text("{")
    assert files.load_archive_manifest(spark, str(tmp_path / "bad.json")).count() == 0
    assert files.load_archive_manifest(spark, str(tmp_path / "none.json")).count() == 0


def test_markers_over_many_blocks(spark, tmp_path):
    """Pieces keep their places whatever the blocks that tasks read."""
    texts = [f"{i} " + "é\n" * (i * 37 % 101) + "x" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string").repartition(7)
    path = str(tmp_path / "c.txt")
    assert sinks.write_markers(docs, path) == 200
    assert open(path, encoding="utf-8", newline="").read() == "\n\n".join(f"<DOCUMENT_START>\n{t}\n<DOCUMENT_END>" for t in texts)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        parts = files.pieces(spark, path, files.START)
        assert parts.select("at").distinct().count() == 201
        assert [r["text"] for r in files.split_prepared(parts).orderBy("part_idx").collect()] == texts
        assert [r["text"] for r in files.split_raw(parts).orderBy("doc_idx").collect()] == texts
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    (tmp_path / "empty.txt").write_text("")
    assert files.raw_marker_file(spark, str(tmp_path / "empty.txt")).count() == 0
    assert sinks.write_markers(docs.limit(0), str(tmp_path / "none.txt")) == 0 and (tmp_path / "none.txt").read_text() == ""


def test_markers_are_written_in_order_from_many_tasks(spark, tmp_path):
    """Rows of a range come from many tasks, so only the sort within it puts them in order."""
    texts = [f"text {i:05d}" for i in range(4000)]
    docs = spark.createDataFrame([(i, texts[i]) for i in sorted(range(4000), key=lambda i: i * 7919 % 4001)], "doc_idx long, text string").repartition(8)
    sinks.write_markers(docs, str(tmp_path / "c.txt"))
    pieces = (tmp_path / "c.txt").read_text().split(files.START)[1:]
    assert [p.split("\n")[1] for p in pieces] == texts


def test_markers(spark, tmp_path):
    docs = spark.createDataFrame([(0, "DOC1"), (1, "DOC2")], "doc_idx long, text string")
    path = str(tmp_path / "out" / "c.txt")
    assert sinks.write_markers(docs, path) == 2
    assert open(path).read() == "<DOCUMENT_START>\nDOC1\n<DOCUMENT_END>\n\n<DOCUMENT_START>\nDOC2\n<DOCUMENT_END>"
    assert [(r["document_id"], r["text"]) for r in files.prepared_marker_file(spark, path).orderBy("part_idx").collect()] == [("doc_000001", "DOC1"), ("doc_000002", "DOC2")]
    assert [(r["document_id"], r["text"]) for r in files.raw_marker_file(spark, path).orderBy("doc_idx").collect()] == [("doc_000000", "DOC1"), ("doc_000001", "DOC2")]
    assert files.training_marker_file(spark, path).count() == 0
    assert files.training_marker_file(spark, path, 4).count() == 2


def test_metadata_lines(spark, tmp_path):
    rows = [{"document_id": "a", "status": "failed"}, {"status": "x"}, {"document_id": "a", "status": "success", "cleaned_length": 3}]
    p = tmp_path / "m.jsonl"
    p.write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = files.metadata_lines(spark, str(p)).collect()
    assert [(r["document_id"], r["status"], r["cleaned_length"]) for r in got] == [("a", "success", 3)]
    out = str(tmp_path / "o" / "x.jsonl")
    sinks.write_lines(files.metadata_lines(spark, str(p)).drop("line"), out, "document_id")
    assert json.loads(open(out).read()) == rows[2]


def test_native_sink(spark, tmp_path):
    docs = spark.createDataFrame([(0, "t", "train"), (1, "u", "test")], "doc_idx long, text string, split string")
    sinks.write_native(docs, str(tmp_path / "p"), split=True)
    back = spark.read.parquet(str(tmp_path / "p")).where("split = 'test'")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().executedPlan().toString()
    assert sinks.split_metadata(docs).first()["length"] == 1
    assert sinks.one_row(docs.limit(0)) == {}
