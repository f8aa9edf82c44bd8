import json
import shutil

from inkspan import cli
from inkspan.operators import checks
from inkspan.plans import stages
from inkspan.plans.config import Preparation
from inkspan.sources import files


def test_end_to_end(spark, tmp_path):
    src = tmp_path / "raw"
    src.mkdir()
    for i in range(12):
        (src / f"f{i:02d}.html").write_text(f"<p>Filing {i} of revenue &amp; income.</p>" + f" word{i} assets grow by {i}%" * 12)
    (src / "f99.html").write_text((src / "f03.html").read_text())
    raw, cleaned, prepared, tok = (str(tmp_path / x) for x in ("stage1/corpus.txt", "cleaned", "prepared", "tok"))
    assert cli.main(["ingest", "--input-dir", str(src), "--output", raw], spark) == 0
    assert cli.main(["ingest", "--input-dir", str(src), "--output", str(src / "x.txt")], spark) == 1
    assert cli.main(["clean", "--input-dir", str(tmp_path / "stage1"), "--output-dir", cleaned], spark) == 0
    report = json.loads((tmp_path / "cleaned/cleaning_report.json").read_text())
    assert report["statistics"]["documents_processed"] == 13 and report["statistics"]["duplicates_detected"] == 1
    v = checks.validate_corpus(spark, cleaned)
    assert v["is_valid"] and any("10-K" in w for w in v["warnings"])
    assert cli.main(["prepare", "--input-dir", cleaned, "--output-dir", prepared, "--split-strategy", "document"], spark) == 0
    found = json.loads((tmp_path / "prepared/split_manifest.json").read_text())
    assert sorted(found["train"] + found["validation"] + found["test"]) == [f"doc_{i:06d}" for i in range(12)] and len(found["train"]) == 9
    n = 12
    stats = json.loads((tmp_path / "prepared/corpus_statistics.json").read_text())
    assert stats["corpus_statistics"]["document_statistics"]["number_of_documents"] == n
    assert (tmp_path / "prepared/train.txt").read_text().count("<DOCUMENT_START>\n") == len(found["train"])
    assert cli.main(["train", "--input", f"{prepared}/train.txt", "--output", tok, "--vocab-size", "280"], spark) == 0
    meta = json.loads((tmp_path / "tok/training_metadata.json").read_text())
    assert meta["compression_ratio"] > 1 and len(meta["corpus_hash"]) == 64
    assert cli.main(["train", "--input", f"{prepared}/none.txt", "--output", tok], spark) == 1


def test_ids_survive_duplicates(spark, tmp_path):
    """Originals after a copy keep their ids and their own metadata, through the hand-over and through the exports alone."""
    bodies = [f"{i} " + "word " * (30 + i) for i in (0, 1, 1, 2, 3, 4)]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/corpus.txt").write_text("\n\n".join(f"<DOCUMENT_START>\n{b}\n<DOCUMENT_END>" for b in bodies))
    stages.clean_folder(spark, str(tmp_path / "raw"), str(tmp_path / "c"))
    want = [(f"doc_{i:06d}", bodies[i].strip(), len(bodies[i].strip())) for i in (0, 1, 3, 4, 5)]
    for _ in range(2):
        got = files.load_cleaned(spark, str(tmp_path / "c"))
        assert sorted((r["document_id"], r["text"], r["cleaned_length"]) for r in got.collect()) == want
        shutil.rmtree(tmp_path / "c" / files.HANDED_OVER, ignore_errors=True)
    r = stages.prepare(spark, str(tmp_path / "c"), str(tmp_path / "p"), Preparation("document"))
    assert r["validation"]["documents_loaded"] == 5 and r["warnings"] == [] and r["errors"] == []
    # records that say something else about lengths are named
    lines = [json.loads(x) for x in (tmp_path / "c/metadata.jsonl").read_text().splitlines()]
    lines[3]["cleaned_length"] = 5000
    (tmp_path / "c/metadata.jsonl").write_text("\n".join(map(json.dumps, lines)))
    r = stages.prepare(spark, str(tmp_path / "c"), str(tmp_path / "p"), Preparation("document"))
    assert len(r["warnings"]) == 1 and "doc_000003" in r["warnings"][0]


def test_remove_boundaries_and_temporal_fallback(spark, tmp_path):
    d = tmp_path / "c"
    d.mkdir()
    body = "x" * 120
    d.joinpath("corpus.txt").write_text("\n\n".join(f"<DOCUMENT_START>\n{i} {body}\n<DOCUMENT_END>" for i in range(5)) + "<DOCUMENT_START>no end")
    d.joinpath("metadata.jsonl").write_text('{"document_id": "doc_000002", "status": "failed"}\n')
    r = stages.prepare(spark, str(d), str(tmp_path / "o"), Preparation("temporal", boundary_mode="remove"))
    assert r["validation"]["documents_loaded"] == 4 and r["status"] == "success"
    assert "<DOCUMENT_START>" not in (tmp_path / "o/train.txt").read_text()
    got = stages.train(spark, str(tmp_path / "o/train.txt"), str(tmp_path / "t"))
    assert got["statistics"]["num_documents"] == 0 and got["statistics"]["compression_ratio"] == 0.0


def test_validation_of_broken_folders(spark, tmp_path):
    assert len(checks.validate_corpus(spark, str(tmp_path))["errors"]) == 3
    (tmp_path / "corpus.txt").write_bytes(b"<DOCUMENT_START>\nshort\xff\n")
    (tmp_path / "metadata.jsonl").write_text("")
    (tmp_path / "cleaning_report.json").write_text("{}")
    r = checks.validate_corpus(spark, str(tmp_path))
    assert not r["is_valid"] and len(r["errors"]) == 3 + 6
