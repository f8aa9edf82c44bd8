"""Validation of cleaned corpora and of tokenizer files.

Corpus checks are aggregates over the pieces of the marker file. A fault that would stop a check (a missing file, malformed
UTF-8, a missing field) is reported as an error; the piece before the first marker is no document.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from inkspan.sources.files import END, START

# What a corpus is expected to hold, and what a cleaning report must have.
EXPECTED = ("%", "$", "ITEM", "PART", "10-K", "10-Q")
REPORT_FIELDS = ("statistics", "failed_documents", "duplicate_info")
REPORT_STATISTICS = ("documents_processed", "documents_cleaned", "documents_failed")
SHORT = 10


def corpus_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row over documents: how many, how many short ones, and for each expected pattern whether it occurs."""
    t = F.coalesce(F.col(text), F.lit(""))
    length = F.length(F.regexp_replace(t, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
    has = [F.coalesce(F.bool_or(F.contains(t, F.lit(p))), F.lit(False)).alias(f"has_{i}") for i, p in enumerate(EXPECTED)]
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(length < SHORT).alias("short_documents"), *has)


def boundary_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: numbers of both markers in a file, and whether it is UTF-8."""
    from inkspan.sources.files import pieces

    parts = pieces(spark, path, START)
    t = F.make_valid_utf8("p")
    ends = F.coalesce(F.sum(((F.length(t) - F.length(F.replace(t, F.lit(END), F.lit("")))) / len(END)).cast("long")), F.lit(0))
    return parts.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("starts"), ends.alias("ends"), F.coalesce(F.bool_and(F.is_valid_utf8("p")), F.lit(True)).alias("is_utf8"))


def validate_corpus(spark: SparkSession, folder: str) -> dict:
    """Check corpus.txt, metadata.jsonl and cleaning_report.json in a folder: {is_valid, errors, warnings}."""
    from inkspan.sources.files import metadata_lines, prepared_marker_file

    root, errors, warnings = Path(folder), [], []
    names = {"corpus.txt": "Corpus file", "metadata.jsonl": "Metadata file", "cleaning_report.json": "Cleaning report"}
    there = {n: (root / n).exists() for n in names}
    errors += [f"{what} is missing: {root / n}" for n, what in names.items() if not there[n]]
    if there["corpus.txt"]:
        b = boundary_counts(spark, str(root / "corpus.txt")).first()
        if not b["starts"]:
            errors.append(f"the corpus has no {START}")
        if not b["ends"]:
            errors.append(f"the corpus has no {END}")
        if b["starts"] != b["ends"]:
            errors.append(f"{b['starts']} documents begin, but {b['ends']} end")
        if not b["is_utf8"]:
            errors.append("the corpus is not UTF-8")
        f = corpus_facts(prepared_marker_file(spark, str(root / "corpus.txt"))).first()
        if f["short_documents"]:
            warnings.append(f"{f['short_documents']} documents have fewer than {SHORT} characters")
        warnings += [f"no document holds {p}" for i, p in enumerate(EXPECTED) if not f[f"has_{i}"]]
        if there["metadata.jsonl"] and (n := metadata_lines(spark, str(root / "metadata.jsonl")).count()) != b["starts"]:
            warnings.append(f"{n} metadata records for {b['starts']} documents")
    if there["cleaning_report.json"]:
        try:
            report = json.loads((root / "cleaning_report.json").read_text(encoding="utf-8"))
            errors += [f"the cleaning report lacks {x}" for x in REPORT_FIELDS if x not in report]
            errors += [f"the cleaning report lacks the statistic {x}" for x in REPORT_STATISTICS if x not in report.get("statistics", {})]
        except ValueError as e:
            errors.append(f"the cleaning report is no JSON: {e}")
    return {"is_valid": not errors, "errors": errors, "warnings": warnings}


def validate_documents(docs: DataFrame, text: str = "text", least: int = 100) -> DataFrame:
    """One row over prepared documents: loaded, valid, skipped (short), failed, and length_mismatches (by more than 100)."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    failed = F.coalesce(F.col("status"), F.lit("")) == "failed" if "status" in docs.columns else F.lit(False)
    off = F.abs(F.col("cleaned_length") - n) > 100 if "cleaned_length" in docs.columns else F.lit(False)
    return docs.agg(F.count(F.lit(1)).alias("documents_loaded"), F.count_if(~failed & (n >= least)).alias("documents_valid"), F.count_if(~failed & (n < least)).alias("documents_skipped"), F.count_if(failed).alias("documents_failed"), F.count_if(F.coalesce(off, F.lit(False))).alias("length_mismatches"))


def length_mismatches(docs: DataFrame, text: str = "text", doc_id: str = "document_id") -> DataFrame:
    """(message) for each document whose cleaned_length is off by more than 100 characters."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    known = F.col("cleaned_length") if "cleaned_length" in docs.columns else F.lit(None).cast("long")
    return docs.where(F.abs(known - n) > 100).select(F.format_string("document %s has %d characters, its metadata say %d", F.col(doc_id).cast("string"), n, known).alias("message"))


def vocabulary_gaps(vocab: DataFrame) -> DataFrame:
    """Ids after which the next is missing. A vocabulary is small by construction, so one ordered window over it is fine."""
    return vocab.select("id", F.lead("id").over(W.orderBy("id")).alias("next")).where("next is not null and next <> id + 1").select("id")


def dangling_merges(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """(rank, side, id) of references to tokens that don't exist."""
    long = merges.selectExpr("rank", "stack(3, 'left', left, 'right', right, 'new', new_token_id) as (side, id)")
    return long.join(vocab.select("id"), "id", "left_anti").select("rank", "side", "id")


def validate_tokenizer(folder: str) -> dict:
    """Check the four files of a saved tokenizer: {is_valid, errors, warnings}. All of it is bounded by the vocabulary."""
    root, errors, warnings = Path(folder), [], []
    names = ("vocab.json", "merges.json", "config.json", "tokenizer.json")
    errors += [f"{n} is missing" for n in names if not (root / n).exists()]
    found: dict = {}
    for n in names[:3]:
        if (root / n).exists():
            try:
                found[n] = json.loads((root / n).read_text(encoding="utf-8"))
            except ValueError as e:
                errors.append(f"{n} is no JSON: {e}")
    config, vocab, merges = found.get("config.json"), found.get("vocab.json"), found.get("merges.json")
    if config is not None:
        errors += [f"the configuration lacks {f}" for f in ("vocab_size", "min_frequency", "special_tokens", "algorithm") if f not in config]
        if config.get("algorithm") != "byte_level_bpe":
            errors.append(f"unknown algorithm {config.get('algorithm')}")
        if config.get("vocab_size", 0) < 256:
            errors.append(f"a vocabulary of {config.get('vocab_size')} can't hold all bytes")
        if not isinstance(config.get("special_tokens"), list):
            errors.append("the configuration's special tokens are no list")
    ids: set[int] = set()
    if vocab is not None:
        ids = {int(i) for i in vocab}
        order = sorted(ids)
        warnings += [f"ids are missing after {a}" for a, b in zip(order, order[1:], strict=False) if b != a + 1]
        for i, t in vocab.items():
            errors += [f"token {i} lacks {f}" for f in ("bytes", "type") if f not in t]
            if "type" in t and t["type"] not in ("special", "byte", "bpe"):
                errors.append(f"token {i} is of unknown type {t['type']}")
            if "bytes" in t and not re.fullmatch(r"([0-9a-fA-F]{2})*", str(t["bytes"])):
                errors.append(f"the bytes of token {i} are no hexadecimal: {t['bytes']}")
    if merges is not None:
        ranks = [m.get("rank") for m in merges]
        if len(set(ranks)) < len(ranks):
            errors.append("two merges share a rank")
        if None not in ranks and ranks != sorted(ranks):
            errors.append("ranks don't ascend")
        for i, m in enumerate(merges):
            errors += [f"merge {i} lacks {f}" for f in ("rank", "left", "right", "new_token_id", "frequency") if f not in m]
            if m.get("rank") != i:
                errors.append(f"merge {i} says rank {m.get('rank')}")
            if m.get("frequency", 0) < 0:
                errors.append(f"the frequency of merge {i} is below 0")
    if config is not None and vocab is not None and merges is not None:
        if len(vocab) != config.get("vocab_size"):
            # training that stops early, or reuses an id, ends below the target; the tokenizer is sound
            warnings.append(f"{len(vocab)} tokens where {config.get('vocab_size')} were asked for")
        specials = sum(t.get("type") == "special" for t in vocab.values())
        if specials != len(config.get("special_tokens") or []):
            errors.append(f"{specials} special tokens in the vocabulary, {len(config.get('special_tokens') or [])} in the configuration")
        for m in merges:
            errors += [f"the {side} token {m.get(f)} of a merge doesn't exist" for side, f in (("left", "left"), ("right", "right"), ("new", "new_token_id")) if f in m and m[f] not in ids]
    return {"is_valid": not errors, "errors": errors, "warnings": warnings}
