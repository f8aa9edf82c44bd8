"""The four stages from files to a tokenizer, as driver functions over DataFrames."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkspan.operators import bpe, checks, cleaning, profile, splits
from inkspan.operators.codec import Tokenizer
from inkspan.operators.durable import durable
from inkspan.sources import files, sinks

from . import config as K

#: Documents that a report names one by one; it counts the others.
REPORTED = 100


def ingest(spark: SparkSession, folder: str, output: str, config: K.Ingestion | None = None) -> int:
    """Stage 1: documents of a folder to one marker file outside it. Returns how many."""
    inside, outside = files._qualified(spark, folder) + "/", files._qualified(spark, output)
    if outside.startswith(inside):
        raise ValueError("the output must not lie in the input folder, where the next run would take it for a document")
    return sinks.write_markers(durable(files.load_documents(spark, folder, config)), output)


def cleaned(docs: DataFrame) -> DataFrame:
    """Stage 2 as a frame: (doc_idx, document_id, text) to cleaned and marked documents."""
    return cleaning.mark_duplicates(durable(cleaning.clean(docs)))


def clean_folder(spark: SparkSession, source: str, output: str) -> dict:
    """Stage 2: ``source``/corpus.txt to documents.parquet, which stage 3 reads, and its exports corpus.txt, metadata.jsonl and
    cleaning_report.json. Returns the statistics."""
    found = durable(cleaned(files.raw_marker_file(spark, f"{source}/corpus.txt")))
    ok = found.where("status = 'success'")
    sinks.write_native(ok.drop("content_hash"), f"{output}/{files.HANDED_OVER}")
    sinks.write_markers(ok.where(~F.col("is_duplicate")), f"{output}/corpus.txt")
    sinks.write_lines(ok.drop("text", "content_hash"), f"{output}/metadata.jsonl", "doc_idx")
    report = sinks.one_row(cleaning.cleaning_report(found))
    failed = [r.asDict() for r in found.where("status = 'failed'").select("document_id", "errors").toLocalIterator()]
    sinks.write_json(spark, {"statistics": report, "failed_documents": failed, "duplicate_info": sinks.one_row(cleaning.dedup_statistics(ok))}, f"{output}/cleaning_report.json")
    return report


def statistics(docs: DataFrame, ticker: str | None = None) -> dict:
    """All statistics of a corpus; top lists break ties by first occurrence."""
    docs = docs if ticker else docs.withColumn("ticker", F.lit(None).cast("string"))
    ticker = ticker or "ticker"
    chars = durable(profile.characters(docs, order="doc_idx"))
    by = durable(profile.byte_values(docs))
    firsts = docs.groupBy(F.coalesce(F.col(ticker), F.lit("UNKNOWN")).alias("ticker")).agg(F.count(F.lit(1)).alias("frequency"), F.min("doc_idx").alias("first_seen"))
    total_chars, total_bytes = (x.agg(F.coalesce(F.sum("frequency"), F.lit(0))).first()[0] for x in (chars, by))
    top = profile.most_common(chars, 100).collect()
    top_bytes = by.orderBy(F.desc("frequency"), "byte").limit(100).collect()
    named = [tuple(r)[:2] for r in profile.most_common(firsts, 20).collect()]
    found = [tuple(r) for r in profile.vocabulary_candidates(chars).collect()]
    companies = sinks.one_row(profile.company_statistics(docs, ticker))
    kinds = lambda k: sorted(c for x, c in found if x == k)
    # The names of all keys
    return {
        "document_statistics": {"number_of_documents": docs.count(), "number_of_companies": companies["total_companies"], "number_of_filings_per_company": dict(named[:10])},
        "character_statistics": {"total_characters": total_chars, "unique_characters": chars.count(), "character_frequency": {r["character"]: r["frequency"] for r in top}, "character_frequency_percentage": {r["character"]: r["frequency"] / total_chars * 100 for r in top}},
        "byte_statistics": {"total_bytes": total_bytes, "unique_bytes": by.count(), "byte_frequency": {r["byte"]: r["frequency"] for r in top_bytes}, "byte_frequency_percentage": {r["byte"]: r["frequency"] / total_bytes * 100 for r in top_bytes}},
        "document_length_statistics": sinks.one_row(profile.length_statistics(docs)),
        "financial_pattern_statistics": {r["pattern"]: r["n"] for r in profile.pattern_counts(docs).collect()},
        "company_statistics": {"total_companies": companies["total_companies"], "companies_with_multiple_filings": companies["companies_with_multiple_filings"], "top_companies_by_filing_count": dict(named)},
        "vocabulary_candidates": {"unique_characters": chars.count(), "unique_bytes": by.count(), "unique_whitespace_patterns": len(kinds("whitespace")), "whitespace_patterns": kinds("whitespace"), "common_punctuation": kinds("punctuation"), "numeric_characters": kinds("numeric")},
    }


def prepare(spark: SparkSession, source: str, output: str, config: K.Preparation | None = None) -> dict:
    """Stage 3: a cleaned folder to split texts, metadata, statistics, manifest and report. Returns the report."""
    config = config or K.Preparation()
    docs = durable(files.load_cleaned(spark, source, config.min_document_length))
    if config.max_document_length:
        docs = docs.where(F.length("text") <= config.max_document_length)
    validation = sinks.one_row(checks.validate_documents(docs, least=config.min_document_length))
    placed = durable(splits.split(docs, config))
    leak = sinks.one_row(splits.leakage(placed, ticker="ticker" if config.split_strategy == "company" else None))
    found = statistics(placed, "ticker")
    per_split = {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in profile.split_statistics(placed).collect()}
    sinks.write_splits(placed, output, config.boundary_mode)
    sinks.write_lines(sinks.split_metadata(placed), f"{output}/metadata.jsonl", "doc_idx")
    sinks.write_json(spark, {"corpus_statistics": found, "split_statistics": per_split}, f"{output}/corpus_statistics.json")
    sinks.write_manifest(placed, config, f"{output}/split_manifest.json", "ticker")
    warnings = [r[0] for r in checks.length_mismatches(docs).limit(REPORTED).collect()]
    if validation["length_mismatches"] > REPORTED:
        warnings.append(f"{validation['length_mismatches'] - REPORTED} more documents whose length is not that of their metadata")
    warnings += [f"{n} {what} are in two splits" for what, n in leak.items() if what != "has_leakage" and n]
    errors = [f"{n} documents are empty or have no id" for n in [docs.where("document_id is null or document_id = '' or text = ''").count()] if n]
    summary = {"total_documents": found["document_statistics"]["number_of_documents"], "total_companies": found["document_statistics"]["number_of_companies"], "total_characters": found["character_statistics"]["total_characters"], "total_bytes": found["byte_statistics"]["total_bytes"], "unique_characters": found["character_statistics"]["unique_characters"]}
    report = {"stage": 3, "status": "failed" if leak["has_leakage"] else "success", "configuration": asdict(config), "input": {"input_dir": str(source)} | validation, "validation": validation, "splits": {s: per_split.get(s, {}) for s in K.SPLITS}, "leakage_check": leak, "corpus_summary": summary, "warnings": warnings, "errors": errors}
    sinks.write_json(spark, report, f"{output}/preparation_report.json")
    return report


def train(spark: SparkSession, corpus: str, output: str, config: K.Tokenizer | None = None) -> dict:
    """Stage 4: a marker file to tokenizer files; validates them and a round trip. Returns statistics and validation."""
    config = config or K.Tokenizer()
    parts = files.pieces(spark, corpus, files.START)
    docs = durable(files.long_enough(files.split_prepared(parts)))
    got = bpe.train(docs, config)
    # of the whole file, markers and short documents included
    characters, n = parts.agg(F.coalesce(F.sum(F.length(F.make_valid_utf8("p"))), F.lit(0)), F.count(F.lit(1))).first()
    size = files.size_of(spark, corpus)
    got.statistics |= {"training_corpus_bytes": size, "training_corpus_characters": characters + max(0, n - 1) * len(files.START)}
    final = got.statistics["final_token_count"]
    got.statistics["average_bytes_per_token"] = size / final if final else 0.0
    tok = Tokenizer.of(got, config)
    tok.save(output)
    tok.save_training(output, corpus, got.statistics)
    wrong = docs.select("text", tok.decode(tok.encode(F.col("text"))).alias("back")).where("text <> back").count()
    return {"statistics": got.statistics, "validation": checks.validate_tokenizer(output), "round_trip_failures": wrong}
