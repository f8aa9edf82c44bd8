"""The corpus pipeline: from ``documents`` to packed training batches.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir), works on all of ``docs`` and returns a frame
that is written as Parquet and read again as the next one's docs. All but the last return the columns of documents:

1. language: texts without a language (no letter, or less like any than its labelled texts are) go; a missing ``lang`` is filled by the prediction.
2. near_copies: of each class of documents that links of Jaccard similarity 0.8 connect, the one with the least id stays.
3. repeated_passages: words under windows of 35 words that start elsewhere too are cut; what is left empty by that goes.
4. mixture: documents are sampled by probabilities raked to targets of source, language and topic.
5. packing: batches of a padded token budget within optimal length buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkspan import reach_workers, small_batches
from inkspan.llm import jaccard_join, language_id, mixing, packing, substring_dedup
from inkspan.operators import durable


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns but ``used`` under names that no operator writes, and these names in order; see :func:`back`."""
    held = [c if c in used else f"__column_{i}" for i, c in enumerate(docs.columns)]
    return docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(docs.columns, held, strict=True)]), held


def back(found: DataFrame, held: list[str], columns: list[str]) -> DataFrame:
    """The columns that were set aside, under their own names again; what operators added goes."""
    return found.select(*[F.col(f"`{h}`").alias(c) for c, h in zip(columns, held, strict=True)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and letterless texts go, and texts unlike every learned language; all others stay, row by row, whatever
    their id or how often they repeat. Without any label nothing can be learned, so nothing stays. All columns keep their values,
    but a null lang is filled. An empty table gives an empty one."""
    reach_workers(spark)
    small_batches(spark)
    own, held = aside(docs, "doc_id", "text", "lang")
    prototypes = language_id.learn(own)
    found = language_id.identify(own, prototypes, least=language_id.limits(own, prototypes), known="__known")
    kept = found.where((F.col("lang_pred") != "und") & F.col("__known"))
    return back(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), held, docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, as it was: that of the least id (null last), then of the least hash of its text; of rows
    that repeat both, one. Null and wordless texts are like nothing and stay. An empty table gives an empty one."""
    reach_workers(spark)
    small_batches(spark)
    own, held = aside(docs, "doc_id", "text")
    return back(jaccard_join.keep_one(own, jaccard_join.jaccard_join(own)), held, docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that lose no word stay as they are, null and empty texts too; others get their other words, joined by spaces, as
    text and its length as n_chars (if there is such a column); those that lose all words go. Rows that repeat an id or a text
    are documents of their own. An empty table gives an empty one."""
    reach_workers(spark)
    small_batches(spark)
    own, held = aside(docs, "doc_id", "text", "n_chars")
    found = substring_dedup.substring_dedup(own)
    cut = F.col("n_removed") > 0
    kept = found.where(~(cut & (F.col("n_removed") == F.col("n_words"))))
    out = kept.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return back(out, held, docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the rows, each as it was. Null sources and languages are the category ''; null texts have no tokens and go by
    their cell; rows that share an id share their fate within a cell. An empty table gives an empty one."""
    own, held = aside(docs, "doc_id", "text", "source", "lang")
    return back(mixing.mix(own).where("keep"), held, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a document, with batch and slot; null and empty texts have no tokens; null ids come first among equal lengths. An
    empty table gives an empty one."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", pack)]
#: Language identification has no SQL form; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next; what a stage leaves behind but its result is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), durable.written()
    for _, stage in STAGES:
        docs = durable.durable(stage(spark, docs, sf_dir))
        durable.forget(spark, since=before, but=1)
    return docs
