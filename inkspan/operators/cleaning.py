"""The cleaning pipeline over documents, exact dedup, and its report.

One scan and one Arrow pass clean a document, and the result is written once. Dedup exchanges (hash, position, id) and no
text: originals come from a minimum per hash that is partly aggregated first, so a text with millions of copies makes one row a
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkspan.functions import text as T
from inkspan.functions.decode import decode_struct

from .durable import durable, running_totals

# The names of the steps, in order.
STEPS = ("encoding_normalization", "table_extraction", "html_cleaning", "xbrl_cleaning", "structure_preservation", "whitespace_normalization", "artifact_removal")


def clean(docs: DataFrame, text: str = "text", doc_id: str = "document_id") -> DataFrame:
    """(id, text, original_length, table_count, html_elements_removed, xbrl_elements_removed, cleaned_length, status,
    steps_completed, errors) and all other columns. Counts are each document's own. Step columns are kept apart, so that
    counts and replacements share their inputs."""
    rest = [c for c in docs.columns if c not in (text,)]
    d = docs.withColumn("__raw", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("__d", decode_struct(F.col("__raw")))
    d = d.withColumn("__t0", T.special_characters(F.col("__d.text")))
    d = d.withColumns({"__t1": T.serialise_tables(F.col("__t0")), "table_count": T.count_tables(F.col("__t0"))})
    counts: list[Column] = []
    last = "__t1"
    for i, pattern in enumerate(T.HTML_STEPS):
        name = f"__h{i}"
        d = d.withColumns({f"__n{i}": F.regexp_count(F.col(last), F.lit(pattern)), name: T.strip_markup(F.col(last), (pattern,))})
        counts.append(F.col(f"__n{i}"))
        last = name
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    d = d.withColumns({"html_elements_removed": total.cast("long"), "xbrl_elements_removed": T.count_xbrl(F.col(last)), "__t2": T.strip_xbrl(F.col(last))})
    d = d.withColumn("__t3", T.artifacts(T.whitespace(T.headings(F.col("__t2")))))
    failed = F.col("__d.error").isNotNull()
    d = d.select(
        *[F.col(c) for c in rest if c not in ("table_count", "html_elements_removed", "xbrl_elements_removed")],
        F.when(failed, "").otherwise(F.col("__t3")).alias(text),
        F.length("__raw").cast("long").alias("original_length"),
        *[F.when(~failed, F.col(c)).alias(c) for c in ("table_count", "html_elements_removed", "xbrl_elements_removed")],
        F.when(~failed, F.length("__t3")).cast("long").alias("cleaned_length"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(s) for s in STEPS])).alias("steps_completed"),
        F.when(failed, F.array(F.col("__d.error"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )
    return d


def mark_duplicates(docs: DataFrame, text: str = "text", order: str = "doc_idx", doc_id: str = "document_id") -> DataFrame:
    """Adds content_hash, is_duplicate and duplicate_of: of equal normalised texts, the first in ``order`` is the original.

    ``docs`` is written with its hashes once, so what makes it runs once; :func:`mark_hashed` does the rest.
    """
    return mark_hashed(durable(docs.withColumn("content_hash", T.dedup_hash(F.col(text)))), order, doc_id)


def mark_hashed(hashed: DataFrame, order: str = "doc_idx", doc_id: str = "document_id") -> DataFrame:
    """The same for a table that has its content_hash. Only (hash, order, id) is exchanged; the originals are a minimum by hash
    that is partly aggregated first, so no copy group is gathered. The copies alone are written and joined back, by broadcast
    where that table's size allows it."""
    narrow = hashed.select("content_hash", F.col(order).alias("__o"), F.col(doc_id).alias("__id")).where("content_hash is not null")  # a null text is nobody's copy
    first = narrow.groupBy("content_hash").agg(F.min(F.struct("__o", "__id")).alias("__first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # dealt anew, so the join has an exchange of its own on both sides, which adaptive execution can split at a hot hash
    copies = durable(narrow.join(first.hint("rebalance"), "content_hash").where("__o <> __first.__o").select("content_hash", F.col("__o").alias(order), F.col("__first.__id").alias("duplicate_of")).distinct())
    joined = hashed.join(copies, ["content_hash", order], "left")
    return joined.select(*hashed.columns, F.col("duplicate_of").isNotNull().alias("is_duplicate"), "duplicate_of")


def running_counts(docs: DataFrame, order: str = "doc_idx") -> DataFrame:
    """The three counters as running totals in document order, the way a stateful cleaner reports them, by prefix sums of
    partition totals over three numbers a document. All columns but those narrow ones are left out."""
    counters = ("table_count", "html_elements_removed", "xbrl_elements_removed")
    out = durable(docs.select(order, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counters]))
    for c in counters:
        held = running_totals(out, [order], c, held=True).withColumn(c, F.col("before_size") + F.col(c))
        out = durable(held.drop("before_rows", "before_size", "all_size"))
    return out


def dedup_statistics(docs: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return docs.agg(n.alias("total_documents"), F.count_if(~F.col("is_duplicate")).alias("unique_documents"), F.count_if("is_duplicate").alias("duplicate_documents"))


def cleaning_report(docs: DataFrame) -> DataFrame:
    """One row of totals over cleaned, marked documents."""
    return docs.agg(
        F.count(F.lit(1)).alias("documents_processed"),
        F.count_if(F.col("status") == "success").alias("documents_cleaned"),
        F.count_if(F.col("status") == "failed").alias("documents_failed"),
        F.count_if((F.col("status") == "success") & F.col("is_duplicate")).alias("duplicates_detected"),
        F.coalesce(F.sum("original_length"), F.lit(0)).alias("total_raw_characters"),
        F.coalesce(F.sum("cleaned_length"), F.lit(0)).alias("total_cleaned_characters"),
        F.coalesce(F.sum("html_elements_removed"), F.lit(0)).alias("html_elements_removed"),
        F.coalesce(F.sum("xbrl_elements_removed"), F.lit(0)).alias("xbrl_elements_removed"),
        F.coalesce(F.sum("table_count"), F.lit(0)).alias("table_count"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("encoding_issues"),
    )
