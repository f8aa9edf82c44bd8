"""Cleaning on a stream: the same stateless projections over ``readStream`` sources, and dedup bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkspan.functions import text as T
from inkspan.operators.cleaning import clean


def clean_stream(docs: DataFrame, text: str = "text", doc_id: str = "document_id") -> DataFrame:
    return clean(docs, text, doc_id)


def first_copies(docs: DataFrame, time: str, delay: str = "1 hour", text: str = "text") -> DataFrame:
    """Of equal normalised texts, the first to arrive; state older than ``delay`` is forgotten."""
    hashed = docs.withColumn("content_hash", T.dedup_hash(F.col(text)))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])
