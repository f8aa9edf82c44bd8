"""Decoding that Spark has no function for: HTML entities and Unicode composition, in one Arrow pass."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

_SCHEMA = "text string, error string"


def _decode(text: str | None) -> tuple[str | None, str | None]:
    if not text:
        return text, None
    try:
        return unicodedata.normalize("NFC", html.unescape(text)), None
    except Exception as e:  # a document that can't be decoded fails alone
        return "", str(e)


def decode_struct(c: Column) -> Column:
    """STRUCT<text, error>: entities decoded once, then NFC; a failure leaves an empty text and its message."""

    @F.pandas_udf(_SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_decode(t) for t in texts], columns=["text", "error"], index=texts.index)

    return run(c)


def entities(c: Column) -> Column:
    return decode_struct(c)["text"]
