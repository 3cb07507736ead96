"""Whole-word tokens: maximal runs of ASCII letters and digits, case-sensitive."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+"


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def distinct_tokens(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def has_token(text: Column | str, token: str, null: bool = False) -> Column:
    """Whether token is one of the text's tokens. What isn't a token itself (empty, or with a separator) never is. null: null for a null text, which a filter takes as false and can push to the scan."""
    if not re.fullmatch(TOKEN, token):
        return F.lit(False)
    text = F.col(text) if isinstance(text, str) else text
    # a substring test first: it settles most rows without a regular expression
    found = text.contains(token) & text.rlike(f"(?<![A-Za-z0-9]){token}(?![A-Za-z0-9])")
    return found if null else F.coalesce(found, F.lit(False))


def register(spark: SparkSession) -> None:
    """SQL functions log_tokens(s) and has_token(s, t)."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION log_tokens(s STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(s, '{TOKEN}', 0)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION has_token(s STRING, t STRING) RETURNS BOOLEAN RETURN coalesce(array_contains(regexp_extract_all(s, '{TOKEN}', 0), t), false)")
