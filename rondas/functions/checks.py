"""Checks that ride along in a query instead of costing a job of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fail_when(condition: Column, message: str, value: Column) -> Column:
    """``value``; a row that meets ``condition`` fails the query with ``message``."""
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def mapped(key: Column, value: Column, what: str, strict: bool) -> Column:
    """Result of a lookup join. Strict: a key without a value is an error, a null key is not."""
    if not strict:
        return value
    return fail_when(key.isNotNull() & value.isNull(), f"no {what} for a key", value)
