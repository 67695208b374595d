"""Metadata that is JSON, or should be: read as VARIANT, whatever it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_object(text: Column) -> Column:
    """Whether a text is a JSON object; false for null."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT")), F.lit(False))


def parsed(text: Column) -> Column:
    """A JSON object as VARIANT; null for what is cut off, no object or missing."""
    return F.when(is_object(text), F.try_parse_json(text))


def with_fields(rows: DataFrame, column: str, **fields: str) -> DataFrame:
    """``rows`` with a column for each of these fields, of the type given; null
    where it is missing or of another kind."""
    value = parsed(F.col(column))
    return rows.select("*", *[F.try_variant_get(value, f"$.{name}", kind).alias(name) for name, kind in fields.items()])
