"""Typed reads of schemaless payloads. A value of the wrong JSON type is null, never coerced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def kind_at(value: Column, path: str) -> Column:
    """Variant type name at a path; null when absent, `VOID` for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def raw_text(value: Column, path: str) -> Column:
    """A JSON string, empty ones included."""
    return F.when(kind_at(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def text(value: Column, path: str) -> Column:
    """A non-empty JSON string."""
    return F.nullif(raw_text(value, path), F.lit(""))


def number(value: Column, path: str) -> Column:
    """A JSON number as double."""
    return F.when(kind_at(value, path).rlike(_NUMERIC), F.try_variant_get(value, path, "double"))


def is_object(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "map<string,variant>").isNotNull()


def is_array(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "array<variant>").isNotNull()


def open_payload(payload: Column) -> Column:
    """Payload text as VARIANT: blank becomes `{}`, unparseable text `{"raw": text}`."""
    wrapped = F.parse_json(F.to_json(F.struct(payload.alias("raw"))))
    blank = payload.isNull() | (payload == "")
    return F.when(blank, F.parse_json(F.lit("{}"))).otherwise(
        F.coalesce(F.try_parse_json(payload), wrapped)
    )
