"""Strict parsing of extraction and screening responses (response_id, body, wall_ms).

A response that does not say something plainly gets an error code, never a guessed value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import jsonval, vocab

DATA = "$.result.data"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _label(p: Column, path: str) -> Column:
    return F.when(jsonval.is_object(p, path), jsonval.raw_text(p, f"{path}.label")).otherwise(
        jsonval.raw_text(p, path)
    )


def _confidence(p: Column, path: str) -> Column:
    """A number, or text that is one; 0 only where the field is absent, null where it can't be read."""
    at = f"{path}.confidence"
    text = F.trim(jsonval.raw_text(p, at))
    read = F.coalesce(jsonval.number(p, at), F.when(text.rlike(NUMBER), text.try_cast("double")))
    return F.when(jsonval.kind_at(p, at).isNull(), F.lit(0.0)).otherwise(read)


def _blank(p: Column, path: str) -> Column:
    """An empty value of any kind: null, empty text, list or object, false or zero."""
    kind = jsonval.kind_at(p, path)
    return (
        (kind == "VOID")
        | (kind == "STRING") & (F.try_variant_get(p, path, "string") == "")
        | (kind == "BOOLEAN") & ~F.try_variant_get(p, path, "boolean")
        | F.coalesce(jsonval.number(p, path) == 0, F.lit(False))
        | F.coalesce(F.size(F.try_variant_get(p, path, "array<variant>")) == 0, F.lit(False))
        | F.coalesce(F.size(F.map_keys(F.try_variant_get(p, path, "map<string,variant>"))) == 0, F.lit(False))
    )


def latency_pref(p: Column, wall_ms: Column) -> Column:
    """The latency the server reports, else the measured wall clock."""
    return F.coalesce(jsonval.number(p, "$.latency_ms"), wall_ms)


def parse_extraction(responses: DataFrame) -> DataFrame:
    """Severity, services and confidence, or `error`: shape, severity, label, confidence, entities, span."""
    p = F.col("p")
    severity, entity = f"{DATA}.severity", f"{DATA}.entities.{vocab.SERVICE_ENTITY}"
    items = F.try_variant_get(p, entity, "array<variant>")
    names = F.transform(
        items,
        lambda item: F.when(jsonval.is_object(item), jsonval.raw_text(item, "$.text")).otherwise(
            jsonval.raw_text(item, "$")
        ),
    )
    read = responses.withColumn("p", F.try_parse_json("body")).select(
        "response_id",
        jsonval.is_object(p).alias("object"),
        (jsonval.is_object(p, DATA) & jsonval.kind_at(p, severity).isNotNull()).alias("rated"),
        _label(p, severity).alias("severity"),
        _confidence(p, severity).alias("confidence"),
        jsonval.kind_at(p, entity).alias("kind"),
        _blank(p, entity).alias("blank"),
        names.alias("names"),
        latency_pref(p, F.col("wall_ms")).alias("latency_ms"),
    )
    services = F.when(F.col("blank"), F.array().cast("array<string>")).otherwise(F.col("names"))
    unread = services.isNull() | F.exists(services, lambda name: name.isNull())
    error = (
        F.when(~F.col("object"), "shape")
        .when(~F.coalesce(F.col("rated"), F.lit(False)), "severity")
        .when(~F.coalesce(F.col("severity").isin(*vocab.SEVERITIES), F.lit(False)), "label")
        .when(F.col("confidence").isNull(), "confidence")
        .when(F.col("kind").isNull(), "entities")
        .when(unread, "span")
    )
    judged = read.withColumn("services", services).withColumn("error", error)
    fine = F.col("error").isNull()
    return judged.select(
        "response_id",
        F.when(fine, F.col("severity")).alias("severity"),
        F.when(fine, F.col("services")).alias("affected_services"),
        F.when(fine, F.col("confidence")).alias("confidence"),
        F.when(fine, F.col("latency_ms")).alias("latency_ms"),
        "error",
    )


def parse_screen(responses: DataFrame) -> DataFrame:
    """Allowed flag, categories and confidence, or `error`: shape, task, label, confidence."""
    p = F.col("p")
    task = f"{DATA}.{vocab.SAFETY_TASK}"
    read = responses.withColumn("p", F.try_parse_json("body")).select(
        "response_id",
        jsonval.is_object(p).alias("object"),
        jsonval.kind_at(p, task).isNotNull().alias("has_task"),
        _label(p, task).alias("label"),
        _confidence(p, task).alias("confidence"),
        latency_pref(p, F.col("wall_ms")).alias("latency_ms"),
    )
    error = (
        F.when(~F.col("object"), "shape")
        .when(~F.col("has_task"), "task")
        .when(~F.coalesce(F.col("label").isin(*vocab.SAFETY_LABELS), F.lit(False)), "label")
        .when(F.col("confidence").isNull(), "confidence")
    )
    judged = read.withColumn("error", error)
    fine = F.col("error").isNull()
    allowed = F.col("label") == vocab.SAFETY_LABELS[0]
    flagged = F.when(allowed, F.array().cast("array<string>")).otherwise(F.array(F.lit(vocab.SAFETY_TASK)))
    return judged.select(
        "response_id",
        F.when(fine, allowed).alias("allowed"),
        F.when(fine, flagged).alias("categories"),
        F.when(fine, F.col("confidence")).alias("confidence"),
        F.when(fine, F.col("latency_ms")).alias("latency_ms"),
        "error",
    )


def score_text(
    rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply a caller's model to Arrow batches of rows; it returns frames of `schema`."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield model(frame)

    return rows.mapInPandas(batches, schema)
