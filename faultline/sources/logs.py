"""JSON-lines logs: core fields plus any further fields at top level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import jsonval
from faultline.functions.text import iso_stamp

CORE = ("timestamp", "level", "logger", "msg")


def scan_json_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines as (timestamp, level, logger, msg, extra); `extra` maps names to VARIANT values."""
    lines = spark.read.option("singleVariantColumn", "v").json(path)
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    return lines.select(
        F.try_to_timestamp(jsonval.text(F.col("v"), "$.timestamp")).alias("timestamp"),
        *[jsonval.raw_text(F.col("v"), f"$.{name}").alias(name) for name in CORE[1:]],
        F.map_filter(fields, lambda name, _: ~name.isin(*CORE)).alias("extra"),
    )


def log_text(records: DataFrame) -> DataFrame:
    """Records with `extra` as JSON object text, as one flat JSON line each."""
    core = F.to_json(
        F.struct(iso_stamp(F.col("timestamp")).alias("timestamp"), *[F.col(name) for name in CORE[1:]])
    )
    tail = F.when(
        F.coalesce(F.col("extra"), F.lit("{}")) != "{}",
        F.concat(F.lit(","), F.substring(F.col("extra"), F.lit(2), F.char_length("extra"))),
    ).otherwise("}")
    return records.select(F.concat(F.left(core, F.char_length(core) - 1), tail).alias("value"))


def write_json_logs(records: DataFrame, path: str) -> None:
    log_text(records).write.mode("append").text(path)
