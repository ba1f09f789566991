"""Knowledge documents as files, and report pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import slug


def kb_manifest(documents: DataFrame) -> DataFrame:
    """Rendered text, file name, byte size and md5 of documents (content_id, title, summary, text)."""
    body = F.concat(F.lit("# "), "title", F.lit("\n\n> "), "summary", F.lit("\n\n"), "text")
    return documents.select("content_id", "title", body.alias("body")).select(
        "content_id",
        F.concat(slug(F.col("title")), F.lit(".md")).alias("filename"),
        F.octet_length("body").cast("bigint").alias("size_bytes"),
        F.md5(F.encode("body", "UTF-8")).alias("md5"),
        "body",
    )


def write_report_pages(pages: DataFrame, path: str) -> None:
    """Pages (incident_id, html) as a table in incident order; refused ones are left out.

    One file per page would not scale; a reader filters on the incident and takes the text.
    """
    kept = pages.where(F.col("html").isNotNull()).select("incident_id", "html")
    kept.repartitionByRange("incident_id").sortWithinPartitions("incident_id").write.mode("append").parquet(path)
