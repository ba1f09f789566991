"""The three tables of the data model, clustered by what their readers group and order by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "events": "ts TIMESTAMP, incident_id STRING, seq BIGINT, event_type STRING, payload STRING",
    "metrics": "ts TIMESTAMP, service STRING, metric STRING, value DOUBLE",
    "history": "ts TIMESTAMP, source STRING, record_type STRING, external_id STRING, author STRING, title STRING, payload STRING",
}
# what lies together, and its order there; `seq` tells events of one time apart
CLUSTERED = {
    "events": (("incident_id",), ("incident_id", "ts", "seq")),
    "metrics": (("service", "metric"), ("service", "metric", "ts")),
    "history": (("source", "record_type"), ("source", "record_type", "ts")),
}
BUCKETS = 64


def create_tables(spark: SparkSession, prefix: str = "", location: str | None = None, buckets: int = BUCKETS) -> list[str]:
    """Create the tables that do not exist yet and return their names.

    Rows are bucketed and sorted, so that windows and groups over a table's own key need no shuffle.
    `location` is the folder of external tables; without it they are managed.
    """
    names = []
    for table, columns in TABLES.items():
        name = f"{prefix}{table}"
        keys, order = (", ".join(names) for names in CLUSTERED[table])
        place = f" LOCATION '{location.rstrip('/')}/{table}'" if location else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
            f" CLUSTERED BY ({keys}) SORTED BY ({order}) INTO {buckets} BUCKETS{place}"
        )
        names.append(name)
    return names


def fill_table(rows: DataFrame, table: str, prefix: str = "", buckets: int = BUCKETS) -> None:
    """Append rows to one of the tables, a file per bucket, or several where a bucket is large.

    A key may hold most rows, so a large bucket is sorted and written by several tasks.
    """
    keys, _ = CLUSTERED[table]
    columns = [part.split()[0] for part in TABLES[table].split(", ")]
    # the same hash as the buckets', so a task writes whole buckets; rebalancing cuts the large ones
    rows.select(*columns).hint("rebalance", buckets, *[F.col(key) for key in keys]).write.insertInto(f"{prefix}{table}")
