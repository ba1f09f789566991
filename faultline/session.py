"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Window frames cost far more CPU per byte than a scan: keep all cores busy on small shuffles.
# At scale the share per core exceeds this and decides instead.
MIN_PARTITION = "64k"


def build_session(app: str = "faultline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive planning; `conf` keys use `__` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even where the aggregate above must then shuffle again
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": MIN_PARTITION,
        "spark.python.unix.domain.socket.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options a caller-made session may lack."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", MIN_PARTITION)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for checkpoints and written intermediates.

    It lies under `spark.checkpoint.dir`, which on a cluster names shared storage.
    A local folder is used only where that is unset and the master is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="faultline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
