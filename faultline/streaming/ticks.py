"""A recording replayed tick by tick: the stream's offset is the number of the last tick read.

`record_ticks` stores a recording with its distinct times numbered from 1, in folders of a bounded
number of ticks each. The source hands on one tick per micro-batch (or more, if told so), in time
order, and goes on after the last one it handed on when a query restarts from its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.plans.slices import kept, numbered

TICK, FOLDER = "__tick", "__folder"
TICKS_PER_FOLDER = 1_000


def record_ticks(rows: DataFrame, path: str, order: str = "ts", per_folder: int = TICKS_PER_FOLDER) -> int:
    """Store rows under `path`, by the number of their time among all distinct times; returns how many there are."""
    ticks = kept(numbered(rows.select(order).distinct(), [], order, TICK))
    placed = rows.join(ticks, order).withColumn(FOLDER, F.floor((F.col(TICK) - 1) / per_folder).cast("bigint"))
    # a busy tick may fill several files
    placed.hint("rebalance", FOLDER).sortWithinPartitions(FOLDER, TICK).write.partitionBy(FOLDER).parquet(path)
    return ticks.count()


class TickFile(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class TickReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"]
        self.last, self.step = int(options["ticks"]), int(options.get("ticksperbatch", 1))
        self.per_folder = int(options.get("ticksperfolder", TICKS_PER_FOLDER))
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        self.at = min((self.at or 0) + self.step, self.last)
        return {"tick": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # after a restart the last planned batch comes first, and tells where the query stands
        self.at = max(self.at or 0, end["tick"])
        first, last = start["tick"] + 1, end["tick"]
        store, root = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pa.fs.LocalFileSystem(), self.path)
        out = []
        for folder in range((first - 1) // self.per_folder, (last - 1) // self.per_folder + 1):
            listed = store.get_file_info(pa.fs.FileSelector(f"{root}/{FOLDER}={folder}", allow_not_found=True))
            out += [TickFile(info.path, first, last) for info in listed if info.path.endswith(".parquet")]
        return out or [TickFile("", first, last)]

    def read(self, partition: TickFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store = pa.fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pa.fs.LocalFileSystem()
        # files are sorted by tick: row groups without these are skipped
        table = pa.parquet.read_table(
            partition.path, filesystem=store, partitioning=None, columns=[*self.schema.names],
            filters=[(TICK, ">=", partition.first), (TICK, "<=", partition.last)],
        )
        yield from table.cast(to_arrow_schema(self.schema)).to_batches(max_chunksize=10_000)

    def commit(self, end: dict) -> None:
        pass


class TickSource(DataSource):
    """Options: path, ticks (how many there are), schema (JSON), ticksPerBatch, ticksPerFolder."""

    @classmethod
    def name(cls) -> str:
        return "faultline_ticks"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.options["schema"]))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return TickReader(schema, self.options)


def tick_stream(spark: SparkSession, path: str, schema: str, ticks: int, per_batch: int = 1, per_folder: int = TICKS_PER_FOLDER) -> DataFrame:
    """What `record_ticks` stored as a stream of one micro-batch per tick."""
    spark.dataSource.register(TickSource)
    parsed = T.StructType.fromDDL(schema)
    options = {"path": path, "schema": parsed.json(), "ticks": ticks, "ticksPerBatch": per_batch, "ticksPerFolder": per_folder}
    return spark.readStream.format("faultline_ticks").options(**options).load()


def replay_to_table(stream: DataFrame, path: str, checkpoint: str, batches: int | None = None) -> None:
    """Append every micro-batch with its number, as `batch`, until the recording ends or after so many."""
    done = []

    def append(rows: DataFrame, number: int) -> None:
        # a batch that is replayed after a failure takes the place of its first attempt
        rows.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch-{number:012d}")
        done.append(number)

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).start()
    try:
        if batches is None:
            query.processAllAvailable()
        else:
            while query.isActive and len(done) < batches and not query.awaitTermination(0.05):
                pass
    finally:
        query.stop()
