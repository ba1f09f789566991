"""Exact nearest vectors by cosine over an index of balls around pivots.

Pivots come from a bounded sample. Every vector lies with its nearest pivot, in a ring of angles to it;
a ring knows its least and greatest angle. On the sphere the triangle inequality bounds the angle
between a query and all vectors of a ring from both sides:

    max(0, a - hi, lo - a) <= angle <= a + hi        for a query at angle a to the pivot

The nearest rings, by their greater bound, that hold k vectors give every query a floor, and rings
that cannot reach it are skipped. Neighbouring rings share a bin, and a large ring is cut into blocks
of bounded size; a block is read once however many thousand queries visit it, and hands on each
query's own best k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.plans.slices import kept

SAMPLE = 4_096
PIVOTS = 64
RINGS = 24  # of equal width between 0 and pi
BLOCK_ROWS = 16_384
QUERY_BLOCK = 32_768  # queries that share one reading of a block
ROWS_PER_PIVOT = 64
BLUR = 1e-6  # angles: cosines near 1 lose half their digits
DIGITS = 6
MARGIN = 2e-6  # scores are ranked as rounded
FOUND = "query_id bigint, vec_id bigint, score double"


def unit(column: pd.Series) -> np.ndarray:
    rows = np.stack(column.to_numpy()).astype("float64")
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Directions far from each other: each next one is the farthest from those before."""
    chosen, near = [sample[0]], sample @ sample[0]
    while len(chosen) < count and near.min() < 1 - 1e-9:
        chosen.append(sample[near.argmin()])
        near = np.maximum(near, sample @ chosen[-1])
    return np.stack(chosen)


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


@dataclass(frozen=True)
class BallIndex:
    """`placed`: vec_id, embedding, ring, block; one entry per ring in the arrays, of which there are
    at most PIVOTS * RINGS + 1 (the last for vectors of zeros, which are at score 0 from all)."""

    placed: DataFrame | None
    pivots: np.ndarray
    rings: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    greatest: np.ndarray

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) score that a vector of each ring can have with each query."""
        zero = self.rings < 0
        at = angles(queries, self.pivots)[:, np.where(zero, 0, self.rings // RINGS)]
        near = np.maximum(0, np.maximum(at - self.greatest, self.least - at) - BLUR)
        far = np.minimum(np.pi, at + self.greatest + BLUR)
        blank = np.linalg.norm(queries, axis=1)[:, None] == 0
        return np.where(zero | blank, 0.0, np.cos(far)), np.where(zero | blank, 0.0, np.cos(near))

    def bins(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(bin, blocks) of every ring: rings in a row share a bin of at most `rows` vectors."""
        out, number, filled = [], -1, rows
        for size in self.sizes:
            if filled + size > rows:
                number, filled = number + 1, 0
            filled += size
            out.append(number)
        held = np.bincount(out, weights=self.sizes)
        return np.asarray(out), -(-held[out].astype(int) // rows)

    def visits(self, queries: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """The rings that each query must visit."""
        low, high = self.bounds(queries)
        for one, most in zip(low, high):
            order = np.argsort(-one, kind="stable")
            enough = int(np.searchsorted(np.cumsum(self.sizes[order]), k))
            floor = one[order[enough]] - MARGIN if enough < len(order) else -np.inf
            yield self.rings[most >= floor]


def build_balls(vectors: DataFrame, pivots: int = PIVOTS) -> BallIndex | None:
    """An index of vectors (vec_id, embedding) of one length; None without any. Null embeddings take no part."""
    vectors = vectors.select("vec_id", "embedding").where("embedding IS NOT NULL")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if not len(sample):
        return None
    rows = unit(sample["embedding"])
    rows = rows[np.linalg.norm(rows, axis=1) > 0]
    chosen = pivots_of(rows, max(1, min(pivots, len(rows) // ROWS_PER_PIVOT))) if len(rows) else np.eye(1, len(sample["embedding"].iloc[0]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own = unit(batch["embedding"])
                at = angles(own, chosen)
                nearest = at.argmin(1)
                angle = at[np.arange(len(at)), nearest]
                ring = nearest * RINGS + np.minimum(RINGS - 1, (angle / np.pi * RINGS).astype(int))
                yield batch.assign(angle=angle, ring=np.where(np.linalg.norm(own, axis=1) > 0, ring, -1))

    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = kept(vectors.mapInPandas(place, f"vec_id bigint, embedding {kind}, angle double, ring bigint"))
    stats = placed.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).orderBy("ring").toPandas()
    return BallIndex(placed, chosen, *(stats[name].to_numpy() for name in ("ring", "n", "lo", "hi")))


def nearest(stored: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The `k` nearest of a block of vectors for every query that visits it."""
    if not len(stored) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    stored = stored.sort_values("vec_id", kind="stable")
    ids, rows = stored["vec_id"].to_numpy(), unit(stored["embedding"])
    out = []
    for low in range(0, len(queries), 512):
        part = queries.iloc[low : low + 512]
        scores = np.round(unit(part["embedding"]) @ rows.T, DIGITS)
        # stable on ids in order, so ties go to the lower id
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        asked = np.repeat(part["query_id"].to_numpy(), order.shape[1])
        out.append(pd.DataFrame({"query_id": asked, "vec_id": ids[order.ravel()], "score": np.take_along_axis(scores, order, axis=1).ravel()}))
    return pd.concat(out)


def visited(index: BallIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, embedding, bin) for each bin that a query must visit."""
    bin_of = dict(zip(index.rings.tolist(), index.bins(BLOCK_ROWS)[0].tolist()))
    known = replace(index, placed=None)  # what tasks need

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                wanted = [sorted({bin_of[ring] for ring in rings.tolist()}) for rings in known.visits(unit(batch["embedding"]), k)]
                yield batch.assign(bin=wanted).explode("bin").dropna(subset="bin").astype({"bin": "int64"})

    queries = queries.select(F.col("query_id").cast("bigint"), "embedding").where("embedding IS NOT NULL")
    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.mapInPandas(route, f"query_id bigint, embedding {kind}, bin bigint")


def search(index: BallIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) of the `k` nearest vectors per (query_id, embedding)."""
    spark = queries.sparkSession
    sent = visited(index, queries, k)
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))  # beyond QUERY_BLOCK queries a block is read again
    numbers, blocks = index.bins(BLOCK_ROWS)
    homes = F.broadcast(spark.createDataFrame(list(zip(*(x.tolist() for x in (index.rings, numbers, blocks)))), "ring bigint, bin bigint, blocks bigint"))

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    left = index.placed.join(homes, "ring").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    left = left.withColumn("q_block", every(F.lit(q_blocks)) if q_blocks > 1 else F.lit(0).cast("bigint"))
    right = sent.join(F.broadcast(homes.select("bin", "blocks").distinct()), "bin").withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)))
    right = right.withColumn("block", every(F.col("blocks")))
    keys = ["bin", "block", "q_block"]
    left, right = left.select(*keys, "vec_id", "embedding").groupBy(*keys), right.select(*keys, "query_id", "embedding").groupBy(*keys)
    found = left.cogroup(right).applyInPandas(lambda ours, theirs: nearest(ours, theirs, k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
