"""Vectors of whole numbers, their exact inner products, and blocks in which rows and queries meet."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import col, fresh, written

EXACT = float(1 << 53)  # doubles hold every whole number up to here
LEAST, MOST = -(1 << 63), (1 << 63) - 1
LARGEST = 1.7976931348623157e308
BLOCK_ROWS = 16_384
QUERY_BLOCK = 2_048
BLOCK_VALUES = 1 << 21  # numbers in a block: 16 MB


def whole_numbers(df: DataFrame, factor: int, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(vec_id, v, further columns) of the rows that take part; v is floor(factor * x) per component.

    Doubles hold these numbers exactly. Null ids, null vectors and vectors that hold null or
    non-finite components take no part.
    """
    v = col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(col(id_col).isNotNull() & v.isNotNull() & fine)
    def floored(x):
        y = F.greatest(F.least(x.cast("double") * factor, F.lit(LARGEST)), F.lit(-LARGEST))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # beyond, doubles are whole

    floors = F.transform(v, floored)
    return rows.select(col(id_col).cast("bigint").alias("vec_id"), floors.alias("v"), *[col(name) for name in more])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A number per row, for tables in which ids repeat; write the result before using it twice."""
    (free,) = fresh(df, name)
    return df.withColumn(free, F.monotonically_increasing_id())


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of one width; shorter vectors count as zero beyond their end."""
    out = np.zeros((len(column), width))
    for n, x in enumerate(column):
        out[n, : len(x)] = x
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows with all rows; beyond 64 bits the nearest 64-bit number."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), np.int64)
    # all partial sums stay below the product of the norms
    with np.errstate(over="ignore", invalid="ignore"):
        exact = np.linalg.norm(left, axis=1).max() * np.linalg.norm(right, axis=1).max() < EXACT
    if exact:
        return (left @ right.T).astype(np.int64)
    rows = [[int(x) for x in row] for row in right]
    out = np.empty((len(left), len(right)), np.int64)
    for n, line in enumerate(left):
        mine = [int(x) for x in line]
        out[n] = [min(MOST, max(LEAST, sum(a * b for a, b in zip(mine, row)))) for row in rows]
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def binned(leaves: list[int], sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(leaf, bin, blocks): neighbouring leaves share a bin of at most `most` rows; a larger leaf has its own, in blocks."""
    out, number, filled = [], -1, most
    for leaf in leaves:
        if leaf in sizes:
            if filled + sizes[leaf] > most:
                number, filled = number + 1, 0
            filled += sizes[leaf]
            out.append((leaf, number, -(-filled // most)))
    return out


def in_blocks(
    rows: DataFrame,
    asking: DataFrame,
    pairs: DataFrame,
    homes: list[tuple[int, int, int]],
    score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """`score` of every block of rows with every block of the queries that want some of its leaves.

    `rows` and `asking` have (rid, leaf, ...), `pairs` (q_leaf, leaf): what queries want; `homes` says
    in which bin each leaf lies and how many blocks the bin has. A query goes once to every block
    of a bin, with the `leaves` it wants there.
    """
    home = F.broadcast(rows.sparkSession.createDataFrame(homes, "leaf bigint, bin bigint, blocks bigint"))
    wants = pairs.join(home, "leaf").groupBy(F.col("q_leaf").alias("leaf"), "bin")
    wants = wants.agg(F.collect_list("leaf").alias("leaves"), F.max("blocks").alias("blocks"))
    sent = written(asking.join(wants, "leaf").drop("leaf"), "blocks-asked")
    # a row per bin, so no more than leaves
    asks = F.broadcast(sent.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("q_blocks"), F.max("blocks").alias("blocks")))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    left = rows.join(home.select("leaf", "bin"), "leaf").join(asks, "bin")
    left = left.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks"))).withColumn("q_block", every("q_blocks"))
    right = sent.drop("blocks").join(asks, "bin")
    right = right.withColumn("q_block", F.pmod(F.xxhash64("rid"), F.col("q_blocks"))).withColumn("block", every("blocks"))
    keys = ["bin", "block", "q_block"]
    left, right = (side.drop("blocks", "q_blocks").groupBy(*keys) for side in (left, right))
    return left.cogroup(right).applyInPandas(score, schema)
