"""Exact quantiles from value counts, without one task holding a key's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.plans.slices import SLICE_ROWS, running


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per key with linearly interpolated quantiles: {new name: fraction}.

    Equal values are counted before the shuffle; a running count over the distinct values
    then tells which value stands at a rank.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running(counts, keys, value, {"__upto": ("sum", F.col("__c"))}, (), slice_rows)
    sizes = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    placed = ranked.join(sizes, list(keys))

    def at(fraction: float, side):
        rank = side(F.lit(fraction) * (F.col("__n") - 1))
        return F.min(F.when(F.col("__upto") > rank, F.col(value)))

    picks = []
    for name, fraction in quantiles.items():
        picks += [
            at(fraction, F.floor).alias(f"__lo_{name}"),
            at(fraction, F.ceil).alias(f"__hi_{name}"),
        ]
    out = placed.groupBy(*keys).agg(F.first("__n").alias("__n"), *picks)

    def blend(name: str, fraction: float):
        exact = F.lit(fraction) * (F.col("__n") - 1)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return (low + (high - low) * (exact - F.floor(exact))).alias(name)

    return out.select(*keys, *[blend(name, fraction) for name, fraction in quantiles.items()])
