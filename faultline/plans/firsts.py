"""First row per key without a window over the key."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# more than the span of a 64-bit number, and less than the least time in microseconds
SPAN = Decimal(20_000_000_000_000_000_000)
NO_TIME, NO_NUMBER = -(10**18), -(1 << 63)


def position(time: Column, number: Column) -> Column:
    """Place in (time, number) order as one decimal, nulls first.

    An aggregate that ranks rows by it has a buffer of fixed width, so it hashes; a struct would
    make it sort its whole input.
    """
    micros = F.coalesce(F.unix_micros(time.cast("timestamp")), F.lit(NO_TIME)).cast("decimal(19,0)")
    inner = F.coalesce(number.cast("bigint"), F.lit(NO_NUMBER)).cast("decimal(19,0)")
    return (micros * F.lit(SPAN) + inner).cast("decimal(38,0)")


def _rank(df: DataFrame, order: Sequence[str], row_id: str) -> Column:
    kinds = [df.schema[name].dataType for name in (*order, row_id)]
    if len(kinds) == 2 and isinstance(kinds[0], (T.TimestampType, T.TimestampNTZType)) and isinstance(kinds[1], T.IntegralType):
        return position(F.col(order[0]), F.col(row_id))
    return F.struct(*order, row_id)


def flag_first(df: DataFrame, keys: Sequence[str], row_id: str, order: Sequence[str], name: str) -> DataFrame:
    """Add a boolean `name` that marks the first row of each key by (order, row_id).

    `row_id` must be unique. The winner per key comes from a pre-aggregated minimum, and the
    join back runs on the unique id, so a key that holds most rows stays spread out.
    """
    rank = _rank(df, order, row_id)
    winners = df.groupBy(*keys).agg(F.min_by(row_id, rank).alias(row_id)).select(row_id, F.lit(True).alias(name))
    return df.join(winners, row_id, "left").withColumn(name, F.coalesce(name, F.lit(False)))
