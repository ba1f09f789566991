"""Ordered windows that survive hot keys.

A plain `Window.partitionBy(key)` sends a whole key to one task. The helpers here first count rows
per key. Where no key is above the limit, the plan is the plain window. Otherwise only those keys
are cut into consecutive slices of the order column; the window runs inside each slice and the
slice borders are repaired from a small remainder. Results are the same either way: null order
values come first, in the first slice, as they do in a plain window.

Keys must not be null. A slice that a burst overfills is cut again, by its own range of the order
column or, where all its rows share one order value, by the first tie column if that is numeric.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import scratch_path

SLICE = "__slice"
HOT = "__hot"
POS = "__pos"

# A key is hot above this many rows; a slice then aims at this many.
SLICE_ROWS = 1_000_000
# A slice with this many times the rows it should have is cut again, LEVELS times at most.
CROWDED = 4
LEVELS = 4
FIRST_BITS, INNER_BITS = 20, 10  # of a slice number: 2^20 slices of a key, 2^10 of a crowded slice


def order_number(df: DataFrame, order: str) -> Column:
    """The order column as a double that never decreases along it."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    return F.col(order).cast("double")


def _tie_number(df: DataFrame, tie: Sequence[str]) -> Column:
    """The first tie column as a double, or null where it can't cut."""
    if tie and isinstance(df.schema[tie[0]].dataType, (T.NumericType, T.TimestampType, T.DateType)):
        return order_number(df, tie[0])
    return F.lit(None).cast("double")


def find_hot(
    df: DataFrame, keys: Sequence[str], order: str, slice_rows: int = SLICE_ROWS
) -> DataFrame | list:
    """Keys above `slice_rows` rows, with their order range and slice count; an empty list if none.

    One job over the key and order columns, pre-aggregated before its shuffle. However many keys
    are hot, they stay a table: only whether there is one comes back.
    """
    at = order_number(df, order)
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min(at).alias("__lo"), F.max(at).alias("__hi")
    )
    large = stats.where(F.col("__n") > slice_rows)
    if large.isEmpty():
        return []
    parts = F.least(F.ceil(F.col("__n") / float(slice_rows)), F.lit(1 << FIRST_BITS)).cast("double").alias("__parts")
    return kept(large.select(*keys, "__lo", "__hi", parts))


def kept(table: DataFrame) -> DataFrame:
    """Written, so that every plan that uses the table cuts by the same figures."""
    path = scratch_path(table.sparkSession, "slices")
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def with_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    hot: DataFrame,
    slice_rows: int = SLICE_ROWS,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add `__slice` (0 for a key's first, rising with `order`) and `__hot` (the key was cut)."""
    cut = _cut(df, keys, order_number(df, order), hot, SLICE, HOT)
    for _ in range(LEVELS):
        crowded = _crowded(cut, keys, order, tie, slice_rows)
        if crowded is None:
            break
        at = F.when(F.col("__by_tie"), _tie_number(df, tie)).otherwise(order_number(df, order))
        finer = _cut(cut, [*keys, SLICE], at, crowded, "__inner", "__again")
        place = F.shiftleft(F.col(SLICE), INNER_BITS) + F.col("__inner")
        cut = finer.select(*df.columns, place.alias(SLICE), HOT)
    return cut


def _crowded(
    cut: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str], slice_rows: int
) -> DataFrame | None:
    """Slices that hold far more rows than they should and can be cut, with their ranges."""
    at, other = order_number(cut, order), _tie_number(cut, tie)
    stats = cut.where(HOT).groupBy(*keys, SLICE).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(at).alias("lo"), F.max(at).alias("hi"), F.min(other).alias("tie_lo"), F.max(other).alias("tie_hi"),
        F.count(at).alias("known"),
    )
    # nulls come first and tie with each other only: they leave the order range alone
    by_tie = ~F.coalesce(F.col("hi") > F.col("lo"), F.lit(False)) & ((F.col("known") == F.col("__n")) | (F.col("known") == 0))
    parts = F.least(F.ceil(F.col("__n") / float(slice_rows)) * CROWDED, F.lit(1 << INNER_BITS)).cast("double")
    ranged = stats.where(F.col("__n") > CROWDED * slice_rows).select(
        *keys,
        SLICE,
        F.when(by_tie, F.col("tie_lo")).otherwise(F.col("lo")).alias("__lo"),
        F.when(by_tie, F.col("tie_hi")).otherwise(F.col("hi")).alias("__hi"),
        parts.alias("__parts"),
        by_tie.alias("__by_tie"),
    ).where("__hi > __lo")
    return None if ranged.isEmpty() else kept(ranged)


def _cut(df: DataFrame, keys: Sequence[str], at: Column, table: DataFrame, name: str, flag: str) -> DataFrame:
    """Add the place, from 0, of a row in the range of its key's entry in `table`, and whether it has one."""
    if keys:
        joined = df.join(table, list(keys), "left")
    else:
        joined = df.join(F.broadcast(table), how="left")  # one row
    low, high, parts = F.col("__lo"), F.col("__hi"), F.col("__parts")
    place = F.when(high > low, F.floor((at - low) / F.when(high > low, high - low) * parts))
    inside = F.greatest(F.lit(0), F.least(place, parts.cast("bigint") - 1))
    # null order values are sorted first
    return joined.select(
        *[F.col(column) for column in df.columns],
        F.when(at.isNull() | place.isNull(), 0).otherwise(inside).cast("bigint").alias(name),
        parts.isNotNull().alias(flag),
    )


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, so later filters are not pushed into the columns.

    A filter pushed below parsed columns would parse the payload once per mention.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(name) for name in df.columns]))))


def _sort(order: str, tie: Sequence[str]) -> list[Column]:
    return [F.col(order).asc(), *[F.col(name).asc() for name in tie]]


def bounded_frame(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    reach: int,
    columns: Callable[[Window], dict[str, Column]],
    tie: Sequence[str] = (),
    slice_rows: int = SLICE_ROWS,
    hot: DataFrame | list | None = None,
) -> DataFrame:
    """Add window columns whose frames look back at most `reach` rows.

    `columns` gets an ordered window and returns the new columns. Only the first `reach`
    rows of a slice can look past its start, and all they can see are the last `reach` rows
    of the slices before; those borders are evaluated again on their own.
    """
    by = _sort(order, tie)
    across = Window.partitionBy(*keys).orderBy(*by)
    hot = find_hot(df, keys, order, slice_rows) if hot is None else hot
    if not hot:
        return df.withColumns(columns(across))
    cut = with_slices(df, keys, order, hot, slice_rows, tie)
    inner = Window.partitionBy(*keys, SLICE).orderBy(*by)
    inside = (
        cut.withColumns({**columns(inner), POS: F.row_number().over(inner)})
        .where((F.col(SLICE) == 0) | (F.col(POS) > reach))
        .drop(SLICE, HOT, POS)
    )
    whole = Window.partitionBy(*keys, SLICE)
    edge = (
        cut.where(HOT)
        .withColumns({POS: F.row_number().over(inner), "__size": F.count(F.lit(1)).over(whole)})
        .where((F.col(POS) <= reach) | (F.col(POS) > F.col("__size") - reach))
    )
    repaired = (
        edge.withColumns(columns(across))
        .where((F.col(SLICE) > 0) & (F.col(POS) <= reach))
        .drop(SLICE, HOT, POS, "__size")
    )
    return inside.unionByName(repaired)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, tuple[str, Column]],
    tie: Sequence[str] = (),
    slice_rows: int = SLICE_ROWS,
    hot: DataFrame | list | None = None,
) -> DataFrame:
    """Add running columns over all earlier rows and the current one.

    `columns` maps a name to (kind, value) with kind `sum`, `max` or `last` (last non-null).
    Each slice runs on its own; what it inherits is one row per slice.
    """
    agg = {
        "sum": F.sum,
        "max": F.max,
        "last": lambda value: F.last(value, ignorenulls=True),
    }
    by = _sort(order, tie)
    hot = find_hot(df, keys, order, slice_rows) if hot is None else hot

    def upto(*parts: str) -> dict[str, Column]:
        rows = Window.partitionBy(*parts).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return {name: agg[kind](value).over(rows) for name, (kind, value) in columns.items()}

    if not hot:
        return df.withColumns(upto(*keys))
    cut = with_slices(df, keys, order, hot, slice_rows, tie)
    local = cut.withColumns(upto(*keys, SLICE))

    rank = F.struct(*[F.col(name) for name in (order, *tie)])
    whole = {
        "sum": F.sum,
        "max": F.max,
        "last": lambda value: F.max_by(value, F.when(value.isNotNull(), rank)),
    }
    totals = cut.where(HOT).groupBy(*keys, SLICE).agg(
        *[whole[kind](value).alias(f"__{name}") for name, (kind, value) in columns.items()]
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        SLICE,
        *[agg[kind](F.col(f"__{name}")).over(before).alias(f"__{name}") for name, (kind, _) in columns.items()],
    )
    merge = {
        "sum": lambda here, past: F.coalesce(here + past, here, past),
        "max": F.greatest,
        "last": F.coalesce,
    }
    return local.join(carried, [*keys, SLICE], "left").select(
        *df.columns,
        *[
            merge[kind](F.col(name), F.col(f"__{name}")).alias(name)
            for name, (kind, _) in columns.items()
        ],
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    tie: Sequence[str] = (),
    slice_rows: int = SLICE_ROWS,
    hot: DataFrame | list | None = None,
) -> DataFrame:
    """Add a 1-based row number per key."""
    one = F.lit(1).cast("bigint")
    return running(df, keys, order, {name: ("sum", one)}, tie, slice_rows, hot)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, str],
    tie: Sequence[str] = (),
    slice_rows: int = SLICE_ROWS,
    hot: DataFrame | list | None = None,
) -> DataFrame:
    """Add the value of a column one row earlier: {new name: source column}."""
    return bounded_frame(
        df,
        keys,
        order,
        1,
        lambda window: {name: F.lag(source).over(window) for name, source in columns.items()},
        tie,
        slice_rows,
        hot,
    )


def text_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str,
    glue: str,
    tie: Sequence[str] = (),
    part_rows: int = 10_000,
    slice_rows: int = SLICE_ROWS,
    hot: DataFrame | list | None = None,
) -> DataFrame:
    """Join ordered text rows per key into parts of at most `part_rows` rows.

    Returns (keys, part, n_rows, text); the parts of a key, joined in order with `glue`, are
    its whole text. No task holds more than one part, however long the text is.
    """
    rows = numbered(df, keys, order, POS, tie, slice_rows, hot)
    placed = rows.select(
        *keys,
        F.floor((F.col(POS) - 1) / part_rows).cast("bigint").alias("part"),
        F.struct(F.col(POS).alias("pos"), F.col(text).alias("text")).alias("__row"),
    )
    parts = placed.groupBy(*keys, "part").agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
    return parts.select(
        *keys,
        "part",
        F.size("__rows").cast("bigint").alias("n_rows"),
        F.array_join(F.transform("__rows", lambda row: row["text"]), glue).alias("text"),
    )
