"""Small helpers that every operator here needs: written intermediates, free names, bounded bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import scratch_path

# The largest filter of repeated hashes: 2^28 bits are 32 MB, which any executor can hold.
# More rows fill the filter up, so more of them count as possibly repeated; results stay the same.
MAX_BITS = 1 << 28
BITS_PER_ROW = 16
BLOCK_BITS = 32768  # of Spark's bitmap functions
SEEDS = (11, 23)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write under the shared scratch folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of `df` (case does not tell names apart in Spark)."""
    taken = {column.lower() for column in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def filter_bits(rows: int, most: int = MAX_BITS) -> int:
    """Size of a filter for so many rows: a power of two, never above `most`."""
    bits = BLOCK_BITS
    while bits < BITS_PER_ROW * rows and bits < most:
        bits *= 2
    return bits


def _slot(key: Column, seed: int, bits: int) -> Column:
    # from 1, as Spark's bitmap functions number their blocks for positive values
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) + F.lit(1)


def repeated_filter(df: DataFrame, key: str, bits: int, least: int = 2) -> DataFrame:
    """First pass: bitmap blocks (block, bitmap) of the slots that at least `least` rows hit.

    Every row sets one slot per seed. A key that two rows share hits each of its slots twice, so
    both of its bits are set. Slots are counted with a partial aggregate before the shuffle.
    """
    slots = df.select(F.explode(F.array(*[_slot(F.col(key), seed, bits) for seed in SEEDS])).alias("slot"))
    often = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least)
    return often.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    )


def probe(df: DataFrame, key: str, blocks: DataFrame, bits: int, flag: str) -> DataFrame:
    """Second pass: a boolean column that is true where the key's bits are all set.

    The blocks together have at most `bits` bits (see MAX_BITS), so they are broadcast.
    """
    out, found = df, []
    for n, seed in enumerate(SEEDS):
        block, bitmap, slot = fresh(out, f"block{n}", f"bitmap{n}", f"slot{n}")
        side = F.broadcast(blocks.select(F.col("block").alias(block), F.col("bitmap").alias(bitmap)))
        out = out.withColumn(slot, _slot(col(key), seed, bits))
        out = out.join(side, F.bitmap_bucket_number(col(slot)) == F.col(block), "left")
        place = F.bitmap_bit_position(col(slot))
        byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        shifted = F.call_function("shiftright", byte.cast("int"), F.pmod(place, F.lit(8)).cast("int"))
        found.append(F.coalesce(shifted.bitwiseAND(F.lit(1)) == 1, F.lit(False)))
    hit = found[0]
    for more in found[1:]:
        hit = hit & more
    return out.select(*[col(name) for name in df.columns], hit.alias(flag))
