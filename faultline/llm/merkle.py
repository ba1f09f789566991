"""Merkle fixity audit of web-archive replicas.

A replica is a set of records at addresses (file, start offset) with a payload. Records are hashed
into leaves; ordered offset ranges of a file are hashed into nodes, FAN ranges to the next wider
one, up to one root per file. Comparing two replicas starts at the roots and descends only into
ranges whose hashes differ, down to the records.

A leaf's hash covers its offset and payload hash; records that share an address count together, in
order of their hashes. A node's hash covers its children's in offset order. Null payloads hash as
empty; a null file or offset is an address of its own. Records on one side only come out as
missing or extra; ranges without records have no node. Empty replicas give empty trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.tables import col, written

LEAF_RANGE = 1 << 16  # bytes of the narrowest ranges
FAN_BITS = 4
LEVELS = 6  # ranges of 64 KB, 1 MB, 16 MB, 256 MB, 4 GB; then the file
FILE_BYTES = 1 << 28


def _fold(children: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.transform(F.sort_array(children), lambda c: F.concat_ws(":", c["offset"], c["hash"]))), 256)


def _range(offset: Column, level: int) -> Column:
    """Start of the range of a level that holds an offset; the last level is the whole file."""
    if level == LEVELS - 1:
        return F.lit(0).cast("bigint")
    bits = LEAF_RANGE.bit_length() - 1 + FAN_BITS * level
    return F.shiftleft(F.shiftright(offset, bits), bits)


def leaves(records: DataFrame, file: str = "file", offset: str = "offset", payload: str = "payload") -> DataFrame:
    """(file, offset, hash) per address; payloads are hashed where they are read."""
    hashed = records.select(
        F.coalesce(col(file).cast("string"), F.lit("")).alias("file"),
        F.coalesce(col(offset).cast("bigint"), F.lit(-1)).alias("offset"),
        F.sha2(F.coalesce(col(payload).cast("binary"), F.lit("").cast("binary")), 256).alias("hash"),
    )
    return leaves_of_hashes(hashed)


def leaves_of_hashes(hashed: DataFrame) -> DataFrame:
    # records alike fold before the shuffle, so an address holds its different payloads only
    alike = hashed.groupBy("file", "offset", "hash").agg(F.count(F.lit(1)).alias("n"))
    own = F.concat_ws("*", F.col("hash"), F.when(F.col("n") > 1, F.col("n")))
    return alike.groupBy("file", "offset").agg(F.concat_ws("+", F.sort_array(F.collect_list(own))).alias("hash"))


def tree(leaf: DataFrame) -> DataFrame:
    """(level, file, offset, parent, hash) of all nodes; leaves have level -1, roots the last one.

    A node has at most FAN children, a narrowest range at most its records, so no fold is large.
    """
    now = leaf.select(F.lit(-1).alias("level"), "file", "offset", _range(F.col("offset"), 0).alias("parent"), "hash")
    every = now
    for level in range(LEVELS):
        nodes = now.groupBy("file", F.col("parent").alias("offset")).agg(_fold(F.collect_list(F.struct("offset", "hash"))).alias("hash"))
        parent = _range(F.col("offset"), level + 1) if level + 1 < LEVELS else F.lit(None).cast("bigint")
        now = nodes.select(F.lit(level).alias("level"), "file", "offset", parent.alias("parent"), "hash")
        every = every.unionByName(now)
    return every


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, offset, kind) of records that differ: changed, missing (from theirs) or extra.

    Both are written trees. Each level is one join of the differing ranges with their children.
    """
    differing = None
    for level in range(LEVELS - 1, -2, -1):
        sides = []
        for side, name in ((ours, "ours"), (theirs, "theirs")):
            nodes = side.where(F.col("level") == level).select("file", "offset", "parent", F.col("hash").alias(name))
            if differing is not None:
                open_ranges = differing.select("file", F.col("offset").alias("parent"))
                nodes = nodes.join(open_ranges, ["file", "parent"], "left_semi")
            sides.append(nodes.drop("parent"))
        both = sides[0].join(sides[1], ["file", "offset"], "full")
        differing = written(both.where(~F.col("ours").eqNullSafe(F.col("theirs"))), "merkle-differing")
    kind = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("changed")
    return differing.select("file", "offset", kind.alias("kind"))


def packed(records: DataFrame, key: str, length: str, files: int) -> DataFrame:
    """`records` with an address: a file by the key (hex text), and the offset in order of keys.

    Records of one key must be alike and come once. Files are bounded, so their windows are.
    """
    place = F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), F.lit(files))
    before = Window.partitionBy("file").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("file", F.concat(F.lit("part-"), place.cast("string"), F.lit(".warc"))).withColumn(
        "offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("bigint")
    )
