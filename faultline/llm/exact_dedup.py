"""Exact dedup by two-pass Bloom filtering.

Pass one counts, in a filter of bounded size, the slots that hashes hit and keeps those hit twice.
Pass two probes every row: a row with an unset bit is certainly alone and passes straight through;
only possibly repeated rows shuffle. Texts are equal when equal after each run of ASCII white
space became one space. A null text counts as empty. Of equal texts the row with the smallest id
stays, null ids last; of rows equal in id and text, one. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import col, filter_bits, fresh, probe, repeated_filter, written

SPACE = r"[\x20\x09-\x0D]+"
LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    The texts are read once; what follows works on a written table of ids and digests.
    """
    slim = written(
        docs.select(
            col(id_col).alias(id_col),
            text_digest(col(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "exact-digests",
    )
    bits = filter_bits(slim.count())
    blocks = written(repeated_filter(slim, "digest", bits), "exact-filter")
    marked = probe(slim, "digest", blocks, bits, "again")
    again = marked.where("again")
    # written, so that the join below has plain shuffles on both sides and hot digests can be split
    groups = written(
        again.groupBy("digest").agg(
            F.min(col(id_col)).alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            F.min_by("row_no", F.coalesce(col(id_col).cast("bigint"), F.lit(LAST))).alias("keep_row"),
        ),
        "exact-groups",
    )
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    alone = marked.where("NOT again").select(
        id_col, col(id_col).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    shared = again.join(groups, "digest").select(
        id_col, "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), sha
    )
    return alone.unionByName(shared)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; only possibly repeated rows move."""
    digest, again, order = fresh(docs, "text_digest", "again", "id_order")
    hashed = docs.withColumn(digest, text_digest(col(text_col)))
    slim = written(hashed.select(col(digest).alias("digest"), col(id_col).cast("bigint").alias("id")), "exact-digests")
    bits = filter_bits(slim.count())
    blocks = written(repeated_filter(slim, "digest", bits), "exact-filter")
    keepers = (
        probe(slim, "digest", blocks, bits, "again")
        .where("again")
        .groupBy("digest")
        .agg(F.min(F.coalesce("id", F.lit(LAST))).alias("keep_order"))
    )
    marked = probe(hashed, digest, blocks, bits, again)
    alone = marked.where(~col(again))
    shared = marked.where(col(again)).withColumn(order, F.coalesce(col(id_col).cast("bigint"), F.lit(LAST)))
    # by digest and id: no key holds many rows but of one id and text, and those fold before the shuffle
    stay = shared.dropDuplicates([digest, order]).join(
        keepers, (col(digest) == keepers["digest"]) & (col(order) == keepers["keep_order"]), "left_semi"
    )
    own = [col(name) for name in docs.columns]
    return alone.select(own).unionByName(stay.select(own))
