"""A stored index of words in blocks of documents, and exact ranked search that skips what cannot rank.

A chunk belongs to one block, by its document. The index has one row per (word, chunk) with its
count and block, and one row per chunk without a word. It is tokenised once, however many searches
follow; an index for given queries holds their words only.

What a word adds to a score in a block is at most its weight times its highest term there. Words are
read from the rarest on, and the kth of the sums so far is a floor for what can be a result. Once the
words that are left can no longer lift a new document to the floor, they are looked up only in
documents found before, and these are dropped as soon as they cannot reach it either: the common
words, which make up most postings, meet few documents. Scores are sums of non-negative terms, so
the result is the one that scoring everything gives. Blocks are searched side by side and pass on
their own k best.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import words
from faultline.plans.slices import kept, settled

CHUNK = ("content_id", "chunk_index")
QUERY_BLOCK = 4_096  # queries that meet a block in one task
BLOCK_CHUNKS = 32_768  # chunks of a block, unless their number is given
TASK_CHUNKS = 65_536  # chunks whose words one task counts
DIGITS = 6
MARGIN = 2e-6  # scores are ranked as rounded
FOUND = "query_id bigint, content_id bigint, chunk_index bigint, score double, scored bigint"


@dataclass(frozen=True)
class PostingIndex:
    """`postings`: block, content_id, chunk_index, size, term, tf."""

    postings: DataFrame
    chunks: int
    mean_size: float
    blocks: int
    k1: float
    b: float

    def weight(self) -> Column:
        return F.ln(F.lit(1.0) + (F.lit(self.chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def impact(self) -> Column:
        """What a posting adds to a score, before its word's weight."""
        norm = self.k1 * (1 - self.b + self.b * F.col("size") / (self.mean_size or 1.0))
        return F.col("tf") * (self.k1 + 1) / (F.col("tf") + norm)


def asked_words(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct words of (query_id, query)."""
    return queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows of equal keys in one task, over at least `tasks` tasks."""
    return df.repartition(tasks, *keys) if tasks > _partitions(df) else df.repartition(*keys)


def build_index(
    chunks: DataFrame, k1: float = 1.2, b: float = 0.75, blocks: int | None = None, path: str | None = None, only: DataFrame | None = None
) -> PostingIndex:
    """Store the words of chunks (content_id, chunk_index, chunk_text) under `path`; only those in `only` (term), if given.

    There are as many blocks as shuffle partitions, and more where a block would exceed
    BLOCK_CHUNKS, unless `blocks` says otherwise.
    """
    number = chunks.count()
    blocks = blocks or max(_partitions(chunks), -(-number // BLOCK_CHUNKS))
    # settled: a constant chunk number would not count as a key that the rows lie by
    sized = settled(chunks.select(*CHUNK, words(F.coalesce("chunk_text", F.lit(""))).alias("w")))
    sized = dealt(sized, -(-number // TASK_CHUNKS), *CHUNK)
    marked = F.concat(F.array(F.lit("")), F.col("w"))  # no word is empty
    rows = sized.select(*CHUNK, F.size("w").alias("size"), F.explode(marked).alias("term"))
    # chunks lie together, so that their words are counted without another shuffle
    counted = rows.groupBy(*CHUNK, "size", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    if only is not None:
        blank = only.sparkSession.range(1).select(F.lit("").alias("term"))
        counted = counted.join(kept(only.select("term").unionByName(blank).distinct()), "term", "left_semi")
        counted = counted.select(*CHUNK, "size", "term", "tf")
    placed = counted.withColumn("block", F.pmod(F.xxhash64("content_id"), F.lit(blocks)))
    if path is None:
        return open_index(kept(placed), blocks, k1, b)
    placed.repartition("block").sortWithinPartitions("block", "term").write.parquet(path)
    return open_index(chunks.sparkSession.read.schema(placed.schema).parquet(path), blocks, k1, b)


def open_index(stored: DataFrame, blocks: int, k1: float = 1.2, b: float = 0.75) -> PostingIndex:
    """An index from its stored rows."""
    whole = stored.where("term = ''").agg(F.count(F.lit(1)), F.avg("size")).first()
    return PostingIndex(stored.where("term <> ''"), whole[0], whole[1] or 0.0, blocks, k1, b)


def block_score(postings: pd.DataFrame, asking: pd.DataFrame, k: int) -> pd.DataFrame:
    """The `k` best chunks of a block for every query that visits it.

    `postings` has number, content_id, chunk_index, impact; `asking` has query_id, number, idf.
    `scored` counts the block's chunks of which a query saw all words it shares with them.
    """
    numbers, impacts = postings["number"].to_numpy(), postings["impact"].to_numpy()
    pairs = postings[list(CHUNK)].to_numpy(np.int64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    fresh = np.append(True, (pairs[order][1:] != pairs[order][:-1]).any(1))[: len(order)]
    chunk, code = pairs[order][fresh], np.empty(len(order), np.int64)
    code[order] = np.cumsum(fresh) - 1
    order = np.lexsort((code, numbers))
    numbers, docs, impacts = numbers[order], code[order], impacts[order]
    out = []
    asking = asking.sort_values("query_id", kind="stable")
    ids, words_of, weights = (asking[name].to_numpy() for name in ("query_id", "number", "idf"))
    # every query's stretch of words, and every word's stretch of postings
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, int)
    lows, highs = np.searchsorted(numbers, words_of), np.searchsorted(numbers, words_of, side="right")
    tops = np.zeros(len(numbers) + 1)
    if len(numbers):
        heads = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
        tops[heads] = np.maximum.reduceat(impacts, heads)
    most_of = np.where(lows < highs, weights * tops[lows], 0.0)
    for start, stop in zip(starts, [*starts[1:], len(ids)]):
        query, idf, first, last, most = ids[start], weights[start:stop], lows[start:stop], highs[start:stop], most_of[start:stop]
        rare = np.argsort(last - first, kind="stable")
        rest = np.append(np.cumsum(most[rare][::-1])[::-1][1:], 0.0)  # what the words after each can add
        part, found, floor = np.zeros(len(chunk)), None, -np.inf
        for n, left in zip(rare, rest):
            x, y = first[n], last[n]
            if found is None:
                part[docs[x:y]] += idf[n] * impacts[x:y]
                if np.count_nonzero(part) >= k:
                    floor = max(floor, np.partition(part, len(part) - k)[len(part) - k] - MARGIN)
                if left < floor or not left:
                    found = np.flatnonzero((part > 0) & (part + left >= floor))
                continue
            at = x + np.searchsorted(docs[x:y], found)
            hit = at < y
            hit[hit] = docs[at[hit]] == found[hit]
            part[found[hit]] += idf[n] * impacts[at[hit]]
            found = found[part[found] + left >= floor]
        score = np.round(part[found], DIGITS)
        top = np.lexsort((*chunk[found].T[::-1], -score))[:k]
        out.append((np.full(len(top), query), *chunk[found[top]].T, score[top], np.full(len(top), len(found))))
    columns = ["query_id", *CHUNK, "score", "scored"]
    return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out))))) if out else pd.DataFrame(columns=columns)


def ranked(index: PostingIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, score, chunk, scored) of the `k` best chunks per (query_id, query).

    `scored` counts the chunks of the result's block that were scored in full for the query.
    """
    asked = asked_words(queries)
    known = kept(asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    used = index.postings.join(known, "term").select("block", "number", *CHUNK, index.impact().alias("impact"))
    seen = used.groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    wanted = kept(asked.join(known, "term").join(seen, "number").select("query_id", "number", index.weight().alias("idf")))
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    # blocks of postings and blocks of queries; with few thousand queries no posting is copied
    rows = used.withColumn("by", every(q_blocks)) if q_blocks > 1 else used.withColumn("by", F.lit(0).cast("bigint"))
    asking = wanted.withColumn("by", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))).withColumn("block", every(index.blocks))
    keys = ("block", "by")
    if index.blocks * q_blocks > _partitions(queries):
        # a few blocks a task, however many there are
        rows, asking = (part.repartition(index.blocks * q_blocks, *keys) for part in (rows, asking))
    found = rows.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(lambda ours, theirs: block_score(ours, theirs, k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), *CHUNK)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
