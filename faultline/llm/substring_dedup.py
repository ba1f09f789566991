"""Substring dedup with suffix automata of reference shards.

A window is WINDOW consecutive words of one document. Every word covered by a window whose words
also stand elsewhere is removed, judged on the input.

1. Anchors. A window's anchor is the least hash among its runs of ANCHOR words, so equal windows
   have equal anchors. Neighbouring windows of one anchor form a segment. Anchors of one segment
   only can't hold repeats (unless it repeats itself) and are left out, by a bitmap of bounded size.
2. Shards. The other segments are the reference. Equal ones fold into one with a count. A lone
   segment that occurs twice is repeated throughout. All others go, with all segments of their
   anchor, to a shard of bounded size. The reference grows with the corpus, so its automata can't
   be broadcast whole: each shard's automaton is built where its segments meet.
3. Matching statistics. Streaming a segment through its shard's automaton gives at each word the
   longest match that ends there; the state of its last WINDOW words knows how often they occur.
4. An anchor with more than SHARD_SEGMENTS different segments (around a very common passage) does not
   fit a shard; its windows are counted one by one, pre-aggregated, which is exact as well.

Null texts have no words. Rows of equal text share their result, each is returned. Texts shorter
than a window are kept whole. Kept words are joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import BLOCK_BITS, col, filter_bits, probe, repeated_filter, written
from faultline.llm.wordhash import window_hashes, word_hashes

WINDOW = 35
ANCHOR = 14
SHARD_SEGMENTS = 1_000
SHARD_ROWS = 400  # segments a shard has on average


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    done = 1
    out = values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(text: str | None, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, first and last window of each segment; none if the text is shorter than a window."""
    words = word_hashes(text, lower=False)
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none
    least = _least(window_hashes(words, anchor), window - anchor + 1).view(np.int64)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[first], first, np.append(first[1:], len(least)) - 1


def self_repeats(text: str, anchors: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Anchors of windows that the text has twice."""
    whole = window_hashes(word_hashes(text, lower=False), window)
    _, place, count = np.unique(whole, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[place] > 1)
    return np.unique(anchors[np.searchsorted(first, twice, side="right") - 1])


class Automaton:
    """Suffix automaton of a set of word sequences, with how often each state's sequences occur."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.seen = [0]

    def _state(self, size: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        self.seen.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of p's sequences followed by `word`, parted from longer ones."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, times: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new = self._state(self.size[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            self.seen[last] += times

    def close(self) -> None:
        """Add each state's occurrences to those of its suffixes."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.seen[self.link[state]] += self.seen[state]

    def repeated(self, words: list, window: int) -> list[int]:
        """Starts of windows that occur at least twice."""
        state, length, out = 0, 0, []
        for n, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            while self.size[self.link[state]] >= window:
                state = self.link[state]
                length = self.size[state]
            if length >= window and self.seen[state] >= 2:
                out.append(n - window + 1)
        return out


def anchor_counts(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key) once per segment, and once more where a text repeats itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                anchors, first, _ = runs(text, window, anchor)
                out.append(anchors)
                if len(anchors):
                    out.append(self_repeats(text, anchors, first, window))
            yield pd.DataFrame({"key": np.concatenate([np.zeros(0, np.int64), *out])})

    return texts.mapInPandas(run, "key bigint")


def bitmap_of(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits of keys that may occur twice; `bits` bounds it (at most 32 MB)."""
    halves = [F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftright("key", 32).bitwiseAND(F.lit(bits - 1))]
    slots = keys.select(F.explode(F.array(*halves)).alias("slot")).groupBy("slot").count().where("count > 1")
    blocks = slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bitmap")
    )
    out = np.zeros(bits // 8, np.uint8)
    for block, data in blocks.toLocalIterator():
        out[(block - 1) * BLOCK_BITS // 8 : block * BLOCK_BITS // 8] = np.frombuffer(data, np.uint8)
    return out


def segments(texts: DataFrame, bitmap: np.ndarray, bits: int, window: int, anchor: int) -> DataFrame:
    """(name1, name2, start, key, words) of the segments whose anchors may be shared."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value

        def has(slot: np.ndarray) -> np.ndarray:
            return known[slot >> 3] >> (slot & 7).astype(np.uint8) & 1

        for batch in batches:
            out = []
            for name1, name2, text in zip(batch["name1"], batch["name2"], batch["text"]):
                anchors, first, last = runs(text, window, anchor)
                kept = np.flatnonzero(has(anchors & (bits - 1)) & has((anchors >> 32) & (bits - 1)))
                if len(kept):
                    words = text.encode().split()
                    out += [
                        (name1, name2, int(first[n]), int(anchors[n]), b" ".join(words[first[n] : last[n] + window]).decode())
                        for n in kept
                    ]
            yield pd.DataFrame(out, columns=["name1", "name2", "start", "key", "words"])

    found = texts.mapInPandas(run, "name1 bigint, name2 bigint, start int, key bigint, words string")
    return found.withColumn("seg1", F.xxhash64("words")).withColumn("seg2", F.xxhash64(F.lit(1), "words"))


def repeats(found: DataFrame, window: int, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """(seg1, seg2, at): window starts, within each different segment, that occur twice or more."""
    different = written(
        found.groupBy("key", "words", "seg1", "seg2").agg(F.count(F.lit(1)).alias("n")), "substring-segments"
    )
    per_key = different.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    sized = written(different.join(written(per_key, "substring-keys"), "key"), "substring-sized")
    size = F.size(F.split("words", " "))
    starts = F.sequence(F.lit(0), size - window)
    alone = sized.where("kinds = 1 AND n > 1").select("seg1", "seg2", starts.alias("at"))

    fit = sized.where(((F.col("kinds") > 1) | (F.col("n") == 1)) & (F.col("kinds") <= shard_segments))
    shards = max(1, fit.count() // SHARD_ROWS)

    def match(shard: pd.DataFrame) -> pd.DataFrame:
        automaton = Automaton()
        lists = [words.split(" ") for words in shard["words"]]
        for words, times in zip(lists, shard["n"]):
            automaton.add(words, times)
        automaton.close()
        at = [automaton.repeated(words, window) for words in lists]
        return shard[["seg1", "seg2"]].assign(at=at)[[bool(x) for x in at]]

    matched = fit.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards))).applyInPandas(match, "seg1 bigint, seg2 bigint, at array<int>")

    over = sized.where(F.col("kinds") > shard_segments)
    split = F.split("words", " ")
    window_at = lambda i: F.array_join(F.slice(split, i + 1, window), " ")
    each = over.select("seg1", "seg2", "n", F.posexplode(F.transform(starts, window_at)).alias("i", "window"))
    each = each.select("seg1", "seg2", "n", "i", F.xxhash64("window").alias("w1"), F.xxhash64(F.lit(1), "window").alias("w2"))
    often = each.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2")
    counted = (
        each.join(written(often, "substring-windows"), ["w1", "w2"])
        .groupBy("seg1", "seg2")
        .agg(F.collect_list("i").alias("at"))  # within one segment
    )
    return alone.unionByName(matched).unionByName(counted)


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    shard_segments: int = SHARD_SEGMENTS,
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (text)."""
    text = F.coalesce(col(text_col), F.lit(""))
    texts = docs.select(
        col(id_col).cast("string").alias("id"),
        F.xxhash64(text).alias("name1"),
        F.xxhash64(F.lit(1), text).alias("name2"),
        text.alias("text"),
    )
    keys = written(anchor_counts(texts.select("text"), window, anchor), "substring-anchors")
    bits = filter_bits(keys.count())
    bitmap = bitmap_of(keys, bits)
    found = written(segments(texts.select("name1", "name2", "text"), bitmap, bits, window, anchor), "substring-found")
    at = written(repeats(found, window, shard_segments), "substring-repeats")
    # rows of equal text have the same segments at the same places
    places = found.select("name1", "name2", "start", "seg1", "seg2").distinct().join(at, ["seg1", "seg2"])
    hit = places.groupBy("name1", "name2").agg(
        F.flatten(F.collect_list(F.transform("at", lambda i: i + F.col("start")))).alias("at")  # of one text
    )
    hit = written(hit, "substring-hits")
    bits = filter_bits(hit.count())
    blocks = written(repeated_filter(hit, "name1", bits, 1), "substring-filter")
    marked = probe(texts, "name1", blocks, bits, "marked")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, at in zip(batch["text"], batch["at"]):
                words = text.encode().split()
                total = len(words)
                if at is not None and len(at):
                    edges = np.zeros(total + 1, np.int32)
                    np.add.at(edges, np.asarray(at), 1)
                    np.add.at(edges, np.asarray(at) + window, -1)
                    words = [words[n] for n in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                out.append((total, total - len(words), b" ".join(words).decode()))
            yield pd.DataFrame(
                {"id": batch["id"], "n_words": [x[0] for x in out], "n_removed": [x[1] for x in out], "kept": [x[2] for x in out]}
            )

    # only texts with repeats, and a few taken for such, move
    moved = marked.where("marked").join(hit, ["name1", "name2"], "left").select("id", "text", "at")
    still = marked.where("NOT marked").select("id", "text", F.lit(None).cast("array<int>").alias("at"))
    done = still.unionByName(moved).mapInPandas(cut, "id string, n_words bigint, n_removed bigint, kept string")
    return done.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept")
