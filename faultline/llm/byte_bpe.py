"""Byte-level BPE encoding and decoding over overlapping chunks.

A text of at most CHUNK characters is one chunk and is encoded where it lies. A longer one is cut
into overlapping chunks, which are pre-tokenised in parallel, each from its own start. Where two
neighbours agree on a pre-token boundary inside their overlap, the later one is in step from there
on, because a match depends only on where it starts and on what follows. Boundaries close to a
chunk's end may be owed to the cut, so the last piece that touches the end is not trusted. The
pieces between the agreed boundaries are then encoded; where neighbours never agree (one pre-token
longer than the overlap, say), the text is read on from the last agreed boundary across the chunk.

Decoding concatenates the tokens' raw bytes. A null text counts as empty and has no tokens. Rows
equal in id and text are encoded separately and both returned. The vocabulary file is read on the
driver and goes to the tasks inside the closure (50,256 ranks, a fixed 1 MB).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.tables import col

CHUNK = 1 << 15  # characters a chunk owns
OVERLAP = 1 << 11  # characters it shares with the next one
GUARD = 8  # pre-tokens that end closer to a cut are not trusted; the pattern looks at most 3 characters ahead
PIECES_KEPT = 1 << 16  # encoded pieces a task remembers


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Coder:
    """Encodes and decodes with given ranks and pattern; made once per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, list[int]] = {}

    def whole(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def piece(self, piece: str) -> list[int]:
        """Ids of one pre-token; the pattern leaves a pre-token in one piece."""
        ids = self.known.get(piece)
        if ids is None:
            ids = self.encoding.encode_ordinary(piece)
            if len(self.known) < PIECES_KEPT and len(piece) < 64:
                self.known[piece] = ids
        return ids

    def ends(self, text: str, last: bool) -> list[int]:
        """Ends of the pre-tokens; without the last of a text, those near the cut are left out."""
        found = [m.end() for m in self.pattern.finditer(text)]
        while not last and found and found[-1] > len(text) - GUARD:
            found.pop()
        return found

    def encoded(self, text: str, start: int, ends: list[int]) -> tuple[list[int], list[int]]:
        """Ids of the pre-tokens of `text` up to each end, and how many each has."""
        ids, counts = [], []
        for end in ends:
            one = self.piece(text[start:end])
            ids += one
            counts.append(len(one))
            start = end
        return ids, counts

    def raw(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@dataclass
class Chunk:
    """A pre-tokenised and encoded stretch of a text: ends of its pieces counted from the text's start."""

    start: int
    text: str
    ends: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


def read_chunk(coder: Coder, start: int, text: str, last: bool) -> Chunk:
    ends = coder.ends(text, last)
    ids, counts = coder.encoded(text, 0, ends)
    return Chunk(start, text, np.asarray(ends, "<i4") + start, np.asarray(counts, "<i4"), np.asarray(ids, "<u4"))


def stitch(coder: Coder, chunks: list[Chunk]) -> np.ndarray:
    """Ids of the text that overlapping chunks, in order, make up."""
    out, at, now, n, more = [], 0, chunks[0], 1, 1
    while True:
        if n == len(chunks):
            meet = now.start + len(now.text)
        else:
            after = chunks[n]
            shared = np.intersect1d(now.ends, np.concatenate((np.asarray([after.start]), after.ends)))
            shared = shared[shared >= max(at, after.start)]
            meet = int(shared[0]) if len(shared) else None
        if meet is None:  # they never agree: read on from here, over twice as many chunks each time
            reach = min(len(chunks), n + more)
            more *= 2
            text = now.text[at - now.start :]
            upto = now.start + len(now.text)
            while n < reach:
                text += chunks[n].text[upto - chunks[n].start :]
                upto = chunks[n].start + len(chunks[n].text)
                n += 1
            now = read_chunk(coder, at, text, n == len(chunks))
            continue
        first, stop = np.searchsorted(now.ends, (at, meet), side="right")
        bounds = np.concatenate(([0], np.cumsum(now.counts)))
        out.append(now.ids[bounds[first] : bounds[stop]])
        at = meet
        if n == len(chunks):
            return np.concatenate(out)
        now, n, more = chunks[n], n + 1, 1


ENCODED = "id string, n_tokens bigint, ids binary"


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per document: id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    # ids pass through Python as text: a batch with nulls would make floats of integers
    rows = docs.select(col(id_col).cast("string").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(ranks, pattern)
        for batch in batches:
            ids = [np.asarray(coder.whole(text), "<u4") for text in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]})

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(ranks, pattern)
        for batch in batches:
            done = [read_chunk(coder, *row) for row in zip(batch["start"], batch["text"], batch["last"])]
            yield batch[["row_no", "id", "start", "text"]].assign(
                ends=[x.ends.tobytes() for x in done],
                counts=[x.counts.tobytes() for x in done],
                ids=[x.ids.tobytes() for x in done],
            )

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        parts = [
            Chunk(start, text, np.frombuffer(ends, "<i4"), np.frombuffer(counts, "<i4"), np.frombuffer(ids, "<u4"))
            for start, text, ends, counts, ids in zip(*(group[x] for x in ("start", "text", "ends", "counts", "ids")))
        ]
        ids = stitch(Coder(ranks, pattern), parts)
        return pd.DataFrame({"id": group["id"].iloc[:1], "n_tokens": [len(ids)], "ids": [ids.tobytes()]})

    size = F.length("text")
    near = rows.where(size <= chunk).mapInPandas(short, ENCODED)
    starts = F.sequence(F.lit(0), size - 1, F.lit(chunk))
    cut = (
        rows.where(size > chunk)
        .withColumn("row_no", F.monotonically_increasing_id())
        .select("row_no", "id", "text", F.explode(starts).alias("start"))
        .where(F.col("start") + overlap < size)  # what starts later lies within the chunk before
        .select(
            "row_no",
            "id",
            "start",
            F.substring("text", F.col("start") + 1, F.lit(chunk + overlap)).alias("text"),
            (F.col("start") + chunk + overlap >= size).alias("last"),
        )
    )
    pieces = cut.repartition("row_no", "start").mapInPandas(
        chunked, "row_no bigint, id string, start int, text string, ends binary, counts binary, ids binary"
    )
    far = pieces.groupBy("row_no").applyInPandas(joined, ENCODED)
    whole = near.unionByName(far)
    return whole.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_tokens", "ids")


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """`encoded` with a column `raw`: the bytes of its ids, concatenated."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("raw", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([coder.raw(np.frombuffer(x.as_py(), "<u4").tolist()) for x in batch["ids"]], pa.binary())],
                names=[*batch.schema.names, "raw"],
            )

    return encoded.mapInArrow(run, schema)
