"""Alignment of two tokenizers' tokens over the bytes that both cut.

A is a byte-level BPE of the tokenizers library and reads space + text; B is a sentencepiece model,
which adds that space itself. Where a token of each ends at one byte offset, a group ends; the two
tokens that end there are linked (every token has at least one byte, so that is one pair).

The end offsets are compared along a diagonal: at the current shift between the two indices,
a few ends and then slices of 8, 16, 32, ... are compared until one differs, and halving finds where. The
stretch before is one token to one. The irregular group behind it is walked through token by
token, up to the next common end, and gives the shift for the next stretch.

How often an id pair is linked is counted over all documents. Of two linked tokens the shorter is
a suffix of the longer, so the vocabularies alone bound the pairs (`pair_keys` lists them all,
about half a million for the supplied ones). Tasks count in an array of that length and pass on
what is not zero; the summed counts are the only thing that reaches the driver and goes out again.

A long text is cut where one space stands between word characters: A's pre-tokens begin with such
a space, and no piece of B has a space behind other characters (a B with such pieces reads texts
whole). So a tokenizer holds a bounded part of a text, unless it has no such space. Where A merges
in the order of its ids, texts in settled scripts are encoded by them as ranks, which gives the same
tokens in a fraction of the time. Texts that are null, empty, or whose A or B tokens do not
spell space + text have no tokens. Special tokens' strings are plain text. Rows alike are aligned
and counted one by one; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import col, written

CHUNK = 1 << 16  # characters a tokenizer reads at once
NEAR = 8  # ends compared one by one before the probes begin
# what a byte-level pre-tokenizer splits by, a fixed value of that format
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# blocks whose letters and digits no newer version of Unicode adds to: all libraries split them alike
SETTLED = re.compile("[\0-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u20ac]*")
BREAK = re.compile(r"(?<=\w) (?=\w)")
ALIGNED = "id string, n_a bigint, n_b bigint, n_groups bigint, groups string, links binary"


def byte_of_sign() -> dict[str, int]:
    """The signs that stand for bytes in a byte-level vocabulary: printable bytes stand for
    themselves, all others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def cut(text: str, size: int) -> list[str]:
    """The text in pieces of about `size` characters, each but the first without the space before it."""
    out, start = [], 0
    while len(text) - start > size:
        found = BREAK.search(text, start + size)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.end()
    return [*out, text[start:]]


def in_rank_order(a_json: str) -> bool:
    """Whether A merges by ascending id, within pre-tokens of PATTERN: then the ids are ranks as well."""
    made = json.loads(a_json)
    model, split = made["model"], made["pre_tokenizer"] or {}
    ids = [model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
    plain = made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    return bool(plain and model["type"] == "BPE" and not model.get("ignore_merges") and all(x < y for x, y in zip(ids, ids[1:])) and min(ids) >= 256)


class Entries:
    """A vocabulary's tokens as bytes end to end, and their ids as text: `inner` within a group, `last` at its end."""

    SLICE = 1 << 16  # tokens spelled at once

    def __init__(self, tokens: list[bytes], end: str):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.inner, self.last = [np.array([f"{n}{mark}" for n in range(len(tokens))], "S") for mark in (",", end)]

    def spell(self, ids: np.ndarray, want: bytes) -> bool:
        """Whether the tokens' bytes are those wanted."""
        at = 0
        for low in range(0, len(ids), self.SLICE):
            part = ids[low : low + self.SLICE]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            made = self.flat[np.repeat(self.starts[part] + sizes - ends, sizes) + np.arange(ends[-1])].tobytes()
            if want[at : at + len(made)] != made:
                return False
            at += len(made)
        return at == len(want)


class Pair:
    """Both tokenizers with the bytes of all their tokens; made once per Python worker."""

    made: dict[str, Pair] = {}

    def __init__(self, a_json: str, b_model: bytes):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        sign = byte_of_sign()
        entries = self.a.get_vocab(with_added_tokens=True)
        in_model = set(self.a.get_vocab(with_added_tokens=False).values())
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, n in entries.items():
            self.a_bytes[n] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(n) else piece.replace("▁", " ").encode() for n, piece in enumerate(pieces)
        ]
        # a piece with a space behind other characters could reach across a cut
        self.cuttable = not any("▁" in piece.lstrip("▁") for piece in pieces)
        self.ranked = None  # the same A in a faster library
        if in_rank_order(a_json):
            ranks = {token: n for n, token in enumerate(self.a_bytes) if n in in_model}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.entries = Entries(self.a_bytes, "|"), Entries(self.b_bytes, ";")

    @classmethod
    def of(cls, a_json: str, b_model: bytes) -> Pair:
        key = hashlib.sha256(a_json.encode() + b_model).hexdigest()
        if key not in cls.made:
            cls.made[key] = cls(a_json, b_model)
        return cls.made[key]

    def a_tokens(self, text: str) -> list[int]:
        if self.ranked and SETTLED.fullmatch(text):
            return self.ranked.encode_ordinary(text)
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def arrays(self, text: str, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B, empty where either does not spell space + text."""
        a_ids, b_ids = [], []
        if text:
            for part in cut(text, chunk) if self.cuttable else [text]:
                a_ids += self.a_tokens(" " + part)
                b_ids += self.b.encode(part, num_threads=1)  # B adds the space
        found = np.asarray(a_ids, np.int64), np.asarray(b_ids, np.int64)
        want = b" " + text.encode()
        if all(entries.spell(ids, want) for entries, ids in zip(self.entries, found)):
            return found
        return found[0][:0], found[1][:0]

    def tokens(self, text: str, chunk: int) -> tuple[list[int], list[int]]:
        a_ids, b_ids = self.arrays(text, chunk)
        return a_ids.tolist(), b_ids.tolist()


def pair_keys(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.ndarray:
    """All id pairs that can be linked, as sorted numbers a << 32 | b: one's bytes end the other's."""
    by_a, by_b = {}, {}
    for table, of in ((a_bytes, by_a), (b_bytes, by_b)):
        for n, token in enumerate(table):
            if token:
                of.setdefault(token, []).append(n)
    keys = set()
    for token, own in by_a.items():
        for at in range(len(token)):
            keys.update(a << 32 | b for b in by_b.get(token[at:], ()) for a in own)
    for token, own in by_b.items():
        for at in range(1, len(token)):
            keys.update(a << 32 | b for a in by_a.get(token[at:], ()) for b in own)
    return np.fromiter(sorted(keys), np.int64, len(keys))


class Places:
    """Places of numbers in sorted `keys`: by a hash table, and by search where two keys share a slot."""

    BITS, FACTOR = 21, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.keys, self.table = keys, np.zeros(1 << self.BITS, np.int32)
        self.table[self.slots(keys)] = np.arange(len(keys), dtype=np.int32)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers.astype(np.uint64) * self.FACTOR) >> np.uint64(64 - self.BITS)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each number, all of which are among the keys."""
        found = self.table[self.slots(numbers)]
        other = np.flatnonzero(self.keys[found] != numbers)
        found[other] = np.searchsorted(self.keys, numbers[other])
        return found


def runs(a: list[int], b: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Stretches of one token to one, each with the irregular group behind it: (i, j, length, x, y).

    Tokens i, i + 1, ... of A face j, j + 1, ... of B, `length` of them; the group holds A's tokens up
    to x and B's up to y, none behind the last stretch. Both lists of ends ascend and end alike.
    """
    i = j = 0
    size, out = len(a), []
    while i < size:
        run = 0
        if a[i] == b[j]:  # probe the diagonal
            run, step, limit = 1, NEAR, min(size - i, len(b) - j)
            near = min(NEAR, limit)
            while run < near and a[i + run] == b[j + run]:
                run += 1
            if run == near:
                while run < limit:
                    upto = min(run + step, limit)
                    if a[i + run : i + upto] == b[j + run : j + upto]:
                        run, step = upto, 2 * step
                        continue
                    while upto - run > 1:  # the first difference lies in here
                        half = (run + upto) // 2
                        if a[i + run : i + half] == b[j + run : j + half]:
                            run = half
                        else:
                            upto = half
                    break
        x, y = i + run, j + run
        if x < size:
            p, q = a[x], b[y]
            while p != q:  # an irregular group: whichever ends first goes on
                if p < q:
                    x += 1
                    p = a[x]
                else:
                    y += 1
                    q = b[y]
            x, y = x + 1, y + 1  # the new shift
        out.append((i, j, run, x, y))
        i, j = x, y
    return out


def align(pair: Pair, text: str, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and B, and the places of the tokens of each that end at every common end."""
    ids = pair.arrays(text, chunk)
    return *ids, *lasts(runs(*(np.cumsum(entries.sizes[own]).tolist() for entries, own in zip(pair.entries, ids))))


def lasts(found: list[tuple[int, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The places of A's and B's tokens that end at every common end of the stretches."""
    i, j, run, x, y = np.fromiter(chain.from_iterable(found), np.int64, 5 * len(found)).reshape(-1, 5).T
    behind = x > i + run
    ends = np.cumsum(run + behind)
    start = ends - run - behind
    out = []
    for first, after in ((i, x), (j, y)):
        places = np.repeat(first - start, run + behind) + np.arange(ends[-1] if len(ends) else 0)
        places[ends[behind] - 1] = after[behind] - 1
        out.append(places)
    return out[0], out[1]


def listed(pair: Pair, a_ids: np.ndarray, b_ids: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
    """The groups as text: a1,a2|b1;a3|b2,b3."""
    if not len(last_a):
        return ""
    a, b = pair.entries
    # a group's tokens of A stand behind the earlier groups' of B, its tokens of B behind its own of A
    at_a = np.arange(len(a_ids)) + np.repeat(np.concatenate(([0], last_b[:-1] + 1)), np.diff(last_a, prepend=-1))
    at_b = np.arange(len(b_ids)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
    cells = np.empty(len(a_ids) + len(b_ids), max(a.last.dtype, b.last.dtype))
    for entries, ids, at, last in ((a, a_ids, at_a, last_a), (b, b_ids, at_b, last_b)):
        cells[at] = entries.inner[ids]
        cells[at[last]] = entries.last[ids[last]]
    return cells.tobytes().translate(None, b"\0")[:-1].decode()  # shorter numbers are filled up with zero bytes


def aligned(
    docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> tuple[DataFrame, np.ndarray]:
    """One row per document (id as text, n_a, n_b, n_groups, groups, links), and the pairs that links number.

    `links` holds a little-endian unsigned 32-bit place in the pairs for each link, in order.
    """
    own = Pair.of(a_json, b_model)
    keys = pair_keys(own.a_bytes, own.b_bytes)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((a_json, b_model, keys))  # vocabularies and their pairs, a fixed size
    rows = docs.select(col(id_col).cast("string").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_json, b_model, keys = shared.value
        pair, places = Pair.of(a_json, b_model), Places(keys)
        for batch in batches:
            out = []
            for name, text in zip(batch["id"], batch["text"]):
                a_ids, b_ids, last_a, last_b = align(pair, text, chunk)
                links = places.of(a_ids[last_a] << 32 | b_ids[last_b]).astype("<u4")
                groups = listed(pair, a_ids, b_ids, last_a, last_b)
                out.append((name, len(a_ids), len(b_ids), len(links), groups, links.tobytes()))
            yield pd.DataFrame(out, columns=["id", "n_a", "n_b", "n_groups", "groups", "links"])

    return rows.mapInPandas(run, ALIGNED), keys


def link_counts(found: DataFrame, pairs: int) -> np.ndarray:
    """How often each pair is linked in all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(pairs, np.int64)
        for batch in batches:
            every = np.frombuffer(b"".join(batch["links"]), "<u4")
            counts += np.bincount(every, minlength=pairs)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"pair": at, "n": counts[at]})

    summed = found.select("links").mapInPandas(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    summed = summed.toPandas()  # at most one row per possible pair of the vocabularies
    out = np.zeros(pairs, np.int64)
    out[summed["pair"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return out


def with_link_counts(found: DataFrame, keys: np.ndarray) -> DataFrame:
    """`found`, which is read twice, with n_links, n_best and count_sum instead of links."""
    counts = link_counts(found, len(keys))
    b_ids = keys & 0xFFFFFFFF
    highest = np.zeros(int(b_ids.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b_ids, counts)
    shared = found.sparkSession.sparkContext.broadcast((counts, (counts == highest[b_ids]) & (counts > 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, best = shared.value
        for batch in batches:
            links = [np.frombuffer(x, "<u4") for x in batch.pop("links")]
            yield batch.assign(n_links=list(map(len, links)), n_best=[int(best[x].sum()) for x in links], count_sum=[int(counts[x].sum()) for x in links])

    rest = [field for field in found.schema if field.name != "links"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["n_links bigint, n_best bigint, count_sum bigint"])
    return found.mapInPandas(run, schema)


def statistics(docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 ('' without tokens)."""
    found, keys = aligned(docs, a_json, b_model, id_col, text_col, chunk)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    found = written(found.select("id", "n_a", "n_b", "n_groups", digest, "links"), "token-alignment")
    return with_link_counts(found, keys).select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
