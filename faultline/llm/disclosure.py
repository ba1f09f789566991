"""Information-theoretic sanitisation of personal data.

Base spans (e-mail, IP, card, phone) are protected entities, told apart by value. Terms are the
words up to WINDOW words from such a span. Over the whole corpus, n(c, t) documents have term t near
entity c, n(c) have c and n(t) have t anywhere. How much of c a term gives away is its pointwise
mutual information over c's own information:

    disclosure(c, t) = log(n(c, t) * N / (n(c) * n(t))) / log(N / n(c))

1 means that the term names the entity, 0 that it says nothing. Pairs seen in fewer than CONTEXTS
different surroundings are no evidence (a rare word that once stood beside an address). Terms of at
least GENERALISE are replaced by a placeholder where they stand near that entity, those of at
least REMOVE are removed; base spans always are replaced by their kind.

Null texts count as empty and have no spans. Rows alike in id and text share their spans; each is
returned. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import BLOCK_BITS, col, written
from faultline.llm.toxicity import words_of

KINDS = ("email", "ip", "card", "phone", "general", "remove")
WINDOW = 6  # words on each side
REACH = 160  # characters on each side in which they are looked for
CONTEXTS = 3
GENERALISE = 0.8
REMOVE = 0.95
LEAST_LETTERS = 4
FILTER_BITS = 1 << 24

# The contract's patterns, rewritten so that no run of characters is read from each of its places.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
# the same words as words_of splits off
TERM = re.compile("[A-Za-zÀ-῿⁀-\U0010ffff]+")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for n, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + n % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order: leftmost matches of each kind that hold, without retries."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(map(small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= len(digits := DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(DIGITS.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def near_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, bool]]:
    """(entity, term, start, end, context, first): terms around each span, outside all spans."""
    covered = [(a, b) for a, _, b in spans]
    out, seen = [], set()
    for start, kind, end in spans:
        value = text[start:end].lower() if kind < 2 else DIGITS.sub("", text[start:end])
        entity = _hash(f"{kind}:{value}".encode())
        low, high = max(0, start - REACH), min(len(text), end + REACH)
        before = [m for m in TERM.finditer(text, low, start) if m.start() > low or low == 0][-WINDOW:]
        after = [m for m in TERM.finditer(text, end, high) if m.end() < high or high == len(text)][:WINDOW]
        words = [(m.start(), m.end(), m[0].lower().encode()) for m in before + after]
        context = _hash(b" ".join(word for _, _, word in words))
        for a, b, word in words:
            if b - a < LEAST_LETTERS or any(a < y and x < b for x, y in covered):
                continue
            term = _hash(word)
            out.append((entity, term, a, b, context, (entity, term) not in seen))
            seen.add((entity, term))
    return out


SPAN = "struct<start:int,kind:int,end:int>"
NEAR = "struct<entity:bigint,term:bigint,start:int,end:int,context:bigint,first:boolean>"


def found_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(name1, name2, id, base, near) per document, from its whole text."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(
        F.xxhash64(col(id_col), text).alias("name1"),
        F.xxhash64(text, F.lit(1), col(id_col)).alias("name2"),
        col(id_col).cast("string").alias("id"),
        text.alias("text"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base = [base_spans(text) for text in batch["text"]]
            near = [near_terms(text, spans) if spans else [] for text, spans in zip(batch["text"], base)]
            yield batch[["name1", "name2", "id"]].assign(base=base, near=near)

    return rows.mapInPandas(run, f"name1 bigint, name2 bigint, id string, base array<{SPAN}>, near array<{NEAR}>")


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(term, n_t): documents that have each of the terms.

    A bitmap of the wanted terms, of bounded size, spares sending on most others; counts are exact,
    because what else it lets through is joined away.
    """
    slot = (F.col("term").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1).alias("slot")
    blocks = (
        terms.select(slot)
        .groupBy(F.bitmap_bucket_number("slot").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
    )
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)  # 2 MB, however many terms
    for block, data in blocks.collect():
        bitmap[(block - 1) * BLOCK_BITS // 8 : block * BLOCK_BITS // 8] = np.frombuffer(data, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            counts = Counter()
            for text in batch["text"]:
                for word in words_of(text):
                    h = _hash(word)
                    at = h & (FILTER_BITS - 1)
                    if known[at >> 3] >> (at & 7) & 1:
                        counts[h] += 1
            yield pd.DataFrame({"term": list(counts), "n": list(counts.values())}, dtype="int64")

    found = docs.select(col(text_col).alias("text")).mapInPandas(run, "term bigint, n bigint")
    return found.groupBy("term").agg(F.sum("n").alias("n_t")).join(terms, "term", "left_semi")


def disclosing(docs: DataFrame, found: DataFrame, text_col: str, contexts: int = CONTEXTS) -> DataFrame:
    """(entity, term, disclosure) of pairs at or above GENERALISE."""
    total = found.count()
    near = found.select(F.explode("near").alias("x")).select("x.*")
    pairs = (
        near.groupBy("entity", "term", "context")
        .agg(F.sum(F.col("first").cast("int")).alias("docs"))
        .groupBy("entity", "term")
        .agg(F.count(F.lit(1)).alias("contexts"), F.sum("docs").alias("n_ct"))
        .where(F.col("contexts") >= contexts)
    )
    pairs = written(pairs, "pii-pairs")
    # one row per document and entity: the first of its terms stands for it
    n_c = (
        found.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("n_c"))
    )
    n_t = term_counts(docs, pairs.select("term").distinct(), text_col)
    n = F.lit(float(max(total, 1)))
    own = F.log2(n / F.col("n_c"))
    both = F.log2(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t")))
    scored = pairs.join(n_c, "entity").join(n_t, "term").withColumn("disclosure", F.when(own > 0, both / own))
    return scored.where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contexts: int = CONTEXTS) -> DataFrame:
    """One row per document: id, name1, name2, base and more, arrays of (start, kind, end) in order."""
    found = written(found_spans(docs, id_col, text_col), "pii-found")
    reveals = written(disclosing(docs, found, text_col, contexts), "pii-terms")
    near = found.where(F.size("near") > 0).select("name1", "name2", F.explode("near").alias("x")).select("name1", "name2", "x.*")
    kind = F.max(F.when(F.col("disclosure") >= REMOVE, F.lit(5)).otherwise(F.lit(4))).alias("kind")
    more = (
        near.join(reveals, ["entity", "term"])
        .groupBy("name1", "name2", "start", "end")
        .agg(kind)
        .groupBy("name1", "name2")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("more"))  # a text's own terms
    )
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return found.join(written(more, "pii-more"), ["name1", "name2"], "left").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        "name1",
        "name2",
        "base",
        F.coalesce("more", none).alias("more"),
    )


def replaced(text: str, found: list) -> str:
    """The text with its spans replaced by their kinds; removed terms leave nothing."""
    out, done = [], 0
    for start, kind, end in sorted((s["start"], s["kind"], s["end"]) for s in found):
        if start < done:  # spans of two kinds may overlap: the first one's mark stands for both
            done = max(done, end)
            continue
        out += [text[done:start], "" if KINDS[kind] == "remove" else f"[{KINDS[kind].upper()}]"]
        done = end
    return "".join(out) + text[done:]


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contexts: int = CONTEXTS) -> DataFrame:
    """(id, text) with base spans and disclosing terms replaced."""
    text = F.coalesce(col(text_col), F.lit(""))
    found = spans(docs, id_col, text_col, contexts).select("name1", "name2", F.concat("base", "more").alias("spans"))
    rows = docs.select(
        col(id_col).alias("own_id"),
        text.alias("own_text"),
        F.xxhash64(col(id_col), text).alias("name1"),
        F.xxhash64(text, F.lit(1), col(id_col)).alias("name2"),
    )
    hit = found.where(F.size("spans") > 0).dropDuplicates(["name1", "name2"])
    both = rows.join(written(hit, "pii-spans"), ["name1", "name2"], "left")

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in parts:
            yield pd.Series([t if s is None else replaced(t, list(s)) for t, s in zip(texts, found)], dtype=object)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    clean = F.pandas_udf(run, "string")(F.col("own_text"), F.col("spans"))
    return both.select(F.col("own_id").alias(id_col), clean.alias(text_col))
