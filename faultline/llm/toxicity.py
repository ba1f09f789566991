"""Toxicity by a counterfactual-regularised linear classifier.

A text's features are its distinct words and their first bytes (PREFIXES long). Features whose
share of toxic and of other labelled texts differs clearly (a log-likelihood ratio above CLEAR) are
kept, and a logistic model with a ridge term is fitted on them. Its loss has one more term: in every
labelled text that names a group of people, the identity terms are swapped for others of the same
list, neutral ones among them, and the squared change of the score is penalised. So the model can't
lean on which group is named, or on a group being named. Identity terms have no prefix features,
so what is learned about a group's name stays with its word.

Fitted on a bounded sample of labelled rows (`rows` of each label, by a hash of the id), of which
the driver gets hashed features only. Every text is scored whole. A null or empty text has no
features and gets the intercept's score. Ids labelled twice count as toxic if any label says so;
null labels and labels of unknown documents are left out; of documents with equal ids one serves.
With no labelled rows of one of the labels all scores are the share of toxic rows (0 without rows).
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import col, written

# Identity terms: fixed values. Terms of one list may stand for each other; each has a neutral one.
IDENTITIES = {
    "en people": "people muslims christians jews hindus buddhists atheists immigrants refugees women men gays "
    "lesbians africans asians europeans americans mexicans arabs".split(),
    "en kind": "human muslim christian jewish hindu buddhist atheist immigrant refugee female male gay lesbian "
    "straight transgender black white african asian european american mexican arab disabled deaf blind".split(),
    "en person": "person woman man girl boy".split(),
    "de": "menschen muslime christen juden hindus frauen männer schwule lesben afrikaner asiaten türken".split(),
    "fr": "personnes musulmans chrétiens juifs femmes hommes homosexuels lesbiennes africains asiatiques".split(),
    "es": "personas musulmanes cristianos judíos mujeres hombres homosexuales lesbianas africanos asiáticos".split(),
}
PREFIXES = (4, 5, 6)
SAMPLE = 5_000  # labelled rows of each label
MOST_FEATURES = 4_096
CLEAR = 14.0  # about one feature in 5,000 passes by chance; the ridge term keeps such ones small
BITS = 20
# ASCII other than letters, and the punctuation of Latin-1 and of the general block, part words
PARTS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
MARKS = re.compile(rb"\xc2[\x80-\xbf]|\xe2\x80[\x80-\xbf]")
TERMS = {group: [term.encode() for term in terms] for group, terms in IDENTITIES.items()}
GROUP_OF = {term: group for group, terms in TERMS.items() for term in terms}


def words_of(text: str | None) -> set[bytes]:
    """Distinct lower-case words, as UTF-8: byte strings are split several times faster."""
    data = (text or "").lower().encode()
    if b"\xc2" in data or b"\xe2\x80" in data:
        data = MARKS.sub(b" ", data)
    return set(data.translate(PARTS).split())


def swapped(words: set[bytes], turn: int) -> set[bytes] | None:
    """The words with every identity term moved on in its list; None if there is none."""
    named = [word for word in words if word in GROUP_OF]
    if not named:
        return None
    out = words.difference(named)
    for word in named:
        terms = TERMS[GROUP_OF[word]]
        out.add(terms[(terms.index(word) + 1 + turn % (len(terms) - 1)) % len(terms)])
    return out


def features(words: set[bytes]) -> set[bytes]:
    """Words, and `4head`-like prefix features."""
    found = set(words)
    plain = words - GROUP_OF.keys()
    for size in PREFIXES:
        found.update(b"%d%s" % (size, head) for head in {word[:size] for word in plain if len(word) > size})
    return found


def _hash(feature: bytes) -> int:
    return zlib.crc32(feature) & ((1 << BITS) - 1)


def hashed(found: set[bytes]) -> np.ndarray:
    return np.unique(np.fromiter(map(_hash, found), "<i4", len(found)))


@dataclass
class Model:
    """Weights of words and of prefixes by their length."""

    intercept: float = -30.0
    words: dict[bytes, float] = field(default_factory=dict)
    heads: dict[int, dict[bytes, float]] = field(default_factory=dict)
    stems: set[bytes] = field(default_factory=set)  # shortest heads of all prefix features

    def add(self, feature: bytes, weight: float) -> None:
        if feature[:1].isdigit():
            self.heads.setdefault(int(feature[:1]), {})[feature[1:]] = weight
            self.stems.add(feature[1 : 1 + PREFIXES[0]])
        else:
            self.words[feature] = weight

    def score(self, text: str | None) -> float:
        words = words_of(text)
        margin = self.intercept + sum(self.words[w] for w in words & self.words.keys())
        if stems := {w[: PREFIXES[0]] for w in words} & self.stems:
            words = {w for w in words if w[: PREFIXES[0]] in stems and w not in GROUP_OF}
        for size, weights in self.heads.items() if stems else ():
            margin += sum(weights[h] for h in {w[:size] for w in words if len(w) > size} & weights.keys())
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -30.0, 30.0))))


def select(rows: list[np.ndarray], labels: np.ndarray, always: np.ndarray, most: int = MOST_FEATURES) -> np.ndarray:
    """Hashed features whose log-likelihood ratio between the labels is clear, and those asked for."""
    size = 1 << BITS
    n = [max(int((labels == k).sum()), 1) for k in (0, 1)]
    df = [
        np.bincount(np.concatenate([np.zeros(0, "<i4"), *(r for r, y in zip(rows, labels) if y == k)]), minlength=size)
        for k in (0, 1)
    ]
    share = (df[0] + df[1]) / sum(n)

    def part(k: int, count: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(df[k] * np.log(df[k] / (n[k] * share))) + np.nan_to_num(
                (n[k] - df[k]) * np.log((n[k] - df[k]) / (n[k] * (1 - share)))
            )

    ratio = 2 * (part(0, n[0]) + part(1, n[1]))
    best = np.argsort(-ratio, kind="stable")[:most]
    return np.union1d(best[ratio[best] > CLEAR], always[df[0][always] + df[1][always] > 0]).astype("<i4")


class Rows:
    """Sparse 0/1 rows over the chosen features."""

    def __init__(self, rows: list[np.ndarray], chosen: np.ndarray):
        inside = [np.searchsorted(chosen, np.intersect1d(row, chosen, assume_unique=True)) for row in rows]
        self.flat = np.concatenate([np.zeros(0, int), *inside])
        self.starts = np.concatenate(([0], np.cumsum([len(row) for row in inside]))).astype(int)
        self.size = len(chosen)

    def times(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(w[self.flat])))
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def back(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(per_row, np.diff(self.starts)), self.size)


def fit(
    own: Rows,
    labels: np.ndarray,
    at: np.ndarray,
    other: Rows,
    rounds: int = 400,
    ridge: float = 2e-4,
    counterfactual: float = 5.0,
    rate: float = 0.3,
) -> tuple[np.ndarray, float]:
    """Weights and intercept. Row n of `other` is row at[n] of `own` with its identity terms swapped.

    Adagrad over whole passes; both labels weigh the same.
    """
    y = labels.astype(float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(own.size), 0.0
    seen_w, seen_b = np.full(own.size, 1e-8), 1e-8
    for _ in range(rounds):
        margin = own.times(w)
        slope = weight * (1 / (1 + np.exp(-np.clip(margin + b, -30, 30))) - y)
        g, gb = own.back(slope) + ridge * w, slope.sum()
        if len(at):
            change = 2 * counterfactual * (margin[at] - other.times(w)) / len(at)
            g += own.back(np.bincount(at, change, len(y))) - other.back(change)
        seen_w += g * g
        w -= rate * g / np.sqrt(seen_w)
        seen_b += gb * gb
        b -= rate * gb / np.sqrt(seen_b)
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE) -> Model:
    """Fit on at most `rows` labelled documents of each label; `labels` must hold training rows only."""
    known = labels.select(col(id_col).cast("bigint").alias("id"), col(label_col).cast("int").alias("label"))
    known = known.where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    parts = [
        known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(rows) for label in (0, 1)
    ]
    chosen = written(parts[0].unionByName(parts[1]), "toxic-chosen")
    texts = docs.select(col(id_col).cast("bigint").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    # ids may repeat in docs: one text each, so that the sample stays bounded
    sample = written(
        texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text")),
        "toxic-sample",
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [words_of(text) for text in batch["text"]]
            other = [swapped(found, zlib.crc32(str(id_).encode())) for id_, found in zip(batch["id"], words)]
            yield batch[["id", "label"]].assign(
                own=[hashed(features(found)).tobytes() for found in words],
                other=[None if found is None else hashed(features(found)).tobytes() for found in other],
            )

    got = sample.mapInPandas(read, "id bigint, label int, own binary, other binary").collect()
    got.sort(key=lambda r: r.id)
    y = np.asarray([r.label for r in got])
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        return Model(30.0 if share == 1 else -30.0)
    own = [np.frombuffer(r.own, "<i4") for r in got]
    at = [n for n, r in enumerate(got) if r.other is not None]
    other = [np.frombuffer(got[n].other, "<i4") for n in at]
    always = np.unique([_hash(term) for term in GROUP_OF])
    kept = select(own, y, always)
    w, b = fit(Rows(own, kept), y, np.asarray(at, int), Rows(other, kept))
    weight_of = dict(zip(kept.tolist(), w.tolist()))

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = defaultdict(float)
            for words in map(words_of, batch["text"]):
                found.update((f, weight_of[h]) for f in features(words) if (h := _hash(f)) in weight_of)
            yield pd.DataFrame({"feature": list(found), "weight": list(found.values())})

    # the sample's features that were kept, by name: so scoring looks words up without hashing
    named = sample.mapInPandas(names, "feature binary, weight double").distinct().collect()
    model = Model(b)
    for feature, weight in named:
        model.add(bytes(feature), weight)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a column `out`: the probability of label 1, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand features

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(text) for text in batch], dtype=float)

    scored.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(scored, "double")(col(text_col)))
