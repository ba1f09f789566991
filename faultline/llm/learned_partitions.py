"""Nearest neighbours by learned partitions of a neighbour graph.

On a bounded sample (SAMPLE vectors by a hash of the id) the graph of GRAPH nearest neighbours is
cut into balanced parts: halving along principal directions, then moving vectors to the part that
holds most of their neighbours, within a size limit. A softmax classifier with one hidden layer
learns from a vector in which parts its neighbours lie. It then assigns every row to its most
probable part, and routes every query to its most probable ones; how many is the least number that
finds ROUTED of the sample's own neighbours, so the data decide. Routed queries are scored against
all rows of those parts, exactly.

Parts may be of any size: neighbouring small ones share a bin, a large one is cut into blocks, so
rows and queries meet in blocks of bounded size. A query goes once to each bin that holds parts of
its own, is scored there against just those parts, and each block passes on its own best; these are
ranked per query. Nearness is the largest inner product in double precision, ties go to the
smaller id. Vectors that are null, zero, hold nulls or non-finite numbers, or are not as long as
most vectors take no part; null ids neither. A query's own row is left out of its answer, other rows
of its id or equal to it are not; two rows of one query id are two queries. Empty tables give an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.tables import col, written

SAMPLE = 4_096
GRAPH = 12
ROWS_PER_PART = 1_000
MOST_PARTS = 256
ROUTED = 0.96
HIDDEN = 64
INDEX_BLOCK = 16_384
QUERY_BLOCK = 2_048
BLOCK_VALUES = 1 << 21  # numbers in a block: 16 MB
PRODUCT_ROWS = 512
FOUND = "asked bigint, query_id bigint, vec_id bigint, score double"


def neighbours(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest inner products of each vector with the others."""
    out = np.empty((len(vectors), k), int)
    for low in range(0, len(vectors), 512):
        near = vectors[low : low + 512] @ vectors.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -np.inf
        out[low : low + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def halved(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Balanced start: halves along the principal direction, again and again."""
    part = np.zeros(len(vectors), int)
    count = 1
    while count < parts:
        for p in range(count):
            at = np.flatnonzero(part == p)
            centred = vectors[at] - vectors[at].mean(0)
            _, directions = np.linalg.eigh(centred.T @ centred)
            order = at[np.argsort(centred @ directions[:, -1], kind="stable")]
            part[order[len(order) // 2 :]] = p + count
        count *= 2
    return part


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.15) -> np.ndarray:
    """Parts of the neighbour graph: vectors move to their neighbours' part while sizes allow it."""
    part = halved(vectors, parts)
    most = int(np.ceil(len(vectors) / parts * (1 + slack)))
    least = int(len(vectors) / parts * (1 - slack))
    source = np.repeat(np.arange(len(graph)), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((len(vectors), parts))
        np.add.at(votes, (source, part[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), part[source]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(part)), best] - votes[np.arange(len(part)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for n in np.argsort(-gain, kind="stable"):
            if gain[n] <= 0:
                break
            if size[best[n]] < most and size[part[n]] > least:
                size[best[n]] += 1
                size[part[n]] -= 1
                part[n] = best[n]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        return np.maximum(vectors * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, vectors: np.ndarray) -> np.ndarray:
        """Parts from the most probable on."""
        return np.argsort(-self.logits(vectors), axis=1, kind="stable")


def train_router(vectors: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.02) -> Router:
    """Softmax classifier of the parts in which neighbours lie (rows of `target` add up to 1); Adam."""
    rng = np.random.default_rng(7)
    dim, parts = vectors.shape[1], target.shape[1]
    scale = 1 / max(np.sqrt((vectors**2).mean()), 1e-30)
    x = vectors * scale
    weights = [rng.normal(0, np.sqrt(2 / dim), (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for turn in range(1, rounds + 1):
        at = rng.integers(0, len(x), min(len(x), 512))
        hidden = np.maximum(x[at] @ weights[0] + weights[1], 0)
        z = hidden @ weights[2] + weights[3]
        z = np.exp(z - z.max(1, keepdims=True))
        slope = (z / z.sum(1, keepdims=True) - target[at]) / len(at)
        back = slope @ weights[2].T * (hidden > 0)
        for n, g in enumerate((x[at].T @ back, back.sum(0), hidden.T @ slope, slope.sum(0))):
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.999 * second[n] + 0.001 * g * g
            weights[n] -= rate * (first[n] / (1 - 0.9**turn)) / (np.sqrt(second[n] / (1 - 0.999**turn)) + 1e-8)
    return Router(scale, *weights)


def fit(vectors: np.ndarray, rows: int, routed: float = ROUTED) -> Router:
    """A router for `rows` rows, from a sample of them."""
    parts = 1
    while parts < MOST_PARTS and parts * ROWS_PER_PART < rows and parts * 32 < len(vectors):
        parts *= 2
    if parts == 1:
        dim = vectors.shape[1]
        return Router(1.0, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbours(vectors, min(GRAPH, len(vectors) - 1))
    part = balanced_parts(vectors, graph, parts)
    target = np.zeros((len(vectors), parts))
    np.add.at(target, (np.repeat(np.arange(len(graph)), graph.shape[1]), part[graph.ravel()]), 1)
    router = train_router(vectors, target / target.sum(1, keepdims=True))
    # rows go where the classifier puts them, so routing is measured against that
    ranked = router.ranked(vectors)
    place = np.argsort(ranked, axis=1)  # place of each part in a query's ranking
    reached = np.take_along_axis(place, ranked[:, 0][graph], axis=1)
    shares = np.cumsum(np.bincount(reached.ravel(), minlength=parts)) / reached.size
    router.probes = int(np.searchsorted(shares, routed) + 1)
    return router


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def best(asking: pd.DataFrame, queries: np.ndarray, stored: pd.DataFrame, rows: np.ndarray, k: int) -> pd.DataFrame:
    """(asked, query_id, vec_id, score) of the k best rows of each query; ids ascend."""
    own, ids, numbers = asking["rid"].to_numpy(), stored["vec_id"].to_numpy(), stored["rid"].to_numpy()
    found = []
    for low in range(0, len(queries), PRODUCT_ROWS):
        near = queries[low : low + PRODUCT_ROWS] @ rows.T
        near[own[low : low + PRODUCT_ROWS, None] == numbers[None, :]] = -np.inf
        for n, line in enumerate(near, low):
            if len(line) > k:
                edge = np.partition(line, len(line) - k)[len(line) - k]
                # products of equal vectors may differ in the last bits: score the doubtful ones alike
                at = np.flatnonzero((line >= edge - 1e-9 * max(1.0, abs(edge))) & (line > -np.inf))
            else:
                at = np.flatnonzero(line > -np.inf)
            score = (rows[at] * queries[n]).sum(1)
            order = np.lexsort((ids[at], -score))[:k]
            found.append((np.full(len(order), own[n]), np.full(len(order), asking["vec_id"].iloc[n]), ids[at[order]], score[order]))
    columns = ["asked", "query_id", "vec_id", "score"]
    return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*found))))) if found else pd.DataFrame(columns=columns)


def binned(sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(part, bin, blocks): parts that halving split last share a bin of at most `most` rows; a larger part has its own."""
    out, number, filled = [], -1, most
    for part in sorted(sizes, key=lambda p: int(f"{p:016b}"[::-1], 2)):
        if filled + sizes[part] > most:
            number, filled = number + 1, 0
        filled += sizes[part]
        out.append((part, number, -(-filled // most)))
    return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(col(id_col).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    return rows.select(col(id_col).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v"))


def search(
    df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", routed: float = ROUTED
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of all rows. `is_query`: a condition on vec_id."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    length = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if length is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = written(rows.where(F.size("v") == length[0]).withColumn("rid", F.monotonically_increasing_id()), "ann-rows")
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "rid").limit(SAMPLE).toPandas()
    router = fit(matrix(sample["v"]), total, routed)

    def place(batches):
        for batch in batches:
            ranked = router.ranked(matrix(batch["v"])) if len(batch) else np.zeros((0, 1), int)
            yield batch.assign(part=ranked[:, 0].astype(np.int32))

    index = written(rows.mapInPandas(place, "vec_id bigint, v array<double>, rid bigint, part int"), "ann-index")
    # at most MOST_PARTS rows here and below
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    most = max(1, min(INDEX_BLOCK, BLOCK_VALUES // length[0]))
    bins = binned(sizes, most)
    bin_of = {part: number for part, number, _ in bins}

    def route(batches):
        for batch in batches:
            ranked = router.ranked(matrix(batch["v"])) if len(batch) else np.zeros((0, 1), int)
            sent = []
            for n, parts in enumerate(ranked[:, : router.probes]):
                wanted = {}
                for part in parts:
                    if part in bin_of:
                        wanted.setdefault(bin_of[part], []).append(part)
                sent += [(batch["vec_id"].iloc[n], batch["v"].iloc[n], batch["rid"].iloc[n], number, parts) for number, parts in wanted.items()]
            yield pd.DataFrame(sent, columns=["vec_id", "v", "rid", "bin", "parts"])

    asked = written(
        rows.where(is_query(F.col("vec_id"))).mapInPandas(route, "vec_id bigint, v array<double>, rid bigint, bin int, parts array<int>"),
        "ann-queries",
    )
    asks = {r["bin"]: -(-r["count"] // QUERY_BLOCK) for r in asked.groupBy("bin").count().collect()}
    home = [(part, number, blocks, asks[number]) for part, number, blocks in bins if number in asks]
    home = spark.createDataFrame(home, "part int, bin int, blocks bigint, q_blocks bigint")
    homes = F.broadcast(home)
    met = F.broadcast(home.groupBy("bin").agg(F.max("blocks").alias("blocks"), F.max("q_blocks").alias("q_blocks")))

    def upto(n: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    left = index.join(homes, "part").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    left = left.withColumn("q_block", upto("q_blocks")).select("bin", "block", "q_block", "vec_id", "v", "rid", "part")
    right = asked.join(met, "bin").withColumn("q_block", F.pmod(F.xxhash64("rid"), F.col("q_blocks")))
    right = right.withColumn("block", upto("blocks")).select("bin", "block", "q_block", "vec_id", "v", "rid", "parts")

    def score(stored: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries):
            asking = matrix(queries["v"])
            for part, here in stored.sort_values("vec_id", kind="stable").groupby("part"):
                at = np.flatnonzero([part in wanted for wanted in queries["parts"]])
                found.append(best(queries.iloc[at], asking[at], here, matrix(here["v"]), k))
        found = pd.concat([f for f in found if len(f)] or [pd.DataFrame(columns=["asked", "query_id", "vec_id", "score"])])
        return found.sort_values(["asked", "score", "vec_id"], ascending=[True, False, True]).groupby("asked").head(k)

    keys = ["bin", "block", "q_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, FOUND)
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
