"""Exact search for the largest inner products by descending one cover tree twice at once.

Queries are rows of the table, so one tree indexes both. Its centres come from a bounded sample
(SAMPLE rows by a hash of the row): from each node's own centre, farthest-first traversal adds
centres that lie further apart than the node's radius shrunk by BASE, and every sample row goes to
the nearest. All rows then descend to a leaf, always to the nearest centre, and every leaf learns
its covering radius from all rows below it, queries and candidates apart.

A first round scores each query against the leaves whose centres promise most until these hold
SEEDED rows. That gives every query a kth score, and every query group the worst of its members'.
Then pairs of a query node and a candidate node are followed from (root, root): by the covering
radii no product of members exceeds

    <a, b> + |a| R(b) + |b| R(a) + R(a) R(b)

and a pair that stays below the query group's worst kth score is dropped with all that lies below
it. What survives as a pair of leaves is scored exactly in whole numbers, after each query has met
the same bound alone. Leaves share bins, large ones are cut into blocks, and queries are dealt in
blocks too, so no task grows with a leaf; every block passes on each query's own best only.

Results are exact whatever the sample: it decides how much is pruned. Every row that takes part is
a candidate for all queries but itself, rows with repeated ids too; two rows with one query id are
two queries. Ties go to the smaller id. A vector shorter than the longest counts as zero beyond
its end. Scores beyond 64 bits become the nearest 64-bit number. Null ids, null vectors and those
with null or non-finite components take no part; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import vectors
from faultline.llm.tables import written

SAMPLE = 4_096
ROWS_PER_LEAF = 256
MOST_LEAVES = 2_048
FAN = 32  # children of a node
BASE = 1.3
SEEDED = 4  # times k
SLACK = 1e-9  # of a bound, for rounding
FOUND = "asked bigint, vec_id bigint, score bigint"


@dataclass
class Tree:
    """Nodes in the order in which they were made: a child comes after its parent."""

    centres: np.ndarray
    parent: list[int] = field(default_factory=lambda: [-1])
    children: list[list[int]] = field(default_factory=lambda: [[]])

    def leaves(self) -> list[int]:
        """Leaves from left to right, so that neighbours in the list share ancestors."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            todo += reversed(self.children[node])
            if not self.children[node]:
                out.append(node)
        return out

    def descend(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf and its distance from that leaf's centre."""
        leaf, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at) or not self.children[node]:
                leaf[at] = node
                continue
            below = np.asarray(self.children[node])
            nearest = below[distances(rows[at], self.centres[below]).argmin(1)]
            todo += [(child, at[nearest == child]) for child in below]
        return leaf, lengths(rows - self.centres[leaf])

    def radii(self, reach: dict[int, float]) -> np.ndarray:
        """Covering radius of every node from its leaves' (none below: minus infinity)."""
        out = np.full(len(self.parent), -np.inf)
        for node, radius in reach.items():
            out[node] = radius
        for node in range(len(out) - 1, 0, -1):
            up = self.parent[node]
            out[up] = max(out[up], out[node] + lengths(self.centres[[node]] - self.centres[up])[0])
        return out


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean norms; infinite where doubles overflow, so that bounds stay bounds."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.linalg.norm(rows, axis=1), nan=np.inf, posinf=np.inf)


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        square = (rows**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * rows @ centres.T
        return np.sqrt(np.nan_to_num(np.maximum(square, 0), nan=np.inf, posinf=np.inf))


def cover_tree(rows: np.ndarray, leaves: int) -> Tree:
    """A tree of about so many leaves over a sample."""
    start = rows[distances(rows, rows.mean(0, keepdims=True))[:, 0].argmin()]
    centres, tree = [start], Tree(np.zeros((0, 0)))
    todo = [(float(lengths(rows - start).max()), 0, np.arange(len(rows)))]
    count = 1
    while todo and count < leaves:
        todo.sort(key=lambda x: len(x[2]))
        radius, node, at = todo.pop()
        if radius <= 0 or len(at) < 2:
            continue
        chosen, far = [centres[node]], lengths(rows[at] - centres[node])
        nearest = np.zeros(len(at), np.int64)
        while len(chosen) < FAN and far.max() > radius / BASE:  # separation
            chosen.append(rows[at[far.argmax()]])
            own = lengths(rows[at] - chosen[-1])
            nearest[own < far] = len(chosen) - 1
            far = np.minimum(far, own)
        for n, centre in enumerate(chosen):  # the first repeats the node's own centre: nesting
            tree.parent.append(node)
            tree.children.append([])
            tree.children[node].append(len(centres))
            mine = nearest == n
            todo.append((float(far[mine].max(initial=0)), len(centres), at[mine]))
            centres.append(centre)
        count += len(chosen) - 1
    tree.centres = np.stack(centres)
    return tree


@dataclass
class Index:
    """The tree with what all rows say about it: covering radii and row counts per leaf."""

    tree: Tree
    queries: np.ndarray  # radius of the queries below each node
    rows: np.ndarray  # radius of the candidates below each node
    sizes: dict[int, int]

    def bounds(self, node: int, others: np.ndarray) -> np.ndarray:
        """No product of a query below `node` and a row below each of `others` is larger."""
        c = self.tree.centres
        mine, theirs = lengths(c[[node]])[0], lengths(c[others])
        r, s = self.queries[node], self.rows[others]
        with np.errstate(over="ignore", invalid="ignore"):
            most = c[others] @ c[node] + mine * s + theirs * r + r * s
            most += SLACK * (mine + r) * (theirs + s) + 1
        return np.where(np.isneginf(s), -np.inf, np.nan_to_num(most, nan=np.inf, posinf=np.inf))

    def seeds(self, leaf: int, least: int) -> list[int]:
        """Leaves whose centres promise most, until they hold `least` rows."""
        held = np.asarray(sorted(self.sizes))
        order = held[np.argsort(-(self.tree.centres[held] @ self.tree.centres[leaf]), kind="stable")]
        counts = np.cumsum([self.sizes[n] for n in order])
        return order[: int(np.searchsorted(counts, least)) + 1].tolist()

    def survivors(self, floors: dict[int, float]) -> Iterator[tuple[int, list[int]]]:
        """(query leaf, candidate leaves) that the bounds leave, for the query leaves in `floors`."""
        tree = self.tree
        worst = np.full(len(tree.parent), np.inf)  # the worst kth score below each node
        for leaf, floor in floors.items():
            worst[leaf] = floor
        for node in range(len(worst) - 1, 0, -1):
            worst[tree.parent[node]] = min(worst[tree.parent[node]], worst[node])
        todo = [(0, np.zeros(1, np.int64))]
        while todo:
            node, others = todo.pop()
            if worst[node] == np.inf:  # no query of these below
                continue
            others = others[self.bounds(node, others) >= worst[node]]
            below = [n for o in others for n in (tree.children[o] or [o])]
            if tree.children[node]:
                todo += [(child, np.asarray(below, np.int64)) for child in tree.children[node]]
            elif any(tree.children[o] for o in others):
                todo.append((node, np.asarray(below, np.int64)))
            elif len(others):
                yield node, others.tolist()


def met(stored: pd.DataFrame, asking: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """A block of rows and a block of queries: each query's own best among the leaves it wants."""
    out = []
    q = vectors.matrix(asking["v"], width)
    q_rows, floors = asking["rid"].to_numpy(), asking["floor"].to_numpy(float)
    norms = lengths(q)
    wanted = pd.DataFrame({"at": np.arange(len(asking)), "leaf": asking["leaves"]}).explode("leaf").groupby("leaf")["at"]
    wanted = {leaf: at.to_numpy(np.int64) for leaf, at in wanted}
    for leaf, here in stored.groupby("leaf"):
        if leaf not in wanted:
            continue
        rows, ids, r_rows = vectors.matrix(here["v"], width), here["vec_id"].to_numpy(), here["rid"].to_numpy()
        centre = rows.mean(0)
        radius = lengths(rows - centre).max()
        at = wanted[leaf]
        with np.errstate(over="ignore", invalid="ignore"):
            most = q[at] @ centre + norms[at] * radius
            most += SLACK * norms[at] * (lengths(centre[None])[0] + radius) + 1
        at = at[~(most < floors[at])]  # no floor yet: NaN
        for low in range(0, len(at), 256):
            part = at[low : low + 256]
            for n, line in zip(part, vectors.products(q[part], rows)):
                fine = np.flatnonzero((r_rows != q_rows[n]) & ~(line < floors[n]))
                top = fine[vectors.best(line[fine], ids[fine], k)]
                out.append((np.full(len(top), q_rows[n]), ids[top], line[top]))
    if not out:
        return pd.DataFrame({"asked": [], "vec_id": [], "score": []}, dtype="int64")
    asked, ids, scores = (np.concatenate(x) for x in zip(*out))
    every = pd.DataFrame({"asked": asked, "vec_id": ids, "score": scores})
    return every.sort_values(["asked", "score", "vec_id"], ascending=[True, False, True]).groupby("asked").head(k)


def search(
    df: DataFrame, is_query, k: int = 10, factor: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products. `is_query`: a condition on the id."""
    spark = df.sparkSession
    points = vectors.whole_numbers(df, factor, id_col, vector_col).withColumn("asks", is_query(F.col("vec_id")))
    points = written(vectors.numbered(points, "rid"), "cover-points")
    total, width = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = max(width, 1)
    sample = points.orderBy(F.xxhash64("rid"), "rid").limit(max(2, min(SAMPLE, vectors.BLOCK_VALUES // width))).toPandas()
    leaves = max(1, min(MOST_LEAVES, len(sample), total // ROWS_PER_LEAF))
    tree = cover_tree(vectors.matrix(sample["v"], width), leaves)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaf, far = tree.descend(vectors.matrix(batch["v"], width))
            yield batch.assign(leaf=leaf, far=far)

    placed = written(points.mapInPandas(place, "vec_id bigint, v array<double>, asks boolean, rid bigint, leaf bigint, far double"), "cover-placed")
    # one row per leaf, of which there are at most MOST_LEAVES + FAN
    count, reach = F.count(F.lit(1)).alias("n"), F.max("far").alias("far")
    held = {r["leaf"]: r for r in placed.groupBy("leaf").agg(count, reach, F.max(F.when(F.col("asks"), F.col("far"))).alias("q_far")).collect()}
    sizes = {leaf: r["n"] for leaf, r in held.items()}
    index = Index(
        tree,
        tree.radii({leaf: r["q_far"] for leaf, r in held.items() if r["q_far"] is not None}),
        tree.radii({leaf: r["far"] for leaf, r in held.items()}),
        sizes,
    )
    queries = placed.where("asks").select("rid", "vec_id", "v", "leaf")
    homes = vectors.binned(tree.leaves(), sizes, max(1, min(vectors.BLOCK_ROWS, vectors.BLOCK_VALUES // width)))

    def meet(pairs: DataFrame, asking: DataFrame) -> DataFrame:
        """Score all pairs (q_leaf, leaf) with the queries (rid, v, leaf, floor): each block's best."""
        rows = placed.select("rid", "vec_id", "v", "leaf")
        return vectors.in_blocks(rows, asking, pairs, homes, lambda ours, theirs: met(ours, theirs, width, k), FOUND)

    def seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(leaf, seed) for leaf in batch["leaf"] for seed in index.seeds(leaf, SEEDED * k + 1)]
            yield pd.DataFrame(pairs, columns=["q_leaf", "leaf"], dtype="int64")

    def descended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            floors = dict(zip(batch["leaf"], batch["floor"].fillna(-np.inf)))
            for leaf, others in index.survivors(floors):
                done = set(index.seeds(leaf, SEEDED * k + 1))
                pairs = [(leaf, other) for other in others if other not in done]
                yield pd.DataFrame(pairs, columns=["q_leaf", "leaf"], dtype="int64")

    none = F.lit(None).cast("double").alias("floor")
    first = queries.select("leaf").distinct().mapInPandas(seeded, "q_leaf bigint, leaf bigint")
    found = written(meet(first, queries.select("rid", "v", "leaf", none)), "cover-first")
    # a query's kth score, unless it has met fewer than k rows
    place_of = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    kth = found.withColumn("place", place_of).where(F.col("place") == k).select(F.col("asked").alias("rid"), F.col("score").cast("double").alias("floor"))
    asking = written(queries.join(kth, "rid", "left").select("rid", "v", "leaf", "floor"), "cover-floors")
    worst = F.when(F.count("floor") == F.count(F.lit(1)), F.min("floor")).alias("floor")
    second = asking.groupBy("leaf").agg(worst).mapInPandas(descended, "q_leaf bigint, leaf bigint")
    every = found.unionByName(meet(written(second, "cover-pairs"), asking))
    ranked = every.withColumn("rank", place_of).where(F.col("rank") <= k)
    return ranked.join(queries.select(F.col("rid").alias("asked"), F.col("vec_id").alias("query_id")), "asked").select(
        "query_id", "rank", "vec_id", "score"
    )
