"""Exact Jaccard similarity join as a join in a metric space.

A document is the set of its distinct runs of WIDTH lower-cased words (a shorter text is one run,
a text without words the empty set, which links with nothing). 1 - Jaccard is a metric. Documents
link when 100 * intersection >= PERCENT * union; they are told apart by 64-bit hashes of their runs.

1. Islands. Runs have one global order, rare ones first (by a counting sketch over all texts, so
   any order it gives is the same for all). Linked sets of sizes n and m share, among the first
   n - ceil(0.8 n) + extra(n) runs of each, at least min(extra(n), extra(m)). So a set that has
   fewer of them in common with all others links with nothing, and of the rest the commonest
   extra - 1 can be left out: what linked sets still share connects them. Components of that graph
   are islands; no link leads from one to another.
   With more texts, runs that unrelated texts share by chance tie ever more sets into one island.
   So a large island is made again from all runs of its sets, in the exact order of their numbers
   inside it: a set of size n that links shares ceil(0.8 n) runs at least with others, and all but
   the commonest ceil(0.8 n) - 1 of those still connect it with each partner.
2. Regions. An island is joined in one task when it is small. A larger one is cut by pivots: every
   document goes to the Voronoi cell of its nearest pivot, or to the rest when all pivots are
   farther than NEAR, and visits each cell in which a partner could lie by the triangle inequality.
   Cells are cut again, then joined exactly: inside a task by the same rule, down to small cells
   whose intersections are counted by matrix products. What rounds of cutting leave too large is
   joined block by block, so memory stays bounded.
3. Links join components. Sets that are equal form a class first and take part once.

Null texts count as empty, null ids name no component unless no other id does, repeated rows are
members of one class. Nothing is capped: every linked pair lies in one class or joins its classes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.components import components
from faultline.llm.tables import BLOCK_BITS, col, fresh, written
from faultline.llm.wordhash import shingles

WIDTH = 5
PERCENT = 80
EXTRA = 0.1  # of a set's size, read beyond the plain prefix
SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 14
HOT_LEVEL = 2  # runs in sketch cells of four times the mean load or more
PIVOTS = 8
NEAR = 0.6
LEAF = 192  # documents whose intersections are counted at once
ISLAND_RUNS = 2_000_000  # an island of more runs or documents is cut before it is joined
ISLAND_DOCS = 1_024
ROUNDS = 3
MOST_BROADCAST = 100_000  # large regions, of two numbers each
MOST_VISITS = 3  # times the documents that cells of a useful cut hold, visitors included
FILTER_BITS = 1 << 28


def extra(n: np.ndarray | int, share: float = EXTRA):
    return np.maximum(1, np.floor(share * np.asarray(n))).astype(int)


def least_size(n):
    """Least size of a partner, and of the intersection, of a set of size n."""
    return -(-np.asarray(n) * PERCENT // 100)


def links(inter: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * inter >= PERCENT * (n + m - inter)


# ---- inside a task -------------------------------------------------------------------------------


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def overlaps(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the runs."""
    flat = np.concatenate(rows + others)
    size = np.asarray([len(r) for r in rows + others])
    owner = np.repeat(np.arange(len(size)), size)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    kept = count[place] > 1  # runs of one document intersect nothing
    place, owner = place[kept], owner[kept]
    number = np.cumsum(count > 1) - 1
    place = number[place]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((len(rows), len(others)), np.float32)  # counts are far below 2^24
    step = max(64, (1 << 21) // len(size))
    last = int(place[-1]) + 1 if len(place) else 0
    for low in range(0, last, step):
        a, b = np.searchsorted(place, (low, low + step))
        hot = np.zeros((len(size), step), np.float32)
        hot[owner[a:b], place[a:b] - low] = 1
        total += hot[: len(rows)] @ hot[len(rows) :].T
    return total


def distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(sets)
    size = np.asarray([len(s) for s in sets])
    ends = np.cumsum(size)
    out = np.empty((len(sets), len(pivots)))
    for n, pivot in enumerate(pivots):
        at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        hits = np.concatenate(([0], np.cumsum(pivot[at] == flat)))
        inter = hits[ends] - hits[ends - size]
        out[:, n] = 1 - inter / (size + len(pivot) - inter)
    return out


def cells(dist: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows at home, rows visiting) per Voronoi cell; the last cell is the rest, beyond NEAR of all.

    Let d(x, y) <= e, y at home in cell j. Then d(x, j) <= d(y, j) + e <= NEAR + e, and, as j is y's
    nearest, d(x, j) <= d(y, v) + e <= d(x, v) + 2e for x's own v. If y is in the rest, all pivots
    are farther than NEAR from y, so farther than NEAR - e from x. Else x need not visit.
    """
    e = 1 - PERCENT / 100 + 1e-9
    home = dist.argmin(1)
    least = dist[np.arange(len(dist)), home]
    far = least > NEAR
    home[far] = dist.shape[1]
    out = []
    for j in range(dist.shape[1]):
        own = home == j
        reach = dist[own, j].max(initial=-1.0) + e
        visit = ~own & (dist[:, j] <= reach) & (far | (dist[:, j] <= least + 2 * e))
        out.append((np.flatnonzero(own), np.flatnonzero(visit)))
    out.append((np.flatnonzero(far), np.flatnonzero(~far & (least > NEAR - e))))
    return out


def islets(sets: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    """Parts of `rows` that no link leaves, by the rule of `finer`; what links with nothing is in none."""
    size = np.asarray([len(sets[r]) for r in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    _, run, count = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    kept = count[run] > 1
    run, owner = run[kept], owner[kept]
    order = np.lexsort((run, count[run], owner))
    run, owner = run[order], owner[order]
    total = np.bincount(owner, minlength=len(rows))
    rank = np.arange(len(owner)) - (np.cumsum(total) - total)[owner]
    kept = rank <= (total - least_size(size))[owner]
    run, owner = run[kept], owner[kept]
    order = np.argsort(run, kind="stable")
    run, owner = run[order], owner[order]
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    times = np.diff(starts, append=len(run))
    part = np.arange(len(rows))
    while len(run):
        now = part.copy()
        np.minimum.at(now, owner, np.repeat(np.minimum.reduceat(part[owner], starts), times))
        now = now[now]
        if (now == part).all():
            break
        part = now
    order = np.argsort(part, kind="stable")
    parts = np.split(rows[order], np.flatnonzero(np.diff(part[order])) + 1)
    return [one for one in parts if len(one) > 1]


def join_sets(sets: list[np.ndarray], rows: np.ndarray, forest: Forest) -> None:
    """Join all linked sets among `rows`, recursively over islets and Voronoi cells."""
    if len(rows) > LEAF:
        parts = islets(sets, rows)
        if not parts or len(parts[0]) < len(rows):
            for part in parts:
                join_sets(sets, part, forest)
            return
        # spread over the rows, so that a rerun takes the same
        chosen = rows[np.linspace(0, len(rows) - 1, PIVOTS).astype(int)]
        parts = cells(distances([sets[r] for r in rows], [sets[r] for r in chosen]))
        parts = [np.concatenate(part) for part in parts if len(part[0])]
        if max(map(len, parts)) <= 0.8 * len(rows) and sum(map(len, parts)) <= MOST_VISITS * len(rows):
            for part in parts:
                join_sets(sets, rows[np.sort(part)], forest)
            return
    size = np.asarray([len(sets[r]) for r in rows])
    for low in range(0, len(rows), 1024):
        for start in range(0, low + 1, 1024):
            a, b = rows[low : low + 1024], rows[start : start + 1024]
            inter = overlaps([sets[r] for r in a], [sets[r] for r in b])
            linked = links(inter, size[low : low + 1024, None], size[None, start : start + 1024])
            for x, y in zip(*np.nonzero(linked)):
                if a[x] > b[y]:
                    forest.join(a[x], b[y])


def join_group(group: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) from each set to the first of its component within the group."""
    group = group.drop_duplicates("k").sort_values("k")
    sets = [np.frombuffer(runs, "<u8") for runs in group["runs"]]
    forest = Forest(len(sets))
    join_sets(sets, np.arange(len(sets)), forest)
    names = group["k"].to_numpy()
    root = np.asarray([forest.root(n) for n in range(len(sets))], int)
    moved = root != np.arange(len(sets))
    return pd.DataFrame({"a": names[moved], "b": names[root[moved]]})


# ---- over the tables -----------------------------------------------------------------------------


def _cell_of(runs: np.ndarray) -> np.ndarray:
    return (runs >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch_levels(texts: DataFrame) -> np.ndarray:
    """Per sketch cell, how many doublings its load lies above the mean: 0 for most, a fixed 1 MB."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            runs = np.concatenate([np.zeros(0, np.uint64), *(shingles(text, WIDTH) for text in batch["text"])])
            total += np.bincount(_cell_of(runs), minlength=len(total))
        starts = range(0, len(total), SKETCH_BLOCK)
        loads = [zlib.compress(total[b : b + SKETCH_BLOCK].tobytes(), 1) for b in starts]
        yield pd.DataFrame({"block": list(starts), "loads": loads})

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for part in parts:
            for loads in part["loads"]:
                total += np.frombuffer(zlib.decompress(loads), np.int64)
        yield pd.DataFrame({"block": [key[0]], "loads": [total.tobytes()]})

    blocks = texts.mapInPandas(count, "block bigint, loads binary")
    merged = blocks.groupBy("block").applyInPandas(add, "block bigint, loads binary").collect()
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for block, loads in merged:
        total[block : block + SKETCH_BLOCK] = np.frombuffer(loads, np.int64)
    mean = max(total.mean(), 1.0)
    return np.maximum(0, np.floor(np.log2(np.maximum(total, 1) / mean))).astype(np.uint8)


def set_digest(runs: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(runs.tobytes(), digest_size=8).digest(), "little", signed=True)


def first_runs(runs: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's first runs in the global order, as those of low and of high sketch load."""
    n = len(runs)
    if not n:
        return runs, runs
    level = levels[_cell_of(runs)]
    order = np.lexsort((runs * np.uint64(0x9E3779B97F4A7C15), level))
    taken = order[: min(n, n - int(least_size(n)) + int(extra(n)))]
    hot = level[taken] >= HOT_LEVEL
    return runs[taken[~hot]], runs[taken[hot]]


def describe(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """(id, t, n, k, cold, hot) per document: hash of its text, size and digest of its set, and its first runs."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(text, WIDTH) for text in batch["text"]]
            first = [first_runs(runs, shared.value) for runs in sets]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "t": batch["t"],
                    "n": [len(runs) for runs in sets],
                    "k": [set_digest(runs) for runs in sets],
                    "cold": [cold.view(np.int64) for cold, _ in first],
                    "hot": [hot.view(np.int64) for _, hot in first],
                }
            )

    hashed = texts.select("id", "text", F.xxhash64("text").alias("t"))
    return hashed.mapInPandas(run, "id string, t bigint, n bigint, k bigint, cold array<bigint>, hot array<bigint>")


def shared_runs(described: DataFrame) -> DataFrame:
    """(k, run, df) of the first runs that at least two different sets have.

    Runs of low load fit a window: a sketch cell bounds them. Runs of high load are counted with a
    partial aggregate, and the join with the counts has a plain shuffle on either side, so that
    a hot run can be split.
    """
    cold = described.select("k", F.explode("cold").alias("run"))
    by_run = Window.partitionBy("run")
    cold = cold.select(
        "k", "run", F.count(F.lit(1)).over(by_run).alias("df"), (F.min("k").over(by_run) < F.max("k").over(by_run)).alias("two")
    )
    hot = described.select("k", F.explode("hot").alias("run"))
    counts = hot.groupBy("run").agg(F.count(F.lit(1)).alias("df"), (F.min("k") < F.max("k")).alias("two"))
    hot = hot.join(written(counts.where("two"), "jaccard-hot"), "run").select("k", "run", "df", "two")
    return cold.where("two").unionByName(hot).select("k", "run", "df").distinct()


def islands(described: DataFrame, classes: DataFrame) -> DataFrame:
    """(k, island) of the sets that may link with another."""
    shared = written(shared_runs(described), "jaccard-shared")
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) * EXTRA))
    active = (
        shared.groupBy("k")
        .agg(F.count(F.lit(1)).alias("common"))
        .join(classes.select("k", "n"), "k")
        .withColumn("need", need)
        .where("common >= need")
    )
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("df"), "run"))  # a set's own runs
    kept = written(
        shared.join(active.select("k", "need"), "k").withColumn("rank", rank).where("rank >= need").select("k", "run"),
        "jaccard-kept",
    )
    return connected(kept, "run")


def connected(kept: DataFrame, *keys: str) -> DataFrame:
    """(k, island): components of the sets by the runs they have in common, a run being named by `keys`."""
    heads = kept.groupBy(*keys).agg(F.min("k").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
    edges = kept.join(written(heads, "jaccard-heads"), list(keys)).select(F.col("k").alias("a"), F.col("head").alias("b"))
    return components(edges).select(F.col("node").alias("k"), F.col("component").alias("island"))


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, runs) of the wanted sets (k, t), one row each; t is the hash of a text that has the set.

    A bitmap of such hashes, of bounded size (see FILTER_BITS), keeps the runs of most other texts from
    being made again; sets that come through it by chance go where k is compared.
    """
    bits = BLOCK_BITS
    rows = wanted.count()
    while bits < 16 * rows and bits < FILTER_BITS:
        bits *= 2
    slot = F.col("t").bitwiseAND(F.lit(bits - 1))
    blocks = (
        wanted.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bitmap"))
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for block, data in blocks.toLocalIterator():
        bitmap[(block - 1) * BLOCK_BITS // 8 : block * BLOCK_BITS // 8] = np.frombuffer(data, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            at = batch["t"].to_numpy(np.int64) & (bits - 1)
            sets = [shingles(text, WIDTH) for text in batch["text"][known[at >> 3] >> (at & 7) & 1 == 1]]
            keys = np.asarray([set_digest(one) for one in sets], np.int64)
            yield pd.DataFrame({"k": keys, "runs": [one.tobytes() for one in sets]})

    found = texts.select("text", F.xxhash64("text").alias("t")).mapInPandas(run, "k bigint, runs binary")
    # copies fold before the shuffle
    return found.groupBy("k").agg(F.first("runs").alias("runs")).join(wanted.select("k"), "k", "left_semi")


def finer(large: DataFrame) -> DataFrame:
    """(region, k, n, runs) of large islands, made again by the exact order of all runs of their own sets.

    Linked sets of sizes n and m share at least the larger of least_size(n) and least_size(m) runs.
    Let each leave out the commonest least_size - 1 of its runs that others of its island have: the
    rarest run of what the two share is left in both.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(runs=[np.frombuffer(one, np.int64) for one in batch["runs"]])

    listed = large.select("region", "k", "n", "runs").mapInPandas(run, "region bigint, k bigint, n bigint, runs array<bigint>")
    runs = listed.select("region", "k", "n", F.explode("runs").alias("run"))
    counts = runs.groupBy("region", "run").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a plain shuffle on either side, so that a hot run can be split
    shared = runs.join(written(counts, "jaccard-counts"), ["region", "run"])
    own = Window.partitionBy("k")
    spare = F.count(F.lit(1)).over(own) - F.ceil(F.col("n") * PERCENT / 100)
    ranked = shared.withColumn("spare", spare).withColumn("rank", F.row_number().over(own.orderBy("df", "run")))
    kept = written(ranked.where("rank <= spare + 1").select("region", "k", "run"), "jaccard-fine")
    return large.join(connected(kept, "region", "run"), "k").select(F.col("island").alias("region"), "k", "n", "runs")


def _sizes(placed: DataFrame, runs: int, docs: int) -> DataFrame:
    sizes = placed.groupBy("region").agg(F.sum("n").alias("all_runs"), F.count(F.lit(1)).alias("all_docs"))
    blocks = F.greatest(F.ceil(F.col("all_runs") / runs), F.ceil(F.col("all_docs") / docs))
    return sizes.select("region", blocks.alias("blocks"))


def _cut(large: DataFrame) -> DataFrame:
    """Cut every large region (region, k, n, runs, blocks) by its own pivots into Voronoi cells."""
    order = Window.partitionBy("region").orderBy(F.xxhash64("k", "region"), "k")
    pivots = large.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIVOTS)
    pivots = written(pivots.select("region", "blocks", "k", F.col("runs").alias("pivot")), "jaccard-pivots").select(
        "region", "pivot", "k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    parts = large.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")))

    def place(key: tuple, rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            sets = [np.frombuffer(x, "<u8") for x in rows["runs"]]
            dist = distances(sets, [np.frombuffer(x, "<u8") for x in chosen.sort_values("k")["pivot"]])
            # a block does not know its cell's reach elsewhere: NEAR bounds it
            home = dist.argmin(1)
            least = dist[np.arange(len(dist)), home]
            e = 1 - PERCENT / 100 + 1e-9
            far = least > NEAR
            for j in range(dist.shape[1] + 1):
                if j == dist.shape[1]:
                    at = np.flatnonzero(least > NEAR - e)
                else:
                    at = np.flatnonzero((dist[:, j] <= NEAR + e) & (far | (dist[:, j] <= least + 2 * e)))
                out.append(rows.iloc[at][["region", "k", "n", "runs"]].assign(cell=j))
        return pd.concat(out) if out else pd.DataFrame({x: [] for x in ("region", "k", "n", "runs", "cell")})

    placed = (
        parts.groupBy("region", "block")
        .cogroup(pivots.groupBy("region", "block"))
        .applyInPandas(place, "region bigint, k bigint, n bigint, runs binary, cell int")
    )
    return placed.select(F.xxhash64("region", "cell").alias("region"), "k", "n", "runs")


def linked(placed: DataFrame, most_runs: int, most_docs: int, rounds: int) -> DataFrame:
    """Edges (a, b) that join what links within the islands (region, k, n, runs)."""
    edges = None

    def more(found: DataFrame) -> None:
        nonlocal edges
        edges = found if edges is None else edges.unionByName(found)

    for turn in range(rounds + 2):
        crowded = written(_sizes(placed, most_runs, most_docs).where("blocks > 1"), "jaccard-crowded")
        count = crowded.count()
        if not count:
            more(placed.groupBy("region").applyInPandas(join_group, "a bigint, b bigint"))
            return edges
        # runs stay where they are while the few large regions are told apart
        sized = placed.join(F.broadcast(crowded) if count <= MOST_BROADCAST else crowded, "region", "left")
        more(sized.where("blocks IS NULL").groupBy("region").applyInPandas(join_group, "a bigint, b bigint"))
        large = sized.where("blocks IS NOT NULL")
        if turn == 0:
            placed = written(finer(large), "jaccard-finer")
            continue
        if turn > rounds:
            break
        placed = written(_cut(large), "jaccard-cells")
        if placed.count() > MOST_VISITS * large.count():
            break  # all pivots are about as near: cells would hold whole regions again
    # cutting did not help: all pairs of bounded blocks
    block = F.pmod(F.xxhash64("k"), F.col("blocks"))
    pairs = large.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    more(
        pairs.withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .groupBy("region", "low", "high")
        .applyInPandas(join_group, "a bigint, b bigint")
    )
    return edges


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of least id in their component; null ids come last.

    A document is known by id and text, so equal ids do no harm; rows alike in both are one
    document and stay or go together. Only the names of what goes are joined on.
    """
    (name,) = fresh(docs, "document_name")
    place = F.coalesce(col(id_col).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit("9" * 20).cast("decimal(20,0)"))
    text = F.coalesce(col(text_col), F.lit(""))
    named = docs.withColumn(name, F.concat(F.lpad(place.cast("string"), 20, "0"), F.lit("-"), F.hex(F.xxhash64(text))))
    found = join(named.select(col(name).alias("doc_id"), col(text_col).alias("text")))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return named.join(gone, name, "left_anti").select([col(own) for own in docs.columns])


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_runs: int = ISLAND_RUNS,
    most_docs: int = ISLAND_DOCS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: id, n_shingles, class_size, component_id (the least id in its component)."""
    kind = docs.schema[id_col].dataType
    # ids pass through Python as text: a batch with nulls would make floats of integers
    texts = docs.select(col(id_col).cast("string").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    described = written(
        describe(texts, sketch_levels(texts)).withColumn("id", F.col("id").cast(kind)), "jaccard-described"
    )
    whole = described.where("n > 0")
    classes = written(
        whole.groupBy("k").agg(
            F.min("n").alias("n"), F.min("t").alias("t"), F.min("id").alias("least"), F.count(F.lit(1)).alias("class_size")
        ),
        "jaccard-classes",
    )
    placed = written(islands(whole, classes).join(classes.select("k", "n", "t"), "k"), "jaccard-islands")
    ready = placed.join(sets_of(texts, placed), "k")
    ready = written(ready.select(F.col("island").alias("region"), "k", "n", "runs"), "jaccard-sets")
    joined = components(linked(ready, most_runs, most_docs, rounds))
    named = classes.join(joined, classes["k"] == joined["node"], "left")
    groups = written(named.groupBy(F.coalesce("component", "k").alias("group")).agg(F.min("least").alias("component_id")), "jaccard-groups")
    named = written(
        named.withColumn("group", F.coalesce("component", "k")).join(groups, "group").select("k", "class_size", "component_id"),
        "jaccard-named",
    )
    out = whole.select("id", "n", "k").join(named, "k").select("id", "n", "class_size", "component_id")
    empty = described.where("n = 0").select("id", "n", F.lit(1).cast("bigint").alias("class_size"), F.col("id").alias("component_id"))
    return out.unionByName(empty).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_size", "component_id"
    )
