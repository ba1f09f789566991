"""Hard negatives by angular triangle filtering.

Every row stores its angle to each of REFERENCES directions (centres of a bounded sample). For an
anchor at angles a and a row at angles t, the triangle inequality on the sphere puts the angle
between them into

    [max |a - t|, min(a + t, 2 pi - a - t)]    over all references,

which gives an interval of its cosine and, multiplied by both norms and rounded outwards, one of
its score. Only rows whose interval reaches a window that is asked for are scored, in whole numbers.

Rows lie in cells of one nearest reference and one of SLOTS groups of labels, ordered by the angle
to that reference. For an anchor a cell then offers one stretch of rows, found by binary search
from the smallest and largest norm in it; the other references thin that out. Whole cells are
left out by the range of their angles in the same way.

Positives are the best rows of the anchor's label: a first round over the cells next to the anchor
gives its worst kth score, a second one takes what can still reach that. Each positive's score opens
a window; equal scores share one. Negatives are the best rows of other labels in each window.
Cells share bins and large ones are cut into blocks, so no task grows with a cell or a label.

Where an id is divisible by SHIFTED the label first becomes (label + 1) % 10. An anchor is no
positive of its own, but other rows of its id are. Rows that repeat count each; two anchor rows of
one id are two anchors. Ties go to the smaller id. A vector of zeros has score 0 with all. Shorter
vectors count as zero beyond their end. Null ids, labels, vectors and components, and non-finite
components take no part; empty tables give an empty result. Scores beyond 64 bits become the
nearest 64-bit number, and are compared as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import vectors
from faultline.llm.tables import col, written

SAMPLE = 4_096
REFERENCES = 8
SLOTS = 16
SHIFTED = 7
POSITIVES = 5
NEGATIVES = 3
SEEDED = 8  # rows per positive in the first round
BLUR = 1e-7  # of an angle: cosines near 1 lose half their digits
SLACK = 1e-9  # of a score
MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
FOUND = "asked bigint, vec_id bigint, score bigint"
POINT = "vec_id bigint, v array<double>, label bigint, asks boolean, rid bigint, leaf bigint, norm double, angles array<double>"


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and norms; components are scaled first, so that no square overflows."""
    most = np.abs(rows).max(axis=1, initial=0)
    scaled = rows / np.where(most > 0, most, 1)[:, None]
    length = np.linalg.norm(scaled, axis=1)
    with np.errstate(over="ignore"):
        return scaled / np.where(length > 0, length, 1)[:, None], np.nan_to_num(length * most, posinf=vectors.LARGEST)


def references(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Directions around which the sample gathers: farthest-first starts, then means of what is nearest."""
    rows, norms = unit(sample)
    rows = rows[norms > 0]
    if not len(rows):
        return np.eye(1, sample.shape[1])
    chosen, near = [rows[0]], rows @ rows[0]
    while len(chosen) < count and near.min() < 1 - 1e-9:
        chosen.append(rows[near.argmin()])
        near = np.maximum(near, rows @ chosen[-1])
    out = np.stack(chosen)
    for _ in range(rounds):
        own = (rows @ out.T).argmax(1)
        sums = np.stack([rows[own == n].sum(0) for n in range(len(out))])
        fine = np.linalg.norm(sums, axis=1) > 1e-6
        out[fine] = unit(sums[fine])[0]
    return out


def angles_to(rows: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of all rows to all directions, and the rows' norms; zeros stand at right angles."""
    own, norms = unit(rows)
    return np.arccos(np.clip(own @ directions.T, -1, 1)), norms


def reach(low: float, high: float, norm: float, least: float, most: float) -> tuple[float, float]:
    """Angles that scores from `low` to `high` allow for rows with norms from `least` to `most`."""

    def angle(score: float, row: float) -> float:
        size = norm * row
        return float(np.arccos(min(1.0, max(-1.0, score / size)))) if size > 0 else (0.0 if score > 0 else np.pi)

    # the widest cosines: a positive score divides by the largest norm at the low end, a negative one by the least
    far = angle(low - 1 - SLACK * abs(low), most if low > 0 else least)
    close = angle(high + 1 + SLACK * abs(high), least if high > 0 else most)
    if norm * least <= 0:
        close = 0.0
        far = np.pi if low <= 0 else far
    return max(0.0, close - BLUR), min(np.pi, far + BLUR)


def stretch(near: float, close: float, far: float) -> tuple[float, float]:
    """Angles to a reference that rows between `close` and `far` from an anchor at `near` can have."""
    return max(near - far, close - near) - BLUR, min(near + far, 2 * np.pi - close - near) + BLUR


def score_bounds(anchor: np.ndarray, norm: float, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores that rows at these angles and norms can have, rounded outwards."""
    close = np.maximum(np.abs(angles - anchor).max(1) - BLUR, 0)
    both = angles + anchor
    far = np.minimum(np.minimum(both, 2 * np.pi - both).min(1) + BLUR, np.pi)
    with np.errstate(over="ignore"):
        size = np.minimum(norm * norms, vectors.LARGEST)
    return np.floor(size * np.cos(far) - SLACK * size), np.ceil(size * np.cos(close) + SLACK * size)


class Cell:
    """Rows of one leaf in a block, ordered by the angle to their nearest reference."""

    def __init__(self, rows: pd.DataFrame, reference: int, width: int):
        angles = np.stack(rows["angles"].to_numpy())
        order = np.argsort(angles[:, reference], kind="stable")
        rows = rows.iloc[order]
        self.angles, self.reference = angles[order], reference
        self.own = np.ascontiguousarray(self.angles[:, reference])
        self.v = vectors.matrix(rows["v"], width)
        self.ids, self.rids, self.labels, self.norms = (rows[x].to_numpy() for x in ("vec_id", "rid", "label", "norm"))
        self.least, self.most = self.norms.min(), self.norms.max()

    def scored(self, v: np.ndarray, angles: np.ndarray, norm: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the rows that can score between `low` and `high`."""
        first, last = stretch(angles[self.reference], *reach(low, high, norm, self.least, self.most))
        first, last = np.searchsorted(self.own, first), np.searchsorted(self.own, last, side="right")
        if first >= last:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lower, upper = score_bounds(angles, norm, self.angles[first:last], self.norms[first:last])
        at = first + np.flatnonzero((upper >= low) & (lower <= high))
        rows = self.v[first:last] if len(at) == last - first else self.v[at]
        return at, vectors.products(v[None], rows)[0]


def cells_of(rows: pd.DataFrame, width: int) -> dict[int, Cell]:
    return {leaf: Cell(here, int(leaf) // SLOTS, width) for leaf, here in rows.groupby("leaf")}


def positives_met(rows: pd.DataFrame, asking: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """Each anchor's own best rows of its label in a block."""
    cells, out = cells_of(rows, width), []
    for v, rid, label, norm, angles, floor, leaves in zip(*(asking[x] for x in ("v", "rid", "label", "norm", "angles", "floor", "leaves"))):
        v, low = vectors.matrix([v], width)[0], -np.inf if floor is None or np.isnan(floor) else floor
        found = []
        for leaf in leaves:
            if leaf in cells:
                cell = cells[leaf]
                at, scores = cell.scored(v, angles, norm, max(low, -vectors.LARGEST), vectors.LARGEST)
                fine = (cell.labels[at] == label) & (cell.rids[at] != rid) & (scores >= low)
                found.append((cell.ids[at[fine]], scores[fine]))
        if found:
            ids, scores = (np.concatenate(x) for x in zip(*found))
            top = vectors.best(scores, ids, k)
            out.append(pd.DataFrame({"asked": rid, "vec_id": ids[top], "score": scores[top]}))
    return pd.concat(out) if out else pd.DataFrame({"asked": [], "vec_id": [], "score": []}, dtype="int64")


def negatives_met(rows: pd.DataFrame, asking: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """Each window's own best rows of other labels in a block."""
    cells, out = cells_of(rows, width), []
    for v, rid, label, norm, angles, windows, leaves in zip(*(asking[x] for x in ("v", "rid", "label", "norm", "angles", "windows", "leaves"))):
        v = vectors.matrix([v], width)[0]
        low, high = min(w["low"] for w in windows), max(w["high"] for w in windows)
        found = []
        for leaf in leaves:
            if leaf in cells:
                cell = cells[leaf]
                at, scores = cell.scored(v, angles, norm, low, high)
                fine = cell.labels[at] != label
                found.append((cell.ids[at[fine]], scores[fine]))
        if not found:
            continue
        ids, scores = (np.concatenate(x) for x in zip(*found))
        for w in windows:
            inside = np.flatnonzero((scores >= w["low"]) & (scores <= w["high"]))
            top = inside[vectors.best(scores[inside], ids[inside], k)]
            if len(top):
                out.append(pd.DataFrame({"asked": rid, "positive_score": w["positive_score"], "vec_id": ids[top], "score": scores[top]}))
    return pd.concat(out) if out else pd.DataFrame({"asked": [], "positive_score": [], "vec_id": [], "score": []}, dtype="int64")


def mine(
    df: DataFrame,
    is_anchor,
    factor: int = 256,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). `is_anchor`: a condition on the id."""
    spark = df.sparkSession
    rows = vectors.whole_numbers(df.where(col(label_col).isNotNull()), factor, id_col, vector_col, label_col)
    given = col(label_col).cast("bigint")
    label = F.when(F.col("vec_id") % SHIFTED == 0, (given + 1) % 10).otherwise(given)
    points = rows.select("vec_id", "v", label.alias("label"), is_anchor(F.col("vec_id")).alias("asks"))
    points = written(vectors.numbered(points, "rid"), "mining-points")
    width = points.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], MINED)
    width = max(width, 1)
    sample = points.orderBy(F.xxhash64("rid"), "rid").limit(max(1, min(SAMPLE, vectors.BLOCK_VALUES // width))).toPandas()
    directions = references(vectors.matrix(sample["v"], width), REFERENCES)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            angles, norms = angles_to(vectors.matrix(batch["v"], width), directions)
            nearest = angles.argmin(1) if len(batch) else np.zeros(0, int)
            yield batch.drop(columns="slot").assign(leaf=nearest * SLOTS + batch["slot"], norm=norms, angles=list(angles))

    slotted = points.withColumn("slot", F.pmod(F.xxhash64("label"), F.lit(SLOTS)))
    placed = written(slotted.mapInPandas(place, POINT), "mining-placed")
    # at most REFERENCES * SLOTS rows: sizes, norms and the range of each angle
    spread = [f(F.col("angles")[n]).alias(f"{f.__name__}{n}") for n in range(len(directions)) for f in (F.min, F.max)]
    cells = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"), *spread).collect()
    cells = {c["leaf"]: c for c in cells}
    sizes = {leaf: c["n"] for leaf, c in cells.items()}
    lows = np.asarray([[cells[leaf][f"min{n}"] for n in range(len(directions))] for leaf in sorted(cells)])
    highs = np.asarray([[cells[leaf][f"max{n}"] for n in range(len(directions))] for leaf in sorted(cells)])
    names = np.asarray(sorted(cells))
    norms = np.asarray([[cells[leaf]["least"], cells[leaf]["most"]] for leaf in names])
    homes = vectors.binned(sorted(sizes), sizes, max(1, min(vectors.BLOCK_ROWS, vectors.BLOCK_VALUES // width)))

    def open_cells(angles: np.ndarray, norm: float, low: float, high: float) -> np.ndarray:
        """Cells that can hold a row which scores between `low` and `high` with an anchor."""
        close = np.maximum(np.maximum(angles - highs, lows - angles).max(1) - BLUR, 0)
        far = np.minimum(np.minimum(angles + highs, 2 * np.pi - angles - lows).min(1) + BLUR, np.pi)
        with np.errstate(over="ignore"):
            size = np.minimum(norm * norms, vectors.LARGEST)
        upper = (size * np.cos(close)[:, None] + SLACK * size).max(1) + 1
        lower = (size * np.cos(far)[:, None] - SLACK * size).min(1) - 1
        return names[(upper >= low) & (lower <= high)]

    anchors = placed.where("asks").select("rid", "vec_id", "v", "label", "norm", "angles", F.col("leaf").alias("home"))
    # an anchor asks for its own list of cells, so each stands as a leaf of its own in the pairs
    ask = F.col("rid").alias("leaf")
    rows = placed.select("rid", "vec_id", "v", "label", "norm", "angles", "leaf")

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, home, angles in zip(batch["rid"], batch["home"], batch["angles"]):
                own = names[names % SLOTS == home % SLOTS]
                order = own[np.argsort(angles[own // SLOTS], kind="stable")]
                held = np.cumsum([sizes[leaf] for leaf in order])
                out += [(rid, leaf) for leaf in order[: int(np.searchsorted(held, SEEDED * positives)) + 1]]
            yield pd.DataFrame(out, columns=["q_leaf", "leaf"], dtype="int64")

    def reaching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, home, angles, norm, floor, seen in zip(*(batch[x] for x in ("rid", "home", "angles", "norm", "floor", "seen"))):
                low = -vectors.LARGEST if floor is None or np.isnan(floor) else floor
                fine = open_cells(angles, norm, low, vectors.LARGEST)
                seen = set(seen)
                out += [(rid, leaf) for leaf in fine if leaf % SLOTS == home % SLOTS and leaf not in seen]
            yield pd.DataFrame(out, columns=["q_leaf", "leaf"], dtype="int64")

    def overlapping(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, angles, norm, windows in zip(*(batch[x] for x in ("rid", "angles", "norm", "windows"))):
                wanted = {leaf for w in windows for leaf in open_cells(angles, norm, w["low"], w["high"])}
                out += [(rid, leaf) for leaf in sorted(wanted)]
            yield pd.DataFrame(out, columns=["q_leaf", "leaf"], dtype="int64")

    pairs = "q_leaf bigint, leaf bigint"

    def best_of(asking: DataFrame, wanted: DataFrame) -> DataFrame:
        asking = asking.select("rid", "v", "label", "norm", "angles", "floor", ask)
        return vectors.in_blocks(rows, asking, wanted, homes, lambda ours, theirs: positives_met(ours, theirs, width, positives), FOUND)

    order = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    first = written(anchors.select("rid", "home", "angles").mapInPandas(seeds, pairs), "mining-seeds")
    found = written(best_of(anchors.withColumn("floor", F.lit(None).cast("double")), first), "mining-first")
    kth = found.withColumn("place", order).where(F.col("place") == positives).select(F.col("asked").alias("rid"), F.col("score").cast("double").alias("floor"))
    seen = first.groupBy(F.col("q_leaf").alias("rid")).agg(F.collect_list("leaf").alias("seen"))
    asking = written(anchors.join(kth, "rid", "left").join(seen, "rid"), "mining-floors")
    second = asking.select("rid", "home", "angles", "norm", "floor", "seen").mapInPandas(reaching, pairs)
    every = found.unionByName(best_of(asking, written(second, "mining-reaching")))
    near = every.withColumn("place", order).where(F.col("place") <= positives)
    near = written(near.select("asked", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "mining-positives")

    # 50 p <= 100 n <= 95 p in whole numbers
    p = F.col("positive_score").cast("decimal(20,0)")
    window = F.struct("positive_score", F.ceil(p / 2).cast("bigint").alias("low"), F.floor(p * 19 / 20).cast("bigint").alias("high"))
    windows = near.select("asked", window.alias("w")).where("w.low <= w.high").groupBy(F.col("asked").alias("rid"))
    windows = windows.agg(F.collect_set("w").alias("windows"))  # at most one per positive
    asking = written(anchors.join(windows, "rid"), "mining-windows")
    wanted = written(asking.select("rid", "angles", "norm", "windows").mapInPandas(overlapping, pairs), "mining-overlapping")
    met = vectors.in_blocks(
        rows,
        asking.select("rid", "v", "label", "norm", "angles", "windows", ask),
        wanted,
        homes,
        lambda ours, theirs: negatives_met(ours, theirs, width, negatives),
        "asked bigint, positive_score bigint, vec_id bigint, score bigint",
    )
    best = Window.partitionBy("asked", "positive_score").orderBy(F.desc("score"), "vec_id")
    hard = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    ids = anchors.select(F.col("rid").alias("asked"), F.col("vec_id").alias("anchor_id"))
    return near.join(hard, ["asked", "positive_score"]).join(ids, "asked").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
