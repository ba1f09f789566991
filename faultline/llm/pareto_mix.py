"""Mixing sources to target weights by Pareto order sampling.

Sources in code point order, null last, get the weights 5, 2, 1, repeating, and share all words;
a target stops at three times its source's words and the excess is reshared by weight. With
r = target / source words, every document first gets floor(r) certain copies. What is left is the
inclusion probability p = r - floor(r). Documents are ranked by their random odds u / (1 - u)
over their inclusion odds p / (1 - p), u being a hash of id and text, and the first ones get one
more copy until the source's words are reached (the last where more than half of it fits).

The boundary of each source is found in two histogram rounds, pre-aggregated before they shuffle,
and one ordered pass over the few rows in the boundary's cell; no source meets in one task.
Null texts and texts of white space have no words and are never taken. Null is a source of its
own. Reruns agree: rows alike in id and text tie, and then any of them serve. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.tables import col, written

SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document, and times its words that a source may give
BINS = 4096  # per histogram round; 2^24 cells for each source
BROADCAST_SOURCES = 100_000  # rows of a few numbers and a name; with more, sources are joined by shuffle
DRAW_BITS = 52


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    first = (F.element_at(parts, 1) == "").cast("int")
    last = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - first - last).cast("bigint")


def draw(id_: Column, text: Column) -> Column:
    """A number below 2^52 from the row's id and text."""
    key = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place in code point order, from 0, without gathering them."""
    ordered = written(
        sources.orderBy(F.col("source").asc_nulls_last()).select(
            "*",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
        ),
        "mix-sources",
    )
    # one row per partition of the sort
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", ahead.alias("start"))
    return ordered.join(F.broadcast(starts), "part").select("source", "source_size", (F.col("start") + F.col("at")).alias("place"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, chance, need) of rows with `source` and `size`.

    The excess above the limits is reshared in rounds; each is one aggregate over the sources, of
    which only three totals come back.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    ranked = written(_ranked(sources).withColumn("weight", weight.cast("bigint")), "mix-ranked")
    limit = F.col("source_size") * MOST
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weights, capped, capped_weight = total or 0, weights or 0, 0, 0
    while True:
        above = limit * F.lit(weights - capped_weight) < F.col("weight") * F.lit(total - capped)
        more, more_weight = ranked.where(above).agg(F.sum(limit), F.sum("weight")).first()
        if (more or 0, more_weight or 0) == (capped, capped_weight):
            break
        capped, capped_weight = more or 0, more_weight or 0
    share = F.col("weight") * F.lit(total - capped) / F.lit(float(max(weights - capped_weight, 1)))
    target = F.when(above, limit.cast("double")).otherwise(share)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        ranked.select("source", "source_size", target.alias("target"))
        .withColumn("whole", F.floor(ratio))
        .withColumn("chance", ratio - F.col("whole"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    )


def _beside(df: DataFrame, per_source: DataFrame, source: str) -> DataFrame:
    """Join source rows on, by broadcast only when they are few."""
    side = F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source
    return df.join(side, col(source).eqNullSafe(side["source"]), "left")


def _rank(drawn: Column, chance: Column) -> Column:
    """Pareto rank: random odds over inclusion odds; null where nothing is left to chance."""
    u = (drawn + F.lit(0.5)) / F.lit(float(1 << DRAW_BITS))
    return (u / (F.lit(1.0) - u)) / F.when(chance > 0, chance / (F.lit(1.0) - chance))


def _cell(rank: Column) -> tuple[Column, Column]:
    """Two bins that keep the order of ranks; ranks near 1, where boundaries lie, fall in the middle."""
    scaled = rank / (rank + 1) * BINS
    coarse = F.least(F.floor(scaled), F.lit(BINS - 1))
    return coarse, F.least(F.floor((scaled - coarse) * BINS), F.lit(BINS - 1))


def _crossing(hist: DataFrame, by: str, need: Column) -> DataFrame:
    """Per source the bin in which running words reach the need, and the words before it."""
    run = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    running = hist.withColumn("upto", F.sum("words").over(run))
    return running.where((F.col("upto") - F.col("words") < need) & (F.col("upto") >= need)).withColumn(
        "before", F.col("upto") - F.col("words")
    )


def cuts(sized: DataFrame) -> DataFrame:
    """`targets` with the boundary cell (coarse, fine) of each source and the words still to take in it.

    `sized` has source, size, drawn; it is read three times, so hand in a written table.
    """
    plan = written(targets(sized), "mix-targets")
    coarse, fine = _cell(F.col("rank"))
    drawn = _beside(sized.withColumnRenamed("source", "own"), plan.where("chance > 0"), "own").where("source_size IS NOT NULL")
    drawn = drawn.withColumn("rank", _rank(F.col("drawn"), F.col("chance"))).withColumn("coarse", coarse)
    hist = drawn.groupBy("source", "need", "coarse").agg(F.sum("size").alias("words"))
    first = written(_crossing(hist, "coarse", F.col("need")), "mix-coarse").select(
        "source", F.col("coarse").alias("coarse_cut"), (F.col("need") - F.col("before")).alias("left_coarse")
    )
    inside = _beside(drawn.drop("source"), first, "own").where("coarse = coarse_cut").withColumn("fine", fine)
    hist = inside.groupBy("source", "left_coarse", "coarse_cut", "fine").agg(F.sum("size").alias("words"))
    second = _crossing(hist, "fine", F.col("left_coarse")).select(
        F.col("source").alias("cut_source"),
        "coarse_cut",
        F.col("fine").alias("fine_cut"),
        (F.col("left_coarse") - F.col("before")).alias("left"),
    )
    return written(
        plan.join(second, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"), "mix-cuts"
    )


def with_copies(
    docs: DataFrame, cut: DataFrame, out: str, id_col: str, source_col: str, size: str, drawn: str
) -> DataFrame:
    """`docs` beside the columns of `cut`, with the number of copies taken as column `out`.

    `docs` must not have columns named like those of `cut` (or `upto`); callers see to that.
    """
    both = _beside(docs, cut, source_col)
    rank = _rank(col(drawn), F.col("chance"))
    coarse, fine = _cell(rank)
    inside = F.coalesce((coarse == F.col("coarse_cut")) & (fine == F.col("fine_cut")), F.lit(False))
    ahead = (coarse < F.col("coarse_cut")) | ((coarse == F.col("coarse_cut")) & (fine < F.col("fine_cut")))
    clear = both.where(~inside).withColumn(
        out, F.col("whole") + F.when(F.coalesce(ahead, F.lit(False)), 1).otherwise(0)
    )
    # a handful of rows per source
    run = Window.partitionBy(cut["source"]).orderBy(rank, col(id_col), col(size))
    edge = (
        both.where(inside)
        .withColumn("upto", F.sum(col(size)).over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(out, F.col("whole") + F.when(F.col("upto") - col(size) / 2 <= F.col("left"), 1).otherwise(0))
        .drop("upto")
    )
    return clear.unionByName(edge)


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        col(id_col).alias(id_col),
        col(source_col).alias("source"),
        word_count(col(text_col)).alias("size"),
        draw(col(id_col), col(text_col)).alias("drawn"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    sized = written(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    chosen = with_copies(sized.withColumnRenamed("source", "own_source"), cuts(sized), "copies", id_col, "own_source", "size", "drawn")
    return chosen.select(id_col, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, with all their columns, each as often as it is taken."""
    cut = cuts(written(sizes(docs, id_col, text_col, source_col), "mix-sizes"))
    inner = [f"c{n}" for n in range(len(docs.columns))]  # plain names, so that none clashes
    named = docs.toDF(*inner)
    place = dict(zip(docs.columns, inner))
    own = named.withColumn("words", word_count(F.col(place[text_col]))).withColumn(
        "luck", draw(F.col(place[id_col]), F.col(place[text_col]))
    )
    chosen = with_copies(own, cut, "copies", place[id_col], place[source_col], "words", "luck")
    return (
        chosen.where("copies > 0 AND words > 0")
        .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
        .select(*inner)
        .toDF(*docs.columns)
    )
