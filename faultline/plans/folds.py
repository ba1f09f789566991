"""Sequential folds over the ordered rows of a key."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.plans.slices import HOT, SLICE, SLICE_ROWS, find_hot, kept, with_slices

BEGIN, EFFECT = "__begin", "__effect"
Step = Callable[[object, tuple], tuple[object, tuple]]
Outline = Callable[[list], object]
Enter = Callable[[object, object], tuple]


def _state(text: str | None) -> tuple | None:
    """A state from its JSON text, in which floats keep all their digits."""
    return None if text is None else tuple(json.loads(text))


def fold_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Step,
    inputs: Sequence[str],
    outputs: Sequence[str],
    schema: str | T.StructType,
    keep: Sequence[str],
    begin: str | None = None,
) -> DataFrame:
    """Run `step(state, input values) -> (state, output values)` along each key.

    The state starts as None per key, or as what the column `begin` says. Keys lie next to each
    other in sorted partitions, which arrive in Arrow batches: memory is bounded by a batch, and
    many short keys cost nothing extra. `keep` columns are passed through.
    """
    keys, inputs, outputs, keep = list(keys), list(inputs), list(outputs), list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = object(), None
        for batch in batches:
            rows = []
            marks = zip(*[batch[key].tolist() for key in keys])
            values = zip(*[batch[name].tolist() for name in inputs])
            starts = batch[begin].tolist() if begin else repeat(None)
            for mark, value, start in zip(marks, values, starts):
                if mark != here:
                    here, state = mark, _state(start)
                state, out = step(state, value)
                rows.append(out)
            made = pd.DataFrame(rows, columns=outputs, index=batch.index, dtype=object)
            yield pd.concat([batch[keep], made], axis=1)

    return (
        df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
    )


def _effects(df: DataFrame, keys: Sequence[str], order: Sequence[str], outline: Outline, inputs: Sequence[str]) -> DataFrame:
    """(keys, `__effect`): what each key's rows do to any state, as text. A key's inputs are held in memory."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, values = None, []
        for batch in batches:
            done = []
            marks = zip(*[batch[key].tolist() for key in keys])
            for mark, value in zip(marks, zip(*[batch[name].tolist() for name in inputs])):
                if mark != here:
                    if here is not None:
                        done.append((*here, json.dumps(outline(values))))
                    here, values = mark, []
                values.append(value)
            if done:
                yield pd.DataFrame(done, columns=[*keys, EFFECT])
        if here is not None:
            yield pd.DataFrame([(*here, json.dumps(outline(values)))], columns=[*keys, EFFECT])

    schema = T.StructType([df.schema[key] for key in keys] + [T.StructField(EFFECT, T.StringType())])
    return df.select(*keys, *order, *[name for name in inputs if name not in order]).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fold_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: Sequence[str],
    step: Step,
    outline: Outline,
    enter: Enter,
    inputs: Sequence[str],
    outputs: Sequence[str],
    schema: str,
    keep: Sequence[str],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """`fold_rows` for keys that may hold most rows; the same result. Step states are tuples of numbers.

    `outline(values)` tells, as something JSON can hold, what a run of rows does to any state, and
    `enter(state, outlined)` the state it leaves after a given one. Hot keys are cut into slices, all
    of which are outlined side by side; then one pass over the outlines, a row per slice, gives the
    state that each slice begins with, and the slices are folded side by side. Every row is read
    twice, whatever the data: nothing is folded again.
    """
    hot = find_hot(df, keys, order, slice_rows)
    by = [order, *tie]
    if not hot:
        return fold_rows(df, keys, by, step, inputs, outputs, schema, keep)
    cut = kept(with_slices(df, keys, order, hot, slice_rows, tie))
    slices = [*keys, SLICE]

    def begin(state: object, value: tuple) -> tuple[object, tuple]:
        return tuple(enter(state, json.loads(value[0]))), (None if state is None else json.dumps(state),)

    effects = _effects(cut.where(HOT), slices, by, outline, inputs)
    fields = [df.schema[key] for key in keys] + [T.StructField(SLICE, T.LongType()), T.StructField(BEGIN, T.StringType())]
    begun = kept(fold_rows(effects, keys, [SLICE], begin, [EFFECT], [BEGIN], T.StructType(fields), slices))
    placed = cut.join(begun, slices, "left")
    return fold_rows(placed, slices, by, step, inputs, outputs, schema, keep, BEGIN)
