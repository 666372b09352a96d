"""One plan for many indicators.

Native indicators are window and row expressions. Those that build on each other are stages; equal stages of different
indicators are computed once, and all expressions of one level with one window share its sort. Fold indicators are
recursions over a series; all of one request run in a single grouped map. Natives come first, since a window keeps the
partitioning by key that the grouped map needs: a request costs one exchange in all.

A series must fit a worker for folds. Natives only need the rows of a frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship


def number(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


@dataclass(frozen=True)
class Series:
    """What makes rows a series: key columns, and order columns that leave no ties."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    def window(self, *extra: Column):
        return Window.partitionBy(*self.keys, *extra).orderBy(*self.order)

    def last(self, n: int, *extra: Column):
        return self.window(*extra).rowsBetween(1 - n, 0)

    def upto(self):
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.window())

    def full(self, x: Column, n: int, agg: Callable[[Column], Column]) -> Column:
        """agg over the last n rows, null before n non-null values are there."""
        if n < 1:
            return F.lit(None).cast("double")
        w = self.last(n)
        return F.when(F.count(x).over(w) >= n, agg(x).over(w))

    def skipping(self, x: Column, n: int, agg: Callable[[Column], Column]) -> Column:
        """agg over the last n non-null values; null rows stay null and do not count."""
        if n < 1:
            return F.lit(None).cast("double")
        w = self.last(n, x.isNull())
        return F.when(x.isNotNull() & (F.count(x).over(w) >= n), agg(x).over(w))


class Indicator:
    outputs: tuple[str, ...] = ("",)


@dataclass
class Native(Indicator):
    """stages(series, temp) gives levels of named columns; temp(name) is the name a level's column gets. The last level
    holds the outputs: '' alone, or the fields of a struct."""

    stages: Callable[[Series, Callable[[str], str]], list[dict[str, Column]]]


@dataclass
class Fold(Indicator):
    """kernel(*arrays) over a whole series in order (nulls are NaN) gives an array for each output (NaN is null)."""

    inputs: list[Column]
    kernel: Callable[..., Iterable[np.ndarray] | np.ndarray]
    outputs: tuple[str, ...] = ("",)
    types: T.DataType = field(default_factory=T.DoubleType)


def _native(df: DataFrame, series: Series, wanted: dict[str, Native]) -> DataFrame:
    levels: list[dict[str, Column]] = []
    results: dict[str, Column] = {}
    temps: list[str] = []
    for name, ind in wanted.items():
        temp = lambda x, name=name: x if x.startswith("__") else f"__{name}_{x}"
        stages = ind.stages(series, temp)
        for k, stage in enumerate(stages):
            while len(levels) <= k:
                levels.append({})
            if k == len(stages) - 1:
                out = [f"__{name}_out_{o}" for o in stage]
                levels[k].update(dict(zip(out, stage.values(), strict=True)))
                results[name] = F.col(out[0]) if list(stage) == [""] else F.struct(*(F.col(c).alias(o) for c, o in zip(out, stage, strict=True)))
            else:
                levels[k].update({temp(x): c for x, c in stage.items()})
    for level in levels:
        df = df.withColumns(level)
        temps += level
    return df.withColumns(results).drop(*temps)


def _fold(df: DataFrame, series: Series, wanted: dict[str, Fold]) -> DataFrame:
    ship(df.sparkSession)
    kept = df.columns
    inputs = {f"__{name}_{k}": c for name, ind in wanted.items() for k, c in enumerate(ind.inputs)}
    schema = T.StructType(list(df.schema.fields))
    for name, ind in wanted.items():
        schema = schema.add(name, ind.types if ind.outputs == ("",) else T.StructType([T.StructField(o, T.DoubleType()) for o in ind.outputs]))
    order = [(c, "ascending") for c in series.order]
    plan = [(name, len(ind.inputs), ind.kernel, ind.outputs, ind.types == T.IntegerType()) for name, ind in wanted.items()]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=order))
        out = table.select(kept)
        for name, n, kernel, outputs, whole in plan:
            xs = [np.asarray(table.column(f"__{name}_{k}").to_numpy(), np.float64) for k in range(n)]
            got = kernel(*xs)
            if outputs == ("",):
                values = pa.array(got, from_pandas=True)
                out = out.append_column(name, values.cast(pa.int32()) if whole else values)
            else:
                out = out.append_column(name, pa.StructArray.from_arrays([pa.array(g, from_pandas=True) for g in got], list(outputs)))
        return out

    return df.withColumns(inputs).groupBy(*series.keys).applyInArrow(run, schema)


def indicate(df: DataFrame, keys: list[str] | tuple[str, ...], order: list[str] | tuple[str, ...], **wanted: Indicator) -> DataFrame:
    """df with a column for each indicator, a struct where it has several outputs.

    indicate(bars, ["symbol"], ["ts"], sma=SMA("close", 20), macd=MACD("close"))"""
    series = Series(tuple(keys), tuple(order))
    natives = {k: v for k, v in wanted.items() if isinstance(v, Native)}
    folds = {k: v for k, v in wanted.items() if isinstance(v, Fold)}
    if natives:
        df = _native(df, series, natives)
    return _fold(df, series, folds) if folds else df
