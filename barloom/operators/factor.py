"""Cross-sectional factors: columns, evaluation, single- and multi-factor tests.

Everything of one date is a group; statistics pre-aggregate, ranks and quantiles are windows by date. p-values come from
Student's t in a vectorized function over the few rows of a result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..plans import indicate
from ..session import ship
from .statistics import least_squares, linear, normal_equations, student_p


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


def _p(t: str, dof: str) -> Column:
    @F.pandas_udf("double")
    def p(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else student_p(float(a), float(b)) for a, b in zip(t, dof, strict=True)], dtype="float64")

    return p(F.col(t), F.col(dof).cast("double"))


class Factor:
    """Methods take and return DataFrames. time_col and id_col name the panel's keys where a method needs them."""

    # columns

    def ratio(self, df: DataFrame, numerator: str, denominator: str, out: str) -> DataFrame:
        return df.withColumn(out, _ratio(F.col(numerator).cast("double"), F.col(denominator).cast("double")))

    def diff(self, df: DataFrame, a: str, b: str, out: str, normalize: bool = False) -> DataFrame:
        """a - b, or (a - b) / |b|."""
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        return df.withColumn(out, _ratio(x - y, F.abs(y)) if normalize else x - y)

    def weighted(self, df: DataFrame, col: str, weight: str, out: str, by: list[str] | None = None) -> DataFrame:
        """Weighted mean of the group, on each of its rows."""
        w = Window.partitionBy(*(by or []))
        both = F.col(col).isNotNull() & F.col(weight).isNotNull()
        return df.withColumn(out, _ratio(F.sum(F.when(both, F.col(col).cast("double") * F.col(weight))).over(w), F.sum(F.when(both, F.col(weight).cast("double"))).over(w)))

    def normalize(self, df: DataFrame, col: str, method: str, out: str, by: list[str] | None = None) -> DataFrame:
        """zscore, minmax or quantile (share of the others that are smaller)."""
        w, x = Window.partitionBy(*(by or [])), F.col(col).cast("double")
        if method == "zscore":
            return df.withColumn(out, _ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w)))
        if method == "minmax":
            return df.withColumn(out, _ratio(x - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)))
        if method == "quantile":
            return df.withColumn(out, F.when(x.isNotNull(), F.percent_rank().over(Window.partitionBy(*(by or []), x.isNull()).orderBy(x))))
        raise ValueError(f"unknown method: {method}")

    def rank(self, df: DataFrame, col: str, out: str, ascending: bool = True, pct: bool = False, by: list[str] | None = None) -> DataFrame:
        """1 to n, ties share the smallest; pct: 0 to 1."""
        x = F.col(col)
        w = Window.partitionBy(*(by or []), x.isNull()).orderBy(x.asc() if ascending else x.desc())
        return df.withColumn(out, F.when(x.isNotNull(), F.percent_rank().over(w) if pct else F.rank().over(w)))

    def moving_average(self, df: DataFrame, col: str, period: int, out: str, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("date",)) -> DataFrame:
        return indicate(df, keys, order, **{out: I.SMA(col, period)})

    def momentum(self, df: DataFrame, col: str, period: int, out: str, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("date",)) -> DataFrame:
        return indicate(df, keys, order, **{out: I.ROCP(col, period)})

    def _moves(self, df: DataFrame, col: str, keys, order) -> tuple[Column, object]:
        w = Window.partitionBy(*keys).orderBy(*order)
        x = F.col(col).cast("double")
        return _ratio(x - F.lag(x).over(w), F.lag(x).over(w)), w

    def volatility(self, df: DataFrame, col: str, period: int, out: str, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("date",)) -> DataFrame:
        """Sample deviation of the last `period` returns."""
        r, w = self._moves(df, col, keys, order)
        frame, x = w.rowsBetween(1 - period, 0), F.col("__r")
        return df.withColumn("__r", r).withColumn(out, F.when(F.count(x).over(frame) >= period, F.stddev_samp(x).over(frame))).drop("__r")

    def skewness(self, df: DataFrame, col: str, period: int, out: str, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("date",)) -> DataFrame:
        """Skewness of the last `period` returns."""
        r, w = self._moves(df, col, keys, order)
        frame, x = w.rowsBetween(1 - period, 0), F.col("__r")
        return df.withColumn("__r", r).withColumn(out, F.when(F.count(x).over(frame) >= period, F.skewness(x).over(frame))).drop("__r")

    def relative_strength(self, df: DataFrame, col: str, period: int, out: str, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("date",)) -> DataFrame:
        return indicate(df, keys, order, **{out: I.RSI(col, period)})

    # evaluation

    def _daily_ic(self, df: DataFrame, factor_col: str, return_col: str, time_col: str, method: str = "pearson", more: tuple[str, ...] = ()) -> DataFrame:
        """(time_col, more..., ic, n) over rows that have both."""
        both = df.where(F.col(factor_col).isNotNull() & F.col(return_col).isNotNull()).select(time_col, *more, F.col(factor_col).cast("double").alias("__f"), F.col(return_col).cast("double").alias("__r"))
        if method == "spearman":
            keys = [time_col, *more]
            mean_rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0
            both = both.withColumns({"__a": mean_rank("__f"), "__b": mean_rank("__r")}).select(*keys, F.col("__a").alias("__f"), F.col("__b").alias("__r"))
        elif method != "pearson":
            raise ValueError(f"unknown method: {method}")
        varied = (F.stddev_pop("__f") > 0) & (F.stddev_pop("__r") > 0)
        return both.groupBy(time_col, *more).agg(F.when(varied, F.corr("__f", "__r")).alias("ic"), F.count(F.lit(1)).alias("n"))

    def ic(self, df: DataFrame, factor_col: str, return_col: str, time_col: str = "date") -> DataFrame:
        """Pearson correlation by date."""
        return self._daily_ic(df, factor_col, return_col, time_col).select(time_col, "ic")

    def rank_ic(self, df: DataFrame, factor_col: str, return_col: str, time_col: str = "date") -> DataFrame:
        """Spearman correlation by date."""
        return self._daily_ic(df, factor_col, return_col, time_col, "spearman").select(time_col, F.col("ic").alias("rank_ic"))

    def ir(self, df: DataFrame, factor_col: str, return_col: str, time_col: str = "date") -> DataFrame:
        """Mean of the ICs over their deviation."""
        return self._daily_ic(df, factor_col, return_col, time_col).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic")).withColumn("ir", _ratio(F.col("mean_ic"), F.col("std_ic")))

    def ic_win_rate(self, df: DataFrame, factor_col: str, return_col: str, time_col: str = "date") -> DataFrame:
        """Share of dates with a positive IC."""
        return self._daily_ic(df, factor_col, return_col, time_col).agg(F.avg(F.when(F.col("ic").isNotNull(), F.when(F.col("ic") > 0, 1.0).otherwise(0.0))).alias("ic_win_rate"))

    def coverage(self, df: DataFrame, factor_col: str, time_col: str = "date") -> DataFrame:
        return df.groupBy(time_col).agg((F.count(factor_col) / F.count(F.lit(1))).alias("coverage"))

    def _buckets(self, df: DataFrame, factor_col: str, n: int, time_col: str, tie: tuple[str, ...]) -> DataFrame:
        ok = df.where(F.col(factor_col).isNotNull())
        return ok.withColumn("quantile", F.ntile(n).over(Window.partitionBy(time_col).orderBy(factor_col, *tie)))

    def quantile(self, df: DataFrame, factor_col: str, return_col: str, n_quantiles: int = 5, time_col: str = "date", id_col: str = "symbol") -> DataFrame:
        """Mean return of each factor bucket (buckets by date)."""
        return self._buckets(df, factor_col, n_quantiles, time_col, (id_col,)).groupBy("quantile").agg(F.avg(return_col).alias("mean_return"), F.count(F.lit(1)).alias("count"))

    def _sides(self, df: DataFrame, factor_col: str, time_col: str, id_col: str, top: float, bottom: float) -> DataFrame:
        """Rows with __long and __short: the top and bottom shares of a date."""
        ok = df.where(F.col(factor_col).isNotNull())
        w = Window.partitionBy(time_col)
        place = F.row_number().over(w.orderBy(F.col(factor_col).desc(), id_col))
        n = F.count(F.lit(1)).over(w)
        return ok.withColumns({"__place": place, "__n": n}).withColumns({"__long": F.col("__place") <= F.floor(F.col("__n") * top), "__short": F.col("__place") > F.col("__n") - F.floor(F.col("__n") * bottom)}).drop("__place", "__n")

    def long_short(self, df: DataFrame, factor_col: str, return_col: str, top_pct: float = 0.2, bottom_pct: float = 0.2, time_col: str = "date", id_col: str = "symbol") -> DataFrame:
        """By date: mean return of the top share less that of the bottom share."""
        sides = self._sides(df, factor_col, time_col, id_col, top_pct, bottom_pct)
        r = F.col(return_col)
        return sides.groupBy(time_col).agg(F.avg(F.when(F.col("__long"), r)).alias("long_return"), F.avg(F.when(F.col("__short"), r)).alias("short_return")).withColumn("ls_return", F.col("long_return") - F.col("short_return"))

    def factor_mimicking_portfolio(self, df: DataFrame, factor_col: str, return_col: str, time_col: str = "date", top_pct: float = 0.3, bottom_pct: float = 0.3, id_col: str = "symbol") -> DataFrame:
        return self.long_short(df, factor_col, return_col, top_pct, bottom_pct, time_col, id_col)

    def turnover(self, df: DataFrame, factor_col: str, top_pct: float = 0.2, time_col: str = "date", id_col: str = "symbol") -> DataFrame:
        """By date: share of the top group that was not in it on the date before; null on the first date."""
        top = self._sides(df, factor_col, time_col, id_col, top_pct, 0.0).where("__long").select(time_col, id_col)
        dates = df.select(time_col).distinct()
        dates = dates.withColumn("__last", F.lag(time_col).over(Window.orderBy(time_col)))
        now = top.join(dates, time_col)
        before = top.select(F.col(time_col).alias("__last"), id_col, F.lit(1).alias("__kept"))
        joined = now.join(before, ["__last", id_col], "left")
        return joined.groupBy(time_col).agg(F.when(F.max("__last").isNotNull(), 1 - F.count("__kept") / F.count(F.lit(1))).alias("turnover"))

    # preparation

    def clean(self, df: DataFrame, factor_cols: list[str], method: str = "orthogonalize") -> DataFrame:
        """orthogonalize: each factor after the first becomes its residual on those before it. neutralize: the residuals
        are added as `{factor}_residual`."""
        if method not in ("orthogonalize", "neutralize"):
            raise ValueError(f"unknown method: {method}")
        for k, col in enumerate(factor_cols[1:], 1):
            name = f"{col}_residual"
            df = linear(df, factor_cols[:k], col, "__pred", name).drop("__pred")
            if method == "orthogonalize":
                df = df.withColumn(col, F.col(name)).drop(name)
        return df

    # tests

    def _tested(self, rows: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
        """keys, mean of value as `out`, t_stat, p_value against zero."""
        ship(rows.sparkSession)
        agg = rows.groupBy(*keys).agg(F.avg(value).alias(out), F.stddev_samp(value).alias("__s"), F.count(value).alias("__n"))
        agg = agg.withColumn("t_stat", _ratio(F.col(out), F.col("__s") / F.sqrt("__n"))).withColumn("__dof", F.col("__n") - 1)
        return agg.withColumn("p_value", _p("t_stat", "__dof")).select(*keys, out, "t_stat", "p_value")

    def ic_test(self, df: DataFrame, factor_col: str, return_col: str, time_col: str = "date", method: str = "pearson") -> DataFrame:
        """(time, ic, t_stat, p_value)."""
        ship(df.sparkSession)
        rows = self._daily_ic(df, factor_col, return_col, time_col, method)
        t = F.when((F.col("n") > 2) & (F.abs("ic") < 1), F.col("ic") * F.sqrt((F.col("n") - 2) / F.when(F.abs("ic") < 1, 1 - F.col("ic") * F.col("ic"))))
        return rows.withColumn("t_stat", t).withColumn("__dof", F.col("n") - 2).withColumn("p_value", _p("t_stat", "__dof")).select(F.col(time_col).alias("time"), "ic", "t_stat", "p_value")

    def portfolio_sorts(self, df: DataFrame, factor_col: str, return_col: str, time_col: str = "date", n_quantiles: int = 5, id_col: str = "symbol") -> DataFrame:
        """(quantile, mean_return, std_return, sharpe) of the buckets' returns by date."""
        daily = self._buckets(df, factor_col, n_quantiles, time_col, (id_col,)).groupBy("quantile", time_col).agg(F.avg(return_col).alias("__r"))
        return daily.groupBy("quantile").agg(F.avg("__r").alias("mean_return"), F.stddev_samp("__r").alias("std_return")).withColumn("sharpe", _ratio(F.col("mean_return"), F.col("std_return")))

    def factor_return(self, df: DataFrame, factor_col: str, return_col: str, time_col: str = "date") -> DataFrame:
        """(time, factor_return: slope of the cross-section, t_stat, p_value)."""
        ship(df.sparkSession)
        x, y = F.col(factor_col).cast("double"), F.col(return_col).cast("double")
        rows = df.groupBy(time_col).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
        s2 = (F.col("syy") - F.col("b") * F.col("sxy")) / F.when(F.col("n") > 2, F.col("n") - 2)
        rows = rows.withColumn("t_stat", F.when((s2 > 0) & (F.col("sxx") > 0), F.col("b") / F.sqrt(s2 / F.when(F.col("sxx") > 0, F.col("sxx"))))).withColumn("__dof", F.col("n") - 2)
        return rows.withColumn("p_value", _p("t_stat", "__dof")).select(F.col(time_col).alias("time"), F.col("b").alias("factor_return"), "t_stat", "p_value")

    def ic_decay(self, df: DataFrame, factor_col: str, return_col: str, time_col: str = "date", id_col: str = "symbol", max_lag: int = 10) -> DataFrame:
        """(lag, ic, t_stat, p_value): IC of the factor with the return `lag` rows on; one pass for all lags."""
        w = Window.partitionBy(id_col).orderBy(time_col)
        ahead = df.withColumn("__ahead", F.array(*(F.struct(F.lit(k).alias("lag"), (F.lead(return_col, k).over(w) if k else F.col(return_col)).cast("double").alias("r")) for k in range(max_lag + 1))))
        rows = ahead.select(time_col, factor_col, F.explode("__ahead").alias("a")).select(time_col, F.col(factor_col), F.col("a.lag").alias("lag"), F.col("a.r").alias("__ret"))
        return self._tested(self._daily_ic(rows, factor_col, "__ret", time_col, "pearson", ("lag",)), "ic", ["lag"], "ic")

    def fama_macbeth(self, df: DataFrame, factor_cols: list[str], return_col: str, time_col: str = "date") -> DataFrame:
        """(factor, mean_coef, t_stat, p_value): cross-sectional regressions by date, then a test of the coefficients' mean."""
        rows = self._regressions(df, factor_cols, return_col, [time_col])
        return self._tested(rows, "coefficient", ["factor"], "mean_coef")

    def time_series_regression(self, df: DataFrame, factor_cols: list[str], return_col: str, id_col: str = "symbol") -> DataFrame:
        """(id, factor, coefficient, t_stat, p_value, r_squared)."""
        rows = self._regressions(df, factor_cols, return_col, [id_col]).withColumn("p_value", _p("t_stat", "dof"))
        return rows.select(F.col(id_col).alias("id"), "factor", "coefficient", "t_stat", "p_value", "r_squared")

    def _regressions(self, df: DataFrame, factor_cols: list[str], return_col: str, keys: list[str]) -> DataFrame:
        """(keys, factor, coefficient, t_stat, r_squared, dof): sums of cross products per group, pre-aggregated, and a
        small solve for each group's one row."""
        ship(df.sparkSession)
        sums = df.groupBy(*keys).agg(F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in normal_equations(factor_cols, return_col))).alias("__sums"))
        names = ["intercept", *factor_cols]
        kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

        def solve(batches):
            for pdf in batches:
                out = []
                for *key, s in pdf[[*keys, "__sums"]].itertuples(index=False, name=None):
                    if fit := least_squares(list(s)):
                        b, r2, errors, n = fit
                        with np.errstate(all="ignore"):
                            t = b / errors
                        out += [(*key, f, float(b[k]), float(t[k]) if math.isfinite(t[k]) else None, float(r2), float(n - len(names))) for k, f in enumerate(names)]
                yield pd.DataFrame(out, columns=[*keys, "factor", "coefficient", "t_stat", "r_squared", "dof"])

        return sums.mapInPandas(solve, f"{kinds}, factor string, coefficient double, t_stat double, r_squared double, dof double")

    def subsample_test(self, df: DataFrame, factor_col: str, return_col: str, time_col: str = "date", n_splits: int = 3) -> DataFrame:
        """(period, start_date, end_date, mean_ic, t_stat, p_value) of equal spans of dates."""
        rows = self._daily_ic(df, factor_col, return_col, time_col).withColumn("period", F.ntile(n_splits).over(Window.orderBy(time_col)))
        span = rows.groupBy("period").agg(F.min(time_col).alias("start_date"), F.max(time_col).alias("end_date"))
        return span.join(self._tested(rows, "ic", ["period"], "mean_ic"), "period").select("period", "start_date", "end_date", "mean_ic", "t_stat", "p_value")

    def subgroup_test(self, df: DataFrame, factor_col: str, return_col: str, group_col: str, time_col: str = "date") -> DataFrame:
        """(group, mean_ic, t_stat, p_value)."""
        rows = self._daily_ic(df, factor_col, return_col, time_col, "pearson", (group_col,))
        return self._tested(rows, "ic", [group_col], "mean_ic").withColumnRenamed(group_col, "group")

    def rolling_ic(self, df: DataFrame, factor_col: str, return_col: str, time_col: str = "date", window: int = 60) -> DataFrame:
        """(time, rolling_ic, rolling_ir) over the last `window` dates."""
        w = Window.orderBy(time_col).rowsBetween(1 - window, 0)
        rows = self._daily_ic(df, factor_col, return_col, time_col).withColumn("__full", F.count("ic").over(w) >= window)
        mean, dev = F.avg("ic").over(w), F.stddev_samp("ic").over(w)
        return rows.select(F.col(time_col).alias("time"), F.when(F.col("__full"), mean).alias("rolling_ic"), F.when(F.col("__full"), _ratio(mean, dev)).alias("rolling_ir"))
