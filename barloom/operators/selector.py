"""Screening of symbols on their latest bar."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..plans import Fold, Indicator, indicate
from ..plans.planner import number
from ..sources.loader import to_long

_SORTS = ("price", "return_1d", "return_5d", "return_20d", "volume", "volatility")


def kdj(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """K and D: smoothed by thirds from 50."""
    from ..functions.kernels import stochastic

    out = np.full(len(close), np.nan), np.full(len(close), np.nan)
    k = d = 50.0
    for i, rsv in enumerate(stochastic(high, low, close, period).tolist()):
        if rsv == rsv:
            k = (2 * k + rsv) / 3
            d = (2 * d + k) / 3
            out[0][i], out[1][i] = k, d
    return out


def _over(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


class Selector:
    """Immutable: every call gives a new selector. bars are long (symbol, date, open, high, low, close, volume), or wide
    `{symbol}_{column}`. Conditions are features of a symbol's series, taken at its last bar; all features of a screen are
    computed in one plan. kdj: oversold under 20, overbought over 80 (both lines)."""

    def __init__(self, bars: DataFrame, date_col: str = "date", _features: dict | None = None, _conditions: tuple = (), _order: tuple | None = None) -> None:
        self.bars = bars if "symbol" in bars.columns else to_long(bars, ["open", "high", "low", "close", "volume"], date_col)
        self.date = date_col
        self._features: dict[str, Indicator] = _features or {}
        self._conditions: tuple[Column, ...] = _conditions
        self._order = _order

    def filter(self, price_min=None, price_max=None, volume_min=None, volume_avg_days=None, return_min=None, return_max=None, return_period=1, volatility_min=None, volatility_max=None, volatility_period=20, ma_above=None, ma_below=None, rsi_min=None, rsi_max=None, rsi_period=14, macd=None, macd_fast=12, macd_slow=26, macd_signal=9, kdj=None, kdj_period=9, limit_type=None, limit_threshold=9.9, volume_change=None, volume_multiplier=2.0, volume_change_days=5, consecutive=None, consecutive_days=3, breakout=None, breakout_period=20) -> Selector:
        f, c = dict(self._features), list(self._conditions)

        def feature(name: str, ind: Indicator) -> Column:
            f[name] = ind
            return F.col(f"__{name}")

        def between(x: Column, low, high) -> None:
            if low is not None:
                c.append(x >= low)
            if high is not None:
                c.append(x <= high)

        close = F.col("close")
        between(close, price_min, price_max)
        if volume_min is not None:
            c.append((feature(f"va{volume_avg_days}", I.SMA("volume", volume_avg_days)) if volume_avg_days else F.col("volume")) >= volume_min)
        if return_min is not None or return_max is not None:
            between(feature(f"ret{return_period}", I.ROC("close", return_period)), return_min, return_max)
        if volatility_min is not None or volatility_max is not None:
            between(feature(f"vol{volatility_period}", _volatility(volatility_period)), volatility_min, volatility_max)
        if ma_above:
            c.append(close > feature(f"ma{ma_above}", I.SMA("close", ma_above)))
        if ma_below:
            c.append(close < feature(f"ma{ma_below}", I.SMA("close", ma_below)))
        if rsi_min is not None or rsi_max is not None:
            between(feature(f"rsi{rsi_period}", I.RSI("close", rsi_period)), rsi_min, rsi_max)
        if macd:
            m = feature(f"macd{macd_fast}_{macd_slow}_{macd_signal}", _crossing(I.MACD("close", macd_fast, macd_slow, macd_signal), "macd", "macd_signal"))
            c.append(_pick(macd, {"golden_cross": m["up"] == 1, "death_cross": m["down"] == 1, "above_zero": m["a"] > 0, "below_zero": m["a"] < 0}))
        if kdj:
            m = feature(f"kdj{kdj_period}", _crossing(kdj_lines(kdj_period), "k", "d"))
            c.append(_pick(kdj, {"golden_cross": m["up"] == 1, "death_cross": m["down"] == 1, "oversold": (m["a"] < 20) & (m["b"] < 20), "overbought": (m["a"] > 80) & (m["b"] > 80)}))
        if limit_type:
            r, near = feature("ret1", I.ROC("close", 1)), 0.9 * limit_threshold
            c.append(_pick(limit_type, {"limit_up": r >= limit_threshold, "limit_down": r <= -limit_threshold, "near_limit_up": (r >= near) & (r < limit_threshold), "near_limit_down": (r <= -near) & (r > -limit_threshold)}))
        if volume_change:
            v = _over(F.col("volume"), feature(f"vp{volume_change_days}", _before("volume", volume_change_days, F.avg)))
            c.append(_pick(volume_change, {"volume_surge": v >= volume_multiplier, "volume_shrink": v <= 1 / volume_multiplier}))
        if consecutive:
            _pick(consecutive, {"consecutive_up": 1, "consecutive_down": 1})
            c.append(feature(f"{consecutive}{consecutive_days}", _run(consecutive == "consecutive_up", consecutive_days)) == consecutive_days)
        if breakout:
            _pick(breakout, {"breakout_high": 1, "breakdown_low": 1})
            up = breakout == "breakout_high"
            edge = feature(f"{breakout}{breakout_period}", _before("high" if up else "low", breakout_period, F.max if up else F.min))
            c.append(close > edge if up else close < edge)
        return Selector(self.bars, self.date, f, tuple(c), self._order)

    def sort(self, by: str, ascending: bool = False, top_n: int | None = None) -> Selector:
        if by not in _SORTS:
            raise ValueError(f"cannot sort by {by}")
        return Selector(self.bars, self.date, self._features, self._conditions, (by, ascending, top_n))

    def reset(self) -> Selector:
        return Selector(self.bars, self.date)

    def info(self) -> DataFrame:
        """15 columns for each symbol that passes."""
        own = {"return_1d": I.ROC("close", 1), "return_5d": I.ROC("close", 5), "return_20d": I.ROC("close", 20), "volatility": _volatility(20), "ma_5": I.SMA("close", 5), "ma_10": I.SMA("close", 10), "ma_20": I.SMA("close", 20), "__v5": I.SMA("volume", 5)}
        rows = indicate(self.bars.select("symbol", self.date, "open", "high", "low", "close", "volume"), ["symbol"], [self.date], **own, **{f"__{k}": v for k, v in self._features.items()})
        last = rows.withColumn("__last", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col(self.date).desc()))).where("__last = 1")
        for condition in self._conditions:
            last = last.where(condition)
        close = F.col("close")
        out = last.select("symbol", close.alias("price"), "open", "high", "low", "volume", "return_1d", "return_5d", "return_20d", "volatility", "ma_5", "ma_10", "ma_20", _over(F.col("volume"), F.col("__v5")).alias("volume_ratio"), (100 * _over(F.col("high") - F.col("low"), close)).alias("amplitude"))
        if self._order:
            by, ascending, top_n = self._order
            out = out.orderBy(F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last(), "symbol")
            out = out.limit(top_n) if top_n is not None else out
        return out

    def result(self) -> list[str]:
        """The symbols that pass."""
        return [r["symbol"] for r in self.info().select("symbol").collect()]


def _pick(name: str, of: dict):
    if name not in of:
        raise ValueError(f"unknown condition: {name}; one of {', '.join(of)}")
    return of[name]


def _volatility(period: int) -> Indicator:
    """Yearly deviation of daily returns, in percent."""
    from ..plans import Native

    x = number("close")
    return Native(lambda s, t: [{"__ret": _over(x - s.lag(x), s.lag(x))}, {"": 100 * F.sqrt(F.lit(252.0)) * s.full(F.col("__ret"), period, F.stddev_samp)}])


def _before(col: str, period: int, agg) -> Indicator:
    """agg over the `period` bars before the current one."""
    from ..plans import Native

    def stages(s, t):
        w = s.window().rowsBetween(-period, -1)
        return [{"": F.when(F.count(number(col)).over(w) >= period, agg(number(col)).over(w))}]

    return Native(stages)


def _run(up: bool, days: int) -> Indicator:
    """How many of the last `days` closes rose (or fell)."""
    from ..plans import Native

    x = number("close")

    def stages(s, t):
        moved = x > s.lag(x) if up else x < s.lag(x)
        return [{f"__moved_{up}": F.when(moved, 1).otherwise(0)}, {"": F.sum(f"__moved_{up}").over(s.last(days))}]

    return Native(stages)


def kdj_lines(period: int) -> Fold:
    return Fold([number("high"), number("low"), number("close")], lambda h, l, c: kdj(h, l, c, period), ("k", "d"))


def _crossing(fold: Fold, a: str, b: str) -> Fold:
    """The fold's two lines, and where the first crosses the second."""
    i, j = fold.outputs.index(a), fold.outputs.index(b)
    kernel = fold.kernel  # alone: a fold holds Columns, which workers cannot take

    def run(*xs):
        out = kernel(*xs)
        x, y = out[i], out[j]
        d = x - y
        last = np.concatenate(([np.nan], d[:-1])) if len(d) else d
        return x, y, ((last <= 0) & (d > 0)).astype(float), ((last >= 0) & (d < 0)).astype(float)

    return Fold(fold.inputs, run, ("a", "b", "up", "down"))
