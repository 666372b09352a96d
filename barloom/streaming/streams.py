"""Streams of ticks and bars: the batch library's rules, row by row as data comes in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes", symbol: str = "symbol", ts: str = "ts", price: str = "price", tie: str | None = None) -> DataFrame:
    """(symbol, start, open, high, low, close, volume: number of ticks) of event-time windows; a bar is final, and given
    out in append mode, once the watermark (`late` behind the latest tick) has passed its end. State is a bar per symbol
    and open window."""
    at = F.struct(ts, tie) if tie else F.col(ts)
    bars = ticks.withWatermark(ts, late).groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).alias("w"))
    made = bars.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return made.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def stream_ema(bars: DataFrame, timeperiod: int = 30, symbol: str = "symbol", order: str = "start", value: str = "close") -> DataFrame:
    """(symbol, order, value, ema) of each row, by the rules of functions.EMA: null values are skipped, the mean of the
    first timeperiod seeds it. Rows of a symbol must come in order; within a batch they are sorted. State is three numbers
    a symbol."""
    ship(bars.sparkSession)
    kind = bars.schema[order].dataType.simpleString()
    p, alpha = timeperiod, 2.0 / (timeperiod + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, total, now = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(order, ignore_index=True)
        out = []
        for x in rows[value].tolist():
            if x is None or x != x:
                out.append(None)
                continue
            seen += 1
            if seen < p:
                total += x
            elif seen == p:
                now = (total + x) / p
            else:
                now += alpha * (x - now)
            out.append(now if seen >= p else None)
        state.update((seen, total, now))
        yield pd.DataFrame({symbol: key[0], order: rows[order], value: rows[value], "ema": pd.Series(out, dtype="float64")})

    rows = bars.select(symbol, order, F.col(value).cast("double").alias(value))
    return rows.groupBy(symbol).applyInPandasWithState(step, f"{symbol} string, {order} {kind}, {value} double, ema double", "seen long, total double, now double", "append", "NoTimeout")
