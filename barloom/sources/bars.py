"""Bars from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars_from_ticks(ticks: DataFrame, symbol: Column, bucket: Column, price: Column, order: list[Column], volume: Column | None = None) -> DataFrame:
    """(symbol, bucket, open, high, low, close, volume): first, largest, smallest and last price of a bucket by order.
    One pre-aggregated exchange."""
    at = F.struct(*order)
    rows = ticks.select(symbol.alias("symbol"), bucket.alias("bucket"), price.alias("px"), at.alias("at"), (F.lit(1.0) if volume is None else volume).alias("v"))
    return rows.groupBy("symbol", "bucket").agg(F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"), F.sum("v").alias("volume"))


def epoch_hour(ts: str) -> Column:
    """Whole hours since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def walk_bars(events: DataFrame) -> DataFrame:
    """Hourly bars of a random walk per event type: cumulated cents around 1000, as (symbol, hour, open, high, low, close, volume)."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.sum(F.round((F.col("value") - 50) * 100).cast("long")).over(w)
    ticks = events.select("event_type", "ts", "event_id", ((F.lit(100000) + F.round(cents / 5.0)) / 100.0).alias("px"))
    return bars_from_ticks(ticks, F.col("event_type"), epoch_hour("ts"), F.col("px"), [F.col("ts"), F.col("event_id")]).withColumnRenamed("bucket", "hour")


WALK_BARS_SQL = """
ticks AS (SELECT event_type AS symbol, ts, event_id, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS hour,
  (100000 + round(sum(round((value - 50) * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id)::DOUBLE / 5.0)) / 100.0::DOUBLE AS px FROM events),
bars AS (SELECT symbol, hour, first(px ORDER BY ts, event_id) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM ticks GROUP BY symbol, hour)
"""


#: Prices (cents), shadows (cents) and drifts (cents an hour, over six hours) of jump_bars.
JUMP_LEVELS = (8800, 9400, 9700, 9900, 9998, 10000, 10004, 10300, 10600, 10900)
JUMP_SHADOWS = (0, 0, 3, 60, 700)
JUMP_DRIFTS = (0, -300, 300, -600, 600, -598)


def jump_bars(walk: DataFrame) -> DataFrame:
    """Bars with gaps, long bodies, equal prices and runs, on which candlestick patterns of several bars occur: for each
    bar of walk_bars and each drift one, named symbol + drift, of prices that the walk's own numbers choose.

    A long fall of the walk makes remainders negative. As the SQL's lists do, -1 (place 0) chooses null, and lower ones count
    from the list's end."""
    seed = (F.col("hour") * 48271 + F.round(F.col("open") * 100).cast("long") * 16807 + F.round(F.col("close") * 100).cast("long") * 7919 + F.col("volume").cast("long") * 104729) % 2147483647
    n, m = len(JUMP_LEVELS), len(JUMP_SHADOWS)
    pick = lambda of, by, k: F.element_at(F.array(*map(F.lit, (*of[2:], None, *of))), F.expr(f"int(s div {by} % {k}) + {k}"))  # noqa: E731  # remainders from 1 - k
    rows = walk.select("symbol", "hour", "volume", seed.alias("s"), F.explode(F.array(*map(F.lit, JUMP_DRIFTS))).alias("drift"))
    base = F.col("drift") * (F.col("hour") % 6)
    rows = rows.select("symbol", "hour", "volume", "drift", (base + pick(JUMP_LEVELS, 1, n)).alias("a"), (base + pick(JUMP_LEVELS, n, n)).alias("b"), pick(JUMP_SHADOWS, n * n, m).alias("p"), pick(JUMP_SHADOWS, n * n * m, m).alias("q"))
    price = lambda c: (c / 100.0).cast("double")
    return rows.select(F.concat("symbol", F.col("drift").cast("string")).alias("symbol"), "hour", price(F.col("a")).alias("open"), price(F.greatest("a", "b") + F.col("p")).alias("high"), price(F.least("a", "b") - F.col("q")).alias("low"), price(F.col("b")).alias("close"), "volume")


JUMP_BARS_SQL = f"""
seeds AS (SELECT symbol, hour, volume, unnest({list(JUMP_DRIFTS)}) AS drift, (hour * 48271 + round(open * 100)::BIGINT * 16807 + round(close * 100)::BIGINT * 7919 + volume::BIGINT * 104729) % 2147483647 AS s FROM bars),
cents AS (SELECT symbol, hour, volume, drift, drift * (hour % 6) + {list(JUMP_LEVELS)}[s % 10 + 1] AS a, drift * (hour % 6) + {list(JUMP_LEVELS)}[s // 10 % 10 + 1] AS b, {list(JUMP_SHADOWS)}[s // 100 % 5 + 1] AS p, {list(JUMP_SHADOWS)}[s // 500 % 5 + 1] AS q FROM seeds),
jumps AS (SELECT symbol || drift AS symbol, hour, a / 100.0::DOUBLE AS open, (greatest(a, b) + p) / 100.0::DOUBLE AS high, (least(a, b) - q) / 100.0::DOUBLE AS low, b / 100.0::DOUBLE AS close, volume FROM cents)
"""
