"""Streams give what the batch library gives."""

import pytest
from pyspark.sql import functions as F

from barloom.functions import EMA
from barloom.plans import indicate
from barloom.streaming import stream_bars, stream_ema


@pytest.fixture()
def drained(spark, tmp_path):
    """Rows that a stream has written once its input is used up."""

    def run(df, name):
        query = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    return run


def test_bars(spark, tmp_path, drained):
    ticks = [("a", f"2024-01-01 {h:02}:{m:02}:00", float(10 * h + (m * 7) % 11)) for h in range(4) for m in (50, 5, 20)] + [("b", "2024-01-01 00:30:00", 5.0), ("z", "2024-01-02 00:00:00", 1.0)]
    df = spark.createDataFrame(ticks, "symbol string, ts string, price double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    got = drained(stream_bars(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "bars").collect()
    by = {(r["symbol"], r["start"].hour): r for r in got}
    assert len(by) == len(got) == 5  # z's bar is still open
    for h in range(4):
        prices = {m: float(10 * h + (m * 7) % 11) for m in (5, 20, 50)}
        r = by["a", h]
        assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (prices[5], max(prices.values()), min(prices.values()), prices[50], 3)
    assert by["b", 0]["close"] == 5


def test_ema(spark, tmp_path, drained):
    rows = [(s, t, None if t == 4 else float((t * 7 + len(s)) % 13)) for s in ("x", "yy") for t in range(30)]
    df = spark.createDataFrame(rows, "symbol string, start int, close double")
    for k, part in enumerate(("start < 12", "start >= 12")):  # one file a batch
        df.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    got = {(r["symbol"], r["start"]): r["ema"] for r in drained(stream_ema(stream, 5), "ema").collect()}
    want = {(r["symbol"], r["start"]): r["e"] for r in indicate(df, ["symbol"], ["start"], e=EMA("close", 5)).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or got[k] == pytest.approx(want[k])) for k in want)
