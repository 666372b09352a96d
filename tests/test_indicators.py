"""Kernels by hand, and properties of requests: length, warm-up, null rows, order and partition independence."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import candles
from barloom.functions import indicators as I
from barloom.functions import kernels as K
from barloom.plans import indicate

NAN = float("nan")


def test_ema_seed_and_nulls():
    x = np.array([1.0, NAN, 2.0, 3.0, 4.0, NAN, 8.0])
    got = K.ema(x, 3)
    assert np.isnan(got[[0, 1, 2, 5]]).all()
    assert got[3] == 2.0 and got[4] == 3.0 and got[6] == 5.5


@pytest.mark.parametrize("p", [1, 2, 5])
def test_warm_up(p):
    x = np.arange(1.0, 40.0) ** 1.1
    first = lambda y: int(np.flatnonzero(~np.isnan(y))[0])
    assert first(K.ema(x, p)) == p - 1
    assert first(K.dema(x, p)) == 2 * (p - 1)
    assert first(K.tema(x, p)) == (1 if p == 1 else 3 * (p - 1))
    assert first(K.t3(x, p, 0.7)) == 6 * (p - 1)
    assert first(K.kama(x, p)) == 2 * p
    assert len(K.trix(x, p)) == len(x)


@pytest.mark.parametrize("n", [0, 1, 2, 31, 32])
def test_short_series(n):
    x = np.linspace(10, 12, n)
    for f in (lambda: K.rsi(x, 14), lambda: K.macd(x, 12, 26, 9), lambda: K.adx(x + 1, x - 1, x, 14), lambda: K.ht_dcperiod(x), lambda: K.mama(x, 0.5, 0.05), lambda: K.sarext(x + 1, x, 0, 0, 0.02, 0.02, 0.2, 0.02, 0.02, 0.2), lambda: K.atr(x + 1, x - 1, x, 3) if n else x):
        f()
    assert np.isnan(K.ht_dcperiod(x)).sum() == (31 if n == 32 else n)


def test_flat_series():
    x = np.full(30, 5.0)
    assert K.rsi(x, 5)[-1] == 100.0
    assert np.isnan(K.stochastic(x, x, x, 5)).all()
    assert K.accumulation(x, x, x, x).tolist() == [0.0] * 30


def test_sar_by_hand():
    high, low = np.array([10.0, 11.0, 12.0, 12.5, 9.0]), np.array([9.0, 10.0, 11.0, 11.5, 7.0])
    got = abs(K.sarext(high, low, 0, 0, 0.02, 0.02, 0.2, 0.02, 0.02, 0.2))
    assert math.isnan(got[0]) and got[1] == 9.0
    assert got[4] == 12.5  # reversal: the stop is the extreme so far


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(3)
    out = []
    for s, n in (("a", 60), ("b", 45), ("c", 3)):
        p = 100.0
        for t in range(n):
            o = p
            p = max(1.0, p + rng.uniform(-3, 3))
            out.append((s, t, o, max(o, p) + rng.random(), min(o, p) - rng.random(), p, float(rng.randint(1, 9))))
    rng.shuffle(out)
    return spark.createDataFrame(out, "symbol string, ts long, open double, high double, low double, close double, volume double").repartition(7)


def _request():
    return {"sma": I.SMA("close", 5), "ema": I.EMA("close", 5), "macd": I.MACD("close", 3, 6, 2), "cci": I.CCI("high", "low", "close", 5), "rsi": I.RSI("close", 4), "aroon": I.AROON("high", "low", 5), "doji": candles.candle("CDLDOJI"), "mode": I.HT_TRENDMODE("close")}


def _as_dict(df):
    return {(r["symbol"], r["ts"]): r.asDict(True) for r in df.collect()}


def test_request_is_one_exchange_and_keeps_rows(spark, bars):
    df = indicate(bars, ["symbol"], ["ts"], **_request())
    assert df.count() == bars.count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1, plan


def test_series_do_not_touch(spark, bars):
    every = _as_dict(indicate(bars, ["symbol"], ["ts"], **_request()))
    alone = _as_dict(indicate(bars.where("symbol = 'b'"), ["symbol"], ["ts"], **_request()))
    assert alone == {k: v for k, v in every.items() if k[0] == "b"}


def test_null_rows_do_not_count(spark, bars):
    holes = bars.withColumn("close", F.when(F.col("ts") % 4 != 1, F.col("close")))
    wanted = {"sma": I.SMA("close", 3), "ema": I.EMA("close", 3), "wma": I.WMA("close", 3), "bb": I.BBANDS("close", 3), "mid": I.MIDPOINT("close", 3)}
    with_holes = _as_dict(indicate(holes, ["symbol"], ["ts"], **wanted))
    without = _as_dict(indicate(holes.where("close IS NOT NULL"), ["symbol"], ["ts"], **wanted))
    for k, v in with_holes.items():
        if v["close"] is None:
            assert v["sma"] is None and v["ema"] is None and v["wma"] is None
        else:
            assert v["sma"] == pytest.approx(without[k]["sma"]) and v["wma"] == pytest.approx(without[k]["wma"]) and v["ema"] == pytest.approx(without[k]["ema"])


def test_kernels_agree_with_windows(spark, bars):
    got = indicate(bars, ["symbol"], ["ts"], sma=I.SMA("close", 4), wma=I.WMA("close", 4), trima=I.TRIMA("close", 5)).where("symbol = 'a'").orderBy("ts").toPandas()
    x = got["close"].to_numpy()
    for name, want in (("sma", K.sma(x, 4)), ("wma", K.wma(x, 4)), ("trima", K.trima(x, 5))):
        np.testing.assert_allclose(got[name].to_numpy(float), want, rtol=1e-9)


FIRES = {
    "CDL2CROWS": ([(100, 112, 99, 110), (115, 116, 111, 112), (113, 114, 104, 105)], -100),
    "CDL3BLACKCROWS": ([(120, 121, 109, 110), (115, 116, 104, 105), (110, 111, 99, 100)], -100),
    "CDL3WHITESOLDIERS": ([(100, 111, 99, 110), (105, 116, 104, 115), (110, 121, 109, 120)], 100),
    "CDL3INSIDE": ([(110, 111, 99, 100), (102, 108, 101, 106), (106, 113, 105, 112)], 100),
    "CDL3LINESTRIKE": ([(120, 121, 114, 115), (117, 118, 109, 110), (112, 113, 104, 105), (104, 125, 103, 124)], 100),
    "CDLABANDONEDBABY": ([(110, 111, 99, 100), (95, 95.5, 94.5, 95), (98, 106, 97, 105)], 100),
    "CDLBREAKAWAY": ([(120, 121, 109, 110), (108, 109, 104, 105), (104, 105, 101, 102), (102, 103, 99, 100), (101, 110, 100, 109)], 100),
    "CDLCONCEALBABYSWALL": ([(120, 120, 110, 110), (115, 115, 105, 105), (103, 107, 101, 102), (109, 110, 99, 100)], 100),
    "CDLCOUNTERATTACK": ([(120, 121, 109, 110), (100, 111, 99, 110)], 100),
    "CDLDARKCLOUDCOVER": ([(100, 111, 99, 110), (112, 113, 101, 102)], -100),
    "CDLEVENINGSTAR": ([(100, 111, 99, 110), (112, 115, 111, 113), (111, 112, 100, 101)], -100),
    "CDLIDENTICAL3CROWS": ([(120, 121, 109, 110), (110, 111, 99, 100), (100, 101, 89, 90)], -100),
    "CDLINNECK": ([(120, 121, 109, 110), (105, 111, 104, 110.5)], -100),
    "CDLKICKING": ([(110, 110, 100, 100), (115, 126, 115, 126)], 100),
    "CDLMORNINGDOJISTAR": ([(110, 111, 99, 100), (97, 98, 96, 97.1), (98, 110, 97, 109)], 100),
    "CDLONNECK": ([(120, 121, 109, 110), (104, 110, 103, 109.1)], -100),
    "CDLPIERCING": ([(110, 111, 99, 100), (98, 108, 97, 107)], 100),
    "CDLRISEFALL3METHODS": ([(100, 112, 99, 110), (108, 109, 104, 105), (106, 107, 103, 104), (105, 106, 102, 103), (104, 116, 103, 115)], 100),
    "CDLSEPARATINGLINES": ([(110, 111, 99, 100), (110, 121, 109, 120)], 100),
    "CDLSTALLEDPATTERN": ([(100, 111, 99, 110), (105, 121, 104, 120), (118, 124, 117, 122)], -100),
    "CDLSTICKSANDWICH": ([(110, 111, 99, 100), (101, 112, 100.5, 111), (112, 113, 99, 100)], 100),
    "CDLUNIQUE3RIVER": ([(120, 121, 109, 110), (115, 116, 100, 108), (105, 108, 104, 107)], 100),
    "CDLUPSIDEGAP2CROWS": ([(100, 111, 99, 110), (116, 117, 113, 114), (118, 119, 111, 112)], -100),
    "CDL3STARSINSOUTH": ([(120, 121, 85, 110), (118, 119, 100, 112), (113, 114, 110, 111)], 100),
    "CDLADVANCEBLOCK": ([(100, 111, 99, 110), (105, 116, 104, 115), (112, 119, 111, 118)], -100),
}


def test_candles_fire_and_miss(spark):
    """Each pattern fires on its bars, at the last one only, and not once the first bar is a doji."""
    out, want = [], {}
    for name, (pattern, value) in FIRES.items():
        for kind in ("hit", "miss"):
            for t, (o, h, l, c) in enumerate(pattern):  # noqa: E741
                if kind == "miss" and t == 0:
                    c = o
                out.append((f"{name}/{kind}", t, float(o), float(h), float(l), float(c)))
            want[f"{name}/{kind}"] = [0] * (len(pattern) - 1) + [value if kind == "hit" else 0]
    df = spark.createDataFrame(out, "symbol string, ts long, open double, high double, low double, close double")
    got = indicate(df, ["symbol"], ["ts"], **{n: candles.candle(n) for n in FIRES}).orderBy("symbol", "ts").toPandas()
    for symbol, values in want.items():
        assert got[got.symbol == symbol][symbol.split("/")[0]].tolist() == values, symbol


def test_every_pattern_has_a_function():
    assert len(candles.RULES) == 61
    assert all(hasattr(candles, n) for n in candles.RULES)
