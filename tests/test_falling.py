"""Walks that fall below zero, as those of larger tables do: queries against their SQL, and cases by hand."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import candle_sql, indicator_queries, market_queries
from barloom.functions import candles
from barloom.functions import kernels as K
from barloom.operators.backtest import VectorizedBacktester, simulate, simulate_lots
from barloom.operators.strategy import Strategy
from barloom.plans import indicate
from barloom.sources.bars import JUMP_BARS_SQL, WALK_BARS_SQL, jump_bars, walk_bars

from .conftest import rows


@pytest.fixture(scope="module")
def falling(tmp_path_factory):
    """The events of sf0.001, their numbers 600 times as large and a little lower: prices go up and down through zero."""
    folder = tmp_path_factory.mktemp("falling")
    duckdb.sql(f"COPY (SELECT * REPLACE ((value - 60) * 600 + 50 AS value) FROM '/root/testdata/sf0.001/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert duck.sql(f"WITH {WALK_BARS_SQL} SELECT min(close) < -10000 AND max(close) > 0 FROM bars").fetchall()[0][0]
    return str(folder), duck


def test_jump_bars_of_a_fallen_walk(spark):
    """Every remainder of the lists, negative ones too."""
    walk = pd.DataFrame([("s", hour, -20000.0 + 7 * hour, -20000.0 - 3 * hour) for hour in range(600)], columns=["symbol", "hour", "open", "close"]).assign(volume=1.0)
    duck = duckdb.connect()
    duck.register("bars", walk)
    want = duck.sql(f"WITH {JUMP_BARS_SQL} SELECT * FROM jumps").df()
    got = jump_bars(spark.createDataFrame(walk.assign(high=0.0, low=0.0))).toPandas()
    assert want["open"].isna().any() and want["high"].isna().any() and not want["open"].isna().all()
    assert rows(got) == rows(want)


def test_patterns_of_a_fallen_walk(spark, falling):
    """All patterns at once, with missing prices among the bars."""
    folder, duck = falling
    walk = walk_bars(spark.read.parquet(f"{folder}/events.parquet"))
    names = {n: n[3:].lower() for n in candles.RULES}
    got = indicate(walk.unionByName(jump_bars(walk)), ["symbol"], ["hour"], **{s: candles.candle(n) for n, s in names.items()}).select("symbol", "hour", *(f"`{s}`" for s in names.values())).toPandas()
    every = f"WITH {WALK_BARS_SQL.strip()}, {JUMP_BARS_SQL.strip()}, every AS (SELECT * FROM bars UNION ALL SELECT * FROM jumps), {candle_sql.BARS.strip().format(table='every')}"
    want = duck.sql(f"{every} SELECT symbol, hour, {', '.join(f'''{candle_sql.pattern(s)} AS "{s}"''' for s in names.values())} FROM seq").df()
    a, b = (f.sort_values(["symbol", "hour"]).reset_index(drop=True) for f in (got, want))
    assert len(a) == len(b) and [s for s in names.values() if (a[s] != b[s]).any()] == []
    assert sum((a[s] != 0).any() for s in names.values()) > 40


def held(name, queries, spark, falling):
    """A registered query against its SQL on the falling walk."""
    folder, duck = falling
    query, sql = queries.queries()[name], queries.oracle_sql()[name]
    plain = lambda f: rows(f.astype({c: "float64" for c in f.columns if pd.api.types.is_numeric_dtype(f[c]) and f[c].dtype != bool}))
    got, want = plain(query(spark, folder).toPandas()), plain(duck.sql(sql).df())
    assert got and got == want


@pytest.mark.parametrize("name", ["cdl_2crows", "cdl_mathold", "cdl_risefall3methods", "cdl_shortline", "cdl_spinningtop"])
def test_pattern_queries(name, spark, falling):
    held(name, indicator_queries, spark, falling)


def test_stops_below_zero():
    """A stop has the sign of its price, whichever the position."""
    high, low = np.array([-9.0, -10.0, -11.0, -8.0]), np.array([-10.0, -11.0, -12.0, -9.0])
    stop, side = K.stops(high, low, 0, 0, 0.02, 0.02, 0.2, 0.02, 0.02, 0.2)
    assert side[1:].tolist() == [-1, -1, 1] and stop[1] == -9 and stop[3] == -12
    assert K.sarext(high, low, 0, 0, 0.02, 0.02, 0.2, 0.02, 0.02, 0.2)[1:].tolist() == (stop * side)[1:].tolist()


@pytest.mark.parametrize("name", ["sar", "sarext"])
def test_stop_queries(name, spark, falling):
    held(name, indicator_queries, spark, falling)


def test_grid_of_prices_below_zero(spark):
    df = spark.createDataFrame([(s, t, p) for s, prices in (("a", [10.0, -1.0, -2.0, 9.0, 0.0, 9.0, None]), ("b", [-10.0, -9.0, 1.0]), ("c", [0.0, 1.0, 2.0, -1.0])) for t, p in enumerate(prices)], "symbol string, date int, close double")
    got = {(r["symbol"], r["date"]): "+" * r["buy_signal"] + "-" * r["sell_signal"] for r in Strategy().grid(df).collect()}
    assert [got["a", t] for t in range(7)] == ["", "-", "", "+", "+", "-", ""]
    assert [got["b", t] for t in range(3)] == ["", "+", "-"]
    assert [got["c", t] for t in range(4)] == ["", "+", "", "-"]


def test_grid_query(spark, falling):
    held("strategy_grid", market_queries, spark, falling)


def test_signed_prices_are_traded():
    """Sold below zero where prices are signed; else the position is kept, as before."""
    price, buy, sell = np.array([10.0, -2.0, 0.0, 5.0]), np.array([1.0, 0, 0, 0]), np.array([0.0, 1, 0, 0])
    kept = simulate(price, buy, sell, 1000.0, 0.0, 0.0, 0.0, 0.0, 5.0, 1.0)
    assert kept[0].tolist() == [100] * 4 and kept[1].tolist() == [-5] * 4
    sold = simulate(price, buy, sell, 1000.0, 0.0, 0.0, 0.0, 0.0, 5.0, 1.0, True)
    assert sold[0].tolist() == [100, 0, 0, 0] and sold[1].tolist() == [-5, -210, -210, -210]
    lots = lambda *signed: simulate_lots(price, buy, sell, 1100.0, 1.0, 1.0, 0.3, 0.06, 0.0, 5.0, 0.0, *signed)
    assert lots()[1].tolist() == [100] * 4
    assert lots(True)[0].tolist() == [95, -110, -110, -110]  # owed, without interest


def test_metrics_of_signed_values(spark):
    """NaN is kept apart from null and from zero."""
    df = spark.createDataFrame([("s", t, p, False, False) for t, p in enumerate([10.0, 5.0, 4.0, 3.0, -2.0])], "symbol string, date int, price double, buy_signal boolean, sell_signal boolean")
    m = VectorizedBacktester(df, benchmark="price", signed=True).run().metrics.first()
    assert m["annualized_return"] == 0 and m["sharpe_ratio"] == float("-inf") and np.isnan(m["alpha"]) and m["beta"] == 0
    m = VectorizedBacktester(df, benchmark="price").run().metrics.first()
    assert m["sharpe_ratio"] == 0 and m["alpha"] == pytest.approx(-0.03 - 0 * m["beta"])
    got = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e15,), (-1.2345678,), (None,)], "x double").select(indicator_queries.six(F.col("x")).alias("x")).collect()
    assert np.isnan(got[0]["x"]) and [r["x"] for r in got[1:]] == [float("inf"), 1e15, -1.234568, None]


@pytest.mark.parametrize("name", ["backtest_vectorized", "backtest_metrics", "backtest_daily_records", "backtest_position_records", "backtest_performance", "backtest_statistics"])
def test_backtest_queries(name, spark, falling):
    held(name, market_queries, spark, falling)
