"""Loading, statistics and backtests by hand-made cases."""

import itertools
import math
import random

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom import market_queries
from barloom.operators.backtest import Backtest, SequentialBacktester, VectorizedBacktester, _numbered, _streaks
from barloom.operators.factor import Factor
from barloom.operators.selector import Selector
from barloom.operators.statistics import clean, linear, returns, student_p
from barloom.operators.strategy import Strategy
from barloom.sources.loader import load, prepare_sequential_data

from .conftest import rows


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "AAA.CSV").write_text("date,close,volume\n2024-01-01,1.5,10\n2024-01-03,2.5,30\n")
    pd.DataFrame({"date": ["2024-01-02", "2024-01-03"], "symbol": ["BBB", "BBB"], "close": [7, 8]}).to_parquet(tmp_path / "x.parquet")
    (tmp_path / "notes.txt").write_text("skip me")
    return tmp_path


def test_prepare_sequential_data(spark, folder):
    csv = folder / "AAA.CSV"
    csv.write_text(csv.read_text())
    got = [(str(r["date"]), r["symbol"], r["close"], r["volume"]) for r in prepare_sequential_data(spark, str(folder), default_fill_value=-1.0).collect()]
    assert got == [("2024-01-01", "AAA", 1.5, 10), ("2024-01-01", "BBB", -1.0, -1), ("2024-01-02", "AAA", 1.5, 10), ("2024-01-02", "BBB", 7.0, -1), ("2024-01-03", "AAA", 2.5, 30), ("2024-01-03", "BBB", 8.0, -1)]


def test_loader_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        prepare_sequential_data(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        prepare_sequential_data(spark, str(tmp_path))


def test_load_wide(spark, tmp_path):
    pd.DataFrame({"date": ["d1", "d2"], "open": [1.0, 2.0]}).to_parquet(tmp_path / "SH1_daily.parquet")
    (tmp_path / "SH2_daily.csv").write_text("date,open\nd2,5\nd3,6\n")
    (tmp_path / "SZ3_daily.json").write_text('[{"date": "d1", "open": 9.0}]')
    with pa.ipc.new_file(str(tmp_path / "SH4_daily.feather"), pa.schema([("date", pa.string()), ("open", pa.float64())])) as w:
        w.write(pa.record_batch({"date": ["d3"], "open": [4.0]}))
    got = load(spark, str(tmp_path), prefix="SH", suffix="_daily")
    assert got.columns == ["date", "SH1_daily_open", "SH2_daily_open", "SH4_daily_open"]
    assert [tuple(r) for r in got.collect()] == [("d1", 1.0, None, None), ("d2", 2.0, 5, None), ("d3", None, 6, 4.0)]
    assert load(spark, str(tmp_path), ["json"]).columns == ["date", "SZ3_daily_open"]


def test_returns(spark):
    df = spark.createDataFrame([("1", 100.0), ("2", 102.0), ("3", 101.0), ("4", 105.0)], "date string, close double")
    assert [None if r[0] is None else round(r[0], 4) for r in returns(df).orderBy("date").select("return").collect()] == [None, 0.02, -0.0098, 0.0396]


def test_linear_exact(spark):
    df = spark.createDataFrame([(float(a), float(b), 3 + 2.0 * a - b) for a in range(4) for b in range(3)], "a double, b double, y double")
    out, (b, r2) = linear(df, ["a", "b"], "y", return_stats=True)
    assert b == pytest.approx([3, 2, -1]) and r2 == pytest.approx(1)
    assert max(abs(r["resid"]) for r in out.collect()) < 1e-9


def test_clean_caps_an_outlier(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 2, 1, 10])], "i int, f double")
    got = [r["f_cleaned"] for r in clean(df, "f", winsorize="mad").orderBy("i").collect()]
    assert got[:5] == [1, 2, 3, 2, 1] and got[5] == pytest.approx(2 + 3 * 1.4826 * 1.0)


@pytest.mark.parametrize(("t", "dof", "p"), [(2.0, 10, 0.0733880), (0.0, 5, 1.0), (12.706, 1, 0.05), (1.96, 1e6, 0.05)])
def test_student(t, dof, p):
    assert student_p(t, dof) == pytest.approx(p, abs=2e-5)


def test_factor_p_values(spark):
    df = spark.createDataFrame([(d, s, float(s), s * 0.1 + (0.05 if (s + d) % 2 else 0.0)) for d in range(6) for s in range(8)], "date int, symbol int, f double, r double")
    for got in (Factor().ic_test(df, "f", "r"), Factor().factor_return(df, "f", "r"), Factor().fama_macbeth(df, ["f"], "r"), Factor().time_series_regression(df.withColumn("f", df.f + df.date), ["f"], "r")):
        assert all(r["p_value"] is None or 0 <= r["p_value"] <= 1 for r in got.collect())


def bars(spark, prices, buys, sells):
    return spark.createDataFrame([("s", t, p, t in buys, t in sells) for t, p in enumerate(prices)], "symbol string, date int, price double, buy_signal boolean, sell_signal boolean")


def test_vectorized_by_hand(spark):
    r = VectorizedBacktester(bars(spark, [10.0, 11.0, float("nan"), 12.0], {0, 3}, {0, 3}), initial_capital=1000.0).run()
    got = [tuple(x) for x in r.capital.orderBy("date").select("cash", "equity").collect()]
    assert got[0] == (-5.0, 995.0)  # 100 shares and the least commission
    assert got[1] == (-5.0, 1095.0)
    assert got[2] == (-5.0, None)  # no price, no equity; the state is kept
    assert got[3] == (1190.0, 1190.0)  # sold, less 5
    assert [x[0] for x in r.positions.orderBy("date").select("position").collect()] == [100, 100, 100, 0]
    m = r.metrics.first()
    assert m["total_trades"] == 1 and m["win_rate"] == 1


def test_sequential_by_hand(spark):
    def strategy(ctx, i):
        if i == 0:
            ctx.buy("A", 10, 10.0)
            ctx.buy("B", 1000, 10.0)  # not affordable
            ctx.sell("A", 0, 10.0)  # dropped
        if i == 2:
            ctx.sell("A", 4, 12.0)
            ctx.sell("A", 100, 12.0)  # more than held

    r = SequentialBacktester(4, initial_capital=1000.0).run(strategy, spark)
    assert [tuple(x) for x in r.capital.orderBy("period").select("cash", "equity").collect()] == [(895, 995), (895, 995), (938, 1010), (938, 1010)]
    assert [tuple(x) for x in r.positions.orderBy("period").collect()] == [(0, "A", 10), (1, "A", 10), (2, "A", 6), (3, "A", 6)]
    assert r.metrics.first()["total_trades"] == 1


def test_sequential_query_takes_all_bars(spark):
    """Symbols have up to 686 bars here; every curve has as many periods."""
    data, sql = "/root/testdata/sf0.01", market_queries.oracle_sql()["backtest_sequential"]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    got = rows(market_queries.queries()["backtest_sequential"](spark, data).toPandas())
    assert rows(duck.sql(sql).df()) == got and len(got) == 5 * 686


def test_streaks_over_dates_and_symbols(spark):
    rng = random.Random(5)
    for odds in (0.2, 0.5, 0.9):
        trades = [(day, sym, 1.0 if rng.random() < odds else -1.0) for day in range(30) for sym in rng.sample("abcdefgh", rng.randint(0, 8))]
        wins = [p > 0 for _, _, p in sorted(trades)]
        longest = lambda kind: max((len(list(g)) for k, g in itertools.groupby(wins) if k is kind), default=None)
        got = _streaks(spark.createDataFrame(trades, "exit_date long, symbol string, pnl double").repartition(4)).first()
        assert tuple(got) == (longest(True), longest(False))


def test_rows_are_numbered_in_their_order(spark):
    df = spark.range(0, 1000, 1, 7).where("id % 3 != 0").select(F.col("id").alias("benchmark"))
    got = [(r["period"], r["benchmark"]) for r in _numbered(df).collect()]
    assert sorted(got) == list(enumerate(k for k in range(1000) if k % 3))


def test_sequential_raises(spark):
    with pytest.raises(ZeroDivisionError):
        SequentialBacktester(1).run(lambda ctx, i: 1 / 0, spark)


def test_sequential_without_orders(spark):
    r = SequentialBacktester(3, initial_capital=10.0).run(lambda ctx, i: None, spark)
    assert [x["equity"] for x in r.capital.orderBy("period").collect()] == [10, 10, 10]


def test_lots(spark):
    dates = ["d1", "d2", "d3"]
    prices = spark.createDataFrame([(d, p, 5.0) for d, p in zip(dates, [10.0, 12.0, 11.0], strict=True)], "date string, A double, B double")
    buy = spark.createDataFrame([("d1", True, False)], "date string, A boolean, B boolean")
    sell = spark.createDataFrame([("d2", True, False)], "date string, A boolean, B boolean")
    bench = spark.createDataFrame([(d, p) for d, p in zip(dates, [1.0, 1.1, 1.0], strict=True)], "date string, b double")
    bt = Backtest(prices, buy, sell, initial_capital=2100.0, benchmark=bench).run()
    t = bt.get_position_records().collect()
    assert len(t) == 1 and t[0]["quantity"] == 200 and t[0]["pnl"] == pytest.approx(400 - 10) and (t[0]["entry_date"], t[0]["exit_date"]) == ("d1", "d2")
    assert [r["total_value"] for r in bt.get_daily_records("A").orderBy("date").collect()] == [2095, 2490, 2490]
    perf = bt.get_performance_metrics().orderBy("date").collect()
    assert perf[1]["portfolio_value"] == 4590 and perf[1]["benchmark_return_pct"] == pytest.approx(10)
    assert bt.get_stock_performance("A").count() == 3
    s = bt.statistics().first()
    assert s["trades"] == 1 and s["max_win_streak"] == 1 and s["best_symbol"] == "A"
    bt.summary()


def test_leverage_and_margin_call(spark):
    rows = spark.createDataFrame([("s", t, p, t == 0, False) for t, p in enumerate([10.0, 9.0, 6.0, 6.0])], "symbol string, date int, price double, buy boolean, sell boolean")
    got = Backtest.of_bars(rows, initial_capital=10_000.0, leverage=2.0).run().done.orderBy("date").collect()
    assert got[0]["quantity"] == 2000 and got[0]["cash"] < 0
    assert got[2]["side"] == -2000  # equity under 30 % of the position
    assert got[3]["quantity"] == 0


def test_selector(spark):
    wide = spark.createDataFrame([(f"d{t:02}", 10.0 + t, 11.0 + t, 9.0 + t, 10.0 + t, 100.0 + 900 * (t == 29), 50.0 - t, 51.0 - t, 49.0 - t, 50.0 - t, 100.0) for t in range(30)], "date string, UP_open double, UP_high double, UP_low double, UP_close double, UP_volume double, DN_open double, DN_high double, DN_low double, DN_close double, DN_volume double")
    s = Selector(wide)
    assert sorted(s.result()) == ["DN", "UP"]
    assert s.filter(consecutive="consecutive_up").result() == ["UP"]
    assert s.filter(consecutive="consecutive_down").filter(price_max=30).result() == ["DN"]
    assert s.filter(volume_change="volume_surge").result() == ["UP"]
    assert s.filter(rsi_min=90, ma_above=5).result() == ["UP"]
    assert s.filter(kdj="overbought").result() == ["UP"]
    assert s.filter(macd="below_zero").result() == ["DN"]
    assert s.filter(price_min=1000).reset().sort("price", True, 1).result() == ["DN"]
    assert len(s.info().columns) == 15
    with pytest.raises(ValueError):
        s.filter(macd="sideways")


@pytest.mark.parametrize("name", ["ma", "macd", "rsi", "bband", "stoch", "cci", "adx", "breakout", "reversion", "volume", "grid", "gap", "pattern", "trend"])
def test_strategies_give_booleans(spark, name):
    rows = spark.createDataFrame([("s", t, 100 + 10 * math.sin(t / 5), 102 + 10 * math.sin(t / 5), 98 + 10 * math.sin(t / 5), 101 + 10 * math.sin(t / 5 + 0.1), 100.0 + t % 7) for t in range(80)], "symbol string, date int, open double, high double, low double, close double, volume double")
    got = getattr(Strategy(), name)(rows)
    assert got.columns == [*rows.columns, "buy_signal", "sell_signal"]
    assert {type(v) for r in got.collect() for v in (r["buy_signal"], r["sell_signal"])} == {bool}
