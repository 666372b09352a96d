"""Registered queries against SQL that DuckDB runs on the same tables."""

import pytest

from barloom import indicator_queries, market_queries

SOME = "sma ema wma t3 trima kama bbands midprice mavp sar sarext adxr apo aroon cci cmo macd mfi rsi stoch stochrsi trix ultosc willr ht_trendmode trange natr ad adosc obv cdl_doji cdl_engulfing cdl_shortline cdl_tristar cdl_hikkake".split()


@pytest.mark.parametrize("name", SOME)
def test_indicator(name, same):
    same(indicator_queries.queries()[name], indicator_queries.oracle_sql()[name])


MARKET = "flagship align_forward align_backward union_by_name returns_log linear_two clean_mad clean_sigma clean_percentile factor_weighted factor_rank factor_rank_ic factor_turnover factor_orthogonalize factor_ic_decay factor_fama_macbeth factor_time_series_regression factor_subsample_test selector_info selector_macd selector_consecutive strategy_ma_filtered strategy_rsi strategy_trend backtest_vectorized backtest_metrics backtest_sequential kdj strategy_stoch strategy_adx strategy_pattern backtest_daily_records backtest_position_records backtest_performance backtest_statistics".split()


@pytest.mark.parametrize("name", MARKET)
def test_market(name, same):
    same(market_queries.queries()[name], market_queries.oracle_sql()[name])
