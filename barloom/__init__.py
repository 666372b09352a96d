"""Market analytics on Spark: bars, indicators, candles, factors, selection rules and backtests as DataFrame plans."""
