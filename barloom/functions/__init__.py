"""Indicators and candlestick patterns by name."""

from . import candles, indicators
from .candles import PATTERNS, candle

INDICATORS = {n: f for n, f in vars(indicators).items() if n.isupper() and getattr(f, "__module__", "") == indicators.__name__}
globals().update(INDICATORS | PATTERNS)

__all__ = ["INDICATORS", "PATTERNS", "candle", *INDICATORS, *PATTERNS]
