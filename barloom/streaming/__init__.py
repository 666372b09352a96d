"""Structured Streaming forms."""

from .streams import stream_bars, stream_ema

__all__ = ["stream_bars", "stream_ema"]
