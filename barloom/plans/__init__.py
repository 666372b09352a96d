"""Planning of indicator requests."""

from .planner import Fold, Indicator, Native, Series, indicate

__all__ = ["Fold", "Indicator", "Native", "Series", "indicate"]
