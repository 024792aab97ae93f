"""PySpark-native analytics for ordered bar series: cleaning, indicators, regimes, windows and evaluation."""

__version__ = "0.1.0"
