"""candleframe: price-candle analytics (bars, indicators, signals, models, consensus) on Spark."""

__version__ = "0.1.0"
