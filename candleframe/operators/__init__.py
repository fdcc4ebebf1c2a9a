"""candleframe.operators."""
