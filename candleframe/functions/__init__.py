"""candleframe.functions."""
