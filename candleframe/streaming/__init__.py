"""candleframe.streaming."""
