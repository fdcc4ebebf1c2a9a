"""candleframe.sources."""
