"""candleframe.plans."""
