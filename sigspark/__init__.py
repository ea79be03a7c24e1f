"""Leakage-free entity-day panels, their evaluation and training-data operators as lazy Spark plans."""
