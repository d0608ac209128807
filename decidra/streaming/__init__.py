"""Incremental metrics over a stream of predictions (an extension)."""
