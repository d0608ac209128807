"""Readers that reject or quarantine bad input, and writers that never overwrite."""
