"""Registered queries of the library and their SQL."""
