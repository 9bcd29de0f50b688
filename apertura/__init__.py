"""Photographic metadata as tables, with Spark."""
