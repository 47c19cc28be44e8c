"""Shard-aware analytics on Spark: distributions, key ranges, pruning, console and data movement."""
