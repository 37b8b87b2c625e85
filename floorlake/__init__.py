"""Spark building-scene analytics."""
