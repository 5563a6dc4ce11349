"""Spark-first analytics engine for software-quality data."""
