"""Observation and re-observation of event streams on Spark."""
