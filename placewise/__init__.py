"""Incident hotspot analytics as Spark DataFrame operators."""
