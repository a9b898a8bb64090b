"""Spark data sources over block files."""
