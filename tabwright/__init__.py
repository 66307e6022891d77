"""Tabular files in, clean tables, profiles, analyses and reports out - on Spark."""
