"""Preference-data analytics on Spark."""
