"""Lantern: information-triage analytics expressed as Spark DataFrame, SQL and streaming queries."""
