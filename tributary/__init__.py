"""Tributary: many messy extracts flow into one reconciled table, as Spark plans."""
