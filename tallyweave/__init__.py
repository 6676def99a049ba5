"""Replica reconciliation and file-index analytics on Spark."""
