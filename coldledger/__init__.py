"""Snapshot cost, backup reconciliation and catalogue analytics on Spark DataFrames."""
