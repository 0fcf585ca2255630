"""Relational, retrieval and chunking operators: functions from DataFrames to DataFrames."""
