"""Spark-native search and analysis of public meeting records."""
