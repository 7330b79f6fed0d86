"""Spark-native posting intelligence: ingest, resolve, classify, score and rank postings."""
