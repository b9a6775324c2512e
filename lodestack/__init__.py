"""Corpus jobs on Spark: ingestion, retrieval, audits, conversations, metrics, evaluation."""
