"""Corpus retrieval and browse analytics, written as Spark DataFrame programs."""
