"""Operators for training-data corpora, their queries and SQL. Nothing outside this folder imports it."""
