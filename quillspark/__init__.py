"""Spark-first operators for preparing, measuring and auditing language-model corpora."""
