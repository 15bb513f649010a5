"""Spark-first engine for curating listings and corpora from messy feeds."""
