"""Corpus and vocabulary analytics expressed as Spark DataFrame plans."""
