"""Composed pipelines: building a corpus, and answering queries on it."""
