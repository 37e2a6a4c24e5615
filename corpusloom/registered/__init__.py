"""Registers every query; each module covers one family of operators."""

from . import catalog_queries, chunk_queries, extra_queries, log_queries, package_queries, parse_queries, plan_queries, score_queries, taxonomy_queries, text_queries  # noqa: F401
