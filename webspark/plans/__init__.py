"""The query catalogue: name -> callable(spark, sf_dir), and the SQL that checks each."""

from . import crawl_queries, more_queries, report_queries, serp_queries, step_queries, text_queries, url_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
