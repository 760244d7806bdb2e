"""Retail sales mart and panel demand forecasting as Spark jobs."""

from martlib.operators.star import Star, build_star, mart, read_star
from martlib.sources.query import run_query

__all__ = ["Star", "build_star", "mart", "read_star", "run_query"]
