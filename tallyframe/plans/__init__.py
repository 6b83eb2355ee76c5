"""Composed jobs and the queries over the driver tables."""

from tallyframe.plans import (  # noqa: F401
    curve_queries,
    dataset_queries,
    label_queries,
    text_queries,
    vote_queries,
)
from tallyframe.plans.catalog import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
