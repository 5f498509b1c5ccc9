"""Relational analytics on Spark, with value ranges, privacy units and differential privacy."""

from .plans.nodes import Relation, join, set_op, table, values
from .plans.sql import parse
from .sources.catalog import Catalog

__all__ = ["Catalog", "Relation", "join", "parse", "set_op", "table", "values"]
