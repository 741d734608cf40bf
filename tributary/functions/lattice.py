"""Dependency sets as columns: union keeps each node's strongest kind and worst confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.schemas import CONFIDENCE_RANK, FLOW_RANK, rank, unrank


def union(deps: DataFrame, by: list[str], node: str = "node") -> DataFrame:
    """Rows ``(by.., node, FlowKind, Confidence)`` to one row per node and group."""
    best = deps.groupBy(*by, node).agg(F.max(rank(F.col("FlowKind"), FLOW_RANK)).alias("k"), F.max(rank(F.col("Confidence"), CONFIDENCE_RANK)).alias("c"))
    return best.select(*by, node, unrank(F.col("k"), FLOW_RANK).alias("FlowKind"), unrank(F.col("c"), CONFIDENCE_RANK).alias("Confidence"))


def at_least(kind, least: str):
    """A kind raised to ``least`` where it is weaker; indirect stays."""
    return F.when(kind == "Indirect", kind).otherwise(unrank(F.greatest(rank(kind, FLOW_RANK), F.lit(FLOW_RANK[least])), FLOW_RANK))
