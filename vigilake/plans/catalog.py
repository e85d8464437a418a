"""All named queries of the relational library: name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import content, context, matching, reconcile, registry, rules, scoring, sources, stored, streams, text, usage

QUERIES: dict = scoring.QUERIES | registry.QUERIES | usage.QUERIES | reconcile.QUERIES | matching.QUERIES | text.QUERIES | streams.QUERIES | context.QUERIES | content.QUERIES | sources.QUERIES | rules.QUERIES | stored.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and verdicts of every scan's findings."""
    return scoring.a2_verdicts(spark, sf_dir)
