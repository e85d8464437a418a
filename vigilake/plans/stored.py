"""Queries over stored tables that changes have gone through, and their SQL over the rows alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots
from ..streaming.runs import shared_path
from .inputs import frame, source

TOOLS = source("tools")


def _stored(spark, sf):
    """Tools; first half of them moved up and new ones added; then every third in another category; then a merge that adds stars."""
    tools = frame(spark, sf, "tools").select("tool_id", "name", "category", F.col("stars").cast("long").alias("stars"))
    table = Snapshots(spark, shared_path(spark, "tools"))
    table.create(tools.where("tool_id % 10 < 8"), ["tool_id"], 16)
    table.merge(tools.where("tool_id % 2 = 0").withColumn("name", F.upper("name")))
    table.merge(tools.where("tool_id % 3 = 0").withColumn("category", F.lit("moved")))
    table.merge(tools.where("tool_id % 5 < 3"), {"stars": F.col("old.stars") + F.col("new.stars")}, insert=False)
    return table


def s17_stored_upserts(spark, sf):
    return _stored(spark, sf).read(2)


def s18_stored_merge(spark, sf):
    return _stored(spark, sf).read()


def s18_first_snapshot(spark, sf):
    return _stored(spark, sf).read(0)


_UPSERTS = f"""SELECT tool_id, CASE WHEN tool_id % 3 = 0 THEN name WHEN tool_id % 2 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN tool_id % 3 = 0 THEN 'moved' ELSE category END AS category, CAST(stars AS BIGINT) AS stars
FROM {TOOLS} WHERE tool_id % 10 < 8 OR tool_id % 2 = 0 OR tool_id % 3 = 0"""

QUERIES = {
    "s17_stored_upserts": (s17_stored_upserts, _UPSERTS),
    "s18_stored_merge": (s18_stored_merge, f"SELECT tool_id, name, category, CASE WHEN tool_id % 5 < 3 THEN stars * 2 ELSE stars END AS stars FROM ({_UPSERTS})"),
    "s18_first_snapshot": (s18_first_snapshot, f"SELECT tool_id, name, category, CAST(stars AS BIGINT) AS stars FROM {TOOLS} WHERE tool_id % 10 < 8"),
}
