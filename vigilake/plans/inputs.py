"""Inputs of the queries, derived from the shared tables by expressions that Spark and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (table, {column: expression})
INPUTS = {
    "findings": (
        "lineitem",
        {
            "scan_id": "l_orderkey",
            "file": "concat('src/m', cast(l_partkey % 50 as string), case when l_partkey % 5 = 0 then '/README.md' when l_partkey % 7 = 0 then '/test_a.py' when l_partkey % 11 = 0 then '/node_modules/x.js' else '/main.js' end)",
            "rule": "concat('R-', cast(l_suppkey % 23 as string))",
            "line": "case when l_linenumber = 7 then null else l_linenumber end",
            "severity": "case when l_suppkey % 29 = 0 then 'CRITICAL' when l_linenumber % 3 = 0 then 'HIGH' when l_linenumber % 3 = 1 then 'MEDIUM' else 'LOW' end",
            "phase": "case l_returnflag when 'A' then 'install_hooks' when 'N' then 'code_patterns' else 'network_exfil' end",
            "weight": "cast(1 + l_suppkey % 3 as int)",
            "found_at": "l_shipdate",
        },
    ),
    "scans": (
        "orders",
        {
            "scan_id": "o_orderkey",
            "ecosystem": "case o_custkey % 4 when 0 then 'npm' when 1 then 'pypi' when 2 then 'clawhub' else 'github' end",
            "package": "concat('pkg-', cast(o_custkey as string))",
            "version": "concat('1.', cast(o_orderkey % 9 as string))",
            "user_id": "o_custkey % 211",
            "risk_score": "cast(floor(o_totalprice / 5000) as int)",
            "verdict": "case when o_orderkey % 37 = 0 then 'ERROR' when o_totalprice >= 450000 then 'CRITICAL_RISK' when o_totalprice >= 300000 then 'HIGH_RISK' when o_totalprice >= 120000 then 'MEDIUM_RISK' else 'LOW_RISK' end",
            "findings_count": "cast(o_orderkey % 27 as int)",
            "scanner": "case when o_orderkey % 3 = 0 then '1.4.0' when o_orderkey % 3 = 1 then '2.0.0' else '2.1.0' end",
            "confidence": "case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 101 as double) / 100 end",
            "scanned_at": "o_orderdate",
        },
    ),
    "subscriptions": (
        "orders",
        {
            "sub_id": "o_orderkey",
            "user_id": "o_custkey",
            "plan": "case substr(o_orderpriority, 1, 1) when '1' then 'enterprise' when '2' then 'team' when '3' then 'pro' else 'free' end",
            "status": "case o_orderstatus when 'F' then 'canceled' when 'O' then 'active' else 'past_due' end",
            "created_at": "o_orderdate",
            "canceled_at": "case when o_orderstatus = 'F' then o_orderdate + interval '1' day * cast(o_orderkey % 400 as int) end",
            "price_cents": "case substr(o_orderpriority, 1, 1) when '1' then 49900 when '2' then 9900 when '3' then 2900 else 0 end",
        },
    ),
    "usage": (
        "events",
        {
            "event_id": "event_id",
            "user_id": "user_id",
            "seen_at": "ts",
            "kind": "event_type",
            "cost": "cast(value as decimal(10,2))",
            "tokens": "cast(regexp_extract(props, '[0-9]+', 0) as int)",
            "model": "case event_id % 3 when 0 then 'small' when 1 then 'medium' else 'large' end",
            "confidence": "cast(event_id % 89 as double) / 89",
        },
    ),
    "tools": (
        "part",
        {
            "tool_id": "p_partkey",
            "name": "concat(replace(p_name, ' ', '-'), '-', cast(p_partkey % 40 as string))",
            "description": "concat('A ', p_name, ' for ', case p_partkey % 6 when 0 then 'database queries' when 1 then 'email delivery' when 2 then 'file search' when 3 then 'browser testing' when 4 then 'cloud deploy' else 'chat memory' end)",
            "category": "case p_type when 'ECONOMY' then 'data' when 'SMALL' then 'search' when 'MEDIUM' then 'web' when 'PROMO' then 'communication' when 'STANDARD' then 'storage' else 'code' end",
            "ecosystem": "case p_size % 3 when 0 then 'skills' when 1 then 'mcps' else 'npm' end",
            "stars": "cast(p_size * 13 % 97 as int)",
            "downloads": "cast(p_partkey * 7919 % 100003 as int)",
            "risk_score": "cast(p_partkey % 31 as int)",
        },
    ),
}


def source(name: str) -> str:
    """SELECT text of an input, for DuckDB."""
    table, columns = INPUTS[name]
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table})"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = INPUTS[name]
    return read(spark, sf_dir, table).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
