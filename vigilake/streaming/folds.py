"""Operators that carry a state from event to event of a key.

A step takes the state, or None at the start, and one event, and gives the new state and a list of
output rows. fold_batch runs it over a table: events are sorted by key and order and pass through a
task one after another, so a key of any length needs one state in memory. fold_stream runs the same
step in Structured Streaming with the state kept by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType, _parse_datatype_string

Step = Callable[[object, dict], tuple[object, list[tuple]]]


def fold_batch(events: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """The output rows of all keys."""
    names = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = object(), None, []
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns)):
                row = dict(zip(names, values))
                if row[key] != now:
                    now, state = row[key], None
                state, rows = step(state, row)
                out += rows
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=fields), schema=arrow, preserve_index=False)
                out = []

    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    fields, arrow = parsed.names, to_arrow_schema(parsed)
    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, parsed)


def fold_stream(events: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """The output rows as they come; the events of a key are taken in order within each micro-batch. States are JSON."""
    names = _parse_datatype_string(schema).names

    def run(_, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, out = (json.loads(held.get[0]) if held.exists else None), []
        for row in pd.concat(list(frames)).sort_values(order).to_dict("records"):
            state, rows = step(state, row)
            out += rows
        held.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return events.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


# --- steps; events have id, at (seconds) and what each step names


def _fixed_window(seconds: float, most: int, state, row):
    begin, n = state or (None, 0)
    if begin is None or row["at"] >= begin + seconds:
        begin, n = row["at"], 0
    return (begin, n + 1), [(row["key"], row["id"], n + 1, n + 1 <= most)]


def fixed_window(seconds: float, most: int) -> Step:
    """key, id, count, allowed: a window opens at the first event and lasts for so many seconds."""
    return partial(_fixed_window, seconds, most)


def _token_bucket(rate: float, most: float, state, row):
    tokens, last = state or (most, row["at"])
    tokens = min(most, tokens + (row["at"] - last) * rate)
    allowed = tokens >= 1
    tokens -= allowed
    return (tokens, row["at"]), [(row["key"], row["id"], round(tokens, 6), allowed)]


def token_bucket(rate: float, most: float) -> Step:
    """key, id, tokens left, allowed: tokens come back at so many a second."""
    return partial(_token_bucket, rate, most)


def _cooldown(threshold: float, seconds: float, state, row):
    if row["value"] < threshold or (state is not None and row["at"] < state + seconds):
        return state, []
    return row["at"], [(row["key"], row["id"], row["value"])]


def cooldown(threshold: float, seconds: float) -> Step:
    """key, id, value of the alerts: over the threshold, and none within so many seconds after one."""
    return partial(_cooldown, threshold, seconds)


def _breaker(seconds: float, least: int, share: float, rest: float, state, row):
    kind, since, calls = state or ("CLOSED", 0.0, [])
    at, failed = row["at"], bool(row["failed"])
    if kind == "OPEN":
        if at < since + rest:
            return (kind, since, calls), [(row["key"], row["id"], "OPEN", False)]
        kind = "HALF_OPEN"
    if kind == "HALF_OPEN":
        kind, since, calls = ("OPEN", at, []) if failed else ("CLOSED", at, [])
        return (kind, since, calls), [(row["key"], row["id"], kind, True)]
    calls = [c for c in calls if c[0] > at - seconds] + [(at, failed)]
    if len(calls) >= least and sum(c[1] for c in calls) >= share * len(calls):
        kind, since, calls = "OPEN", at, []
    return (kind, since, calls), [(row["key"], row["id"], kind, True)]


def circuit_breaker(seconds: float = 120, least: int = 5, share: float = 0.5, rest: float = 60) -> Step:
    """key, id, state after it, called: opens when enough calls of the last seconds failed, tries one call after a rest."""
    return partial(_breaker, seconds, least, share, rest)


def _reputation(state, row):
    trust = 100.0 if state is None else state
    trust = max(0.0, trust - 15) if row["flagged"] else min(100.0, trust + 1)
    return trust, [(row["key"], row["id"], trust)]


def reputation() -> Step:
    """key, id, trust after each scan."""
    return _reputation


def _drift(state, row):
    now = [row["attested"], row["signer"], row["repo"]]
    found = []
    if state:
        found = [n for n, hit in (("lost_attestation", state[0] and not now[0]), ("signer_changed", None not in (state[1], now[1]) and state[1] != now[1]), ("repo_changed", None not in (state[2], now[2]) and state[2] != now[2])) if hit]
    return now, [(row["key"], row["id"], f) for f in found]


def drift() -> Step:
    """key, id, drift: each observation against the one before; the first is silent."""
    return _drift


def _retry(delays: tuple, state, row):
    tries = (state or 0) + 1 if row["failed"] else 0
    if not row["failed"]:
        return 0, [(row["key"], row["id"], "done", 0.0)]
    if tries > len(delays):
        return 0, [(row["key"], row["id"], "dead", 0.0)]
    return tries, [(row["key"], row["id"], "retry", float(row["at"] + delays[tries - 1]))]


def retries(delays: tuple = (60, 300, 1800)) -> Step:
    """key, id, outcome (done, retry or dead), when to try again."""
    return partial(_retry, delays)
