import json
import os
import random

from pyspark.sql import functions as F

from vigilake.streaming import folds, relational, runs

EVENTS = "key long, id long, at double, value double, failed boolean"


def events(n=400, seed=1):
    rng, at = random.Random(seed), 0.0
    out = []
    for i in range(n):
        at += rng.expovariate(1 / 20)
        out.append((rng.randint(0, 5), i, at, rng.uniform(0, 100), rng.random() < 0.5))
    return out


def by_hand(step, rows):
    state, out = {}, []
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        state[r[0]], got = step(state.get(r[0]), dict(zip(("key", "id", "at", "value", "failed"), r)))
        out += got
    return sorted(out)


STEPS = {
    "fixed": (folds.fixed_window(120, 3), "key long, id long, n long, allowed boolean"),
    "bucket": (folds.token_bucket(0.02, 2.0), "key long, id long, tokens double, allowed boolean"),
    "alerts": (folds.cooldown(60.0, 300), "key long, id long, value double"),
    "breaker": (folds.circuit_breaker(400, 3, 0.5, 100), "key long, id long, state string, called boolean"),
    "retries": (folds.retries(), "key long, id long, outcome string, next double"),
}


def test_batch_folds_match_plain_loops(spark):
    rows = events()
    frame = spark.createDataFrame(rows, EVENTS).repartition(5)
    for step, schema in STEPS.values():
        got = sorted(tuple(r) for r in folds.fold_batch(frame, "key", ["at", "id"], step, schema).collect())
        assert got == by_hand(step, rows) and got
    assert folds.fold_batch(frame.limit(0), "key", ["at", "id"], *STEPS["fixed"]).count() == 0


def test_stream_folds_match_batch_folds(spark, tmp_path):
    rows = events(120)
    for k in range(0, 120, 40):  # three micro-batches
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("key", "id", "at", "value", "failed"), r))) for r in rows[k : k + 40]))
        os.utime(tmp_path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # the order in which a stream takes them
    for name in ("fixed", "alerts", "breaker"):
        step, schema = STEPS[name]
        stream = runs.watch(spark, str(tmp_path), EVENTS, files=1)
        got = sorted(tuple(r) for r in runs.drain(folds.fold_stream(stream, "key", ["at", "id"], step, schema), name).collect())
        assert got == by_hand(step, rows)


def test_drift_is_silent_at_first(spark):
    rows = [(1, 1, True, "a", "r"), (1, 2, False, "b", "r"), (1, 3, False, None, "q"), (2, 4, False, "x", "y")]
    frame = spark.createDataFrame(rows, "key long, id long, attested boolean, signer string, repo string")
    got = {tuple(r) for r in folds.fold_batch(frame, "key", ["id"], folds.drift(), "key long, id long, drift string").collect()}
    assert got == {(1, 2, "lost_attestation"), (1, 2, "signer_changed"), (1, 3, "repo_changed")}


def test_stream_dedup_over_restarts(spark, tmp_path):
    path, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    path.mkdir()

    def go():
        stream = relational.deduplicated(runs.watch(spark, str(path), "name string, version string, n int"), ["name", "version"])
        stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
        return sorted((r.name, r.version) for r in spark.read.parquet(out).collect())

    (path / "1.json").write_text('{"name": "a", "version": "1", "n": 1}\n{"name": "a", "version": "1", "n": 2}\n')
    assert go() == [("a", "1")]
    (path / "2.json").write_text('{"name": "a", "version": "1", "n": 3}\n{"name": "b", "version": "1", "n": 4}\n')
    assert go() == [("a", "1"), ("b", "1")]


def test_bounded_dedup_and_late_windows(spark, tmp_path):
    (tmp_path / "1.json").write_text("\n".join(json.dumps({"k": k, "t": f"2024-01-01T0{h}:10:00Z"}) for k, h in (("a", 1), ("a", 1), ("a", 2), ("b", 5))))
    stream = runs.watch(spark, str(tmp_path), "k string, t timestamp")
    once = runs.drain(relational.deduplicated_within(stream, ["k"], "t", "10 hours"), "within")
    assert sorted(r.k for r in once.collect()) == ["a", "b"]
    over = runs.drain(relational.windowed_counts(stream, "k", "t", "1 hour", late="30 minutes"), "late").collect()
    assert sorted((r.k, r.n) for r in over) == [("a", 1), ("a", 2)]  # the last window is still open


def test_priority_and_worker(spark, tmp_path):
    rows = [("1", "normal", 3), ("2", "critical", 2), ("3", "low", 1), ("4", "high", 9), ("5", "critical", 1)]
    jobs = spark.createDataFrame(rows, "id string, priority string, enqueued_at int")
    assert [r.id for r in relational.by_priority(jobs).collect()] == ["5", "2", "4", "3", "1"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(dict(zip(("id", "priority", "enqueued_at"), r))) for r in rows))
    seen = []
    stream = runs.watch(spark, str(tmp_path / "in"), "id string, priority string, enqueued_at int")
    relational.process(stream, lambda df: df.withColumn("done", F.lit(True)), lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["5", "2", "4", "3", "1"]
