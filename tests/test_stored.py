"""Cursors, timers, the worker and stored tables over breaks, failures and conflicts."""

import json

import pytest
from pyspark.sql import functions as F

from vigilake.sources import changes
from vigilake.sources.snapshots import Conflict, Snapshots
from vigilake.streaming import folds, runs, timers, worker

CHANGE = "serial long, package string, version string"


def test_cursor_over_a_failed_batch(spark, tmp_path):
    spark.dataSource.register(changes.ChangeLog)
    log, state, seen = str(tmp_path / "log"), str(tmp_path / "state"), []

    def go(fail=False, **options):
        def take(df, batch):
            rows = [r.serial for r in df.collect()]
            if fail:
                raise RuntimeError("broken off")
            seen.extend(rows)

        stream = spark.readStream.format("changelog").schema(CHANGE).options(path=log, size=10, **options).load()
        stream.writeStream.option("checkpointLocation", options.get("state", state)).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()

    def add(*serials):
        changes.write_changes(spark.createDataFrame([(s, f"p{s}", "1") for s in serials], CHANGE), log, 10)

    add(0, 3, 9, 10)
    go()
    assert sorted(seen) == [0, 3, 9, 10]
    add(11, 12, 35)
    with pytest.raises(Exception, match="broken off"):
        go(fail=True)
    assert sorted(seen) == [0, 3, 9, 10]
    add(36)
    go()
    go()
    assert sorted(seen) == [0, 3, 9, 10, 11, 12, 35, 36]
    seen.clear()
    go(since="12", state=str(tmp_path / "late"))
    assert sorted(seen) == [35, 36]
    batch = spark.read.format("changelog").schema(CHANGE).options(path=log, size=10).load()
    assert batch.count() == 8 and batch.rdd.getNumPartitions() == 3
    empty = spark.read.format("changelog").schema(CHANGE).options(path=str(tmp_path / "none")).load()
    assert empty.count() == 0
    odd = spark.createDataFrame([(1, "", "1"), (2, "_design/x", "1"), (3, "p", "1"), (4, None, "1")], CHANGE)
    assert [r.serial for r in changes.packages(odd).collect()] == [3]


def write(path, name, rows):
    (path / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("key", "id", "at", "value", "failed"), r))) for r in rows))


EVENTS = "key long, id long, at double, value double, failed boolean"


def states(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def test_retries_come_when_due_and_states_end(spark, tmp_path):
    path, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    path.mkdir()

    def go():
        with timers.rocksdb(spark):
            events = timers.timed(runs.watch(spark, str(path), EVENTS), "0 seconds")
            timers.retries(events, forget=5000).writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
        return sorted((r.key, r.id, r.outcome, r.at, r.tries) for r in spark.read.parquet(out).collect())

    t = 1_700_000_000.0
    write(path, "1", [(1, 1, t, 0.0, True), (2, 2, t, 0.0, True), (1, 3, t + 10, 0.0, True)])
    assert go() == []
    write(path, "2", [(3, 4, t + 100, 0.0, False), (1, 5, t + 90, 0.0, True), (1, 6, t + 95, 0.0, True)])
    first = [(1, 1, "retry", t + 60, 1), (1, 6, "dead", t + 95, 4), (2, 2, "retry", t + 60, 1)]
    assert go() == first
    assert spark.read.parquet(out).where("outcome = 'dead'").first().errors == [1, 3, 5, 6]
    write(path, "3", [(3, 7, t + 20_000, 0.0, False)])
    assert go() == sorted(first + [(1, 3, "retry", t + 310, 2), (1, 5, "retry", t + 1890, 3)])
    assert [r.key.key for r in states(spark, state, "tries").collect()] == [3] and states(spark, state, "pending").count() == 0


def test_folds_end_with_what_they_limit(spark, tmp_path):
    """The same rows as without timers, and no state of a key that says nothing more."""
    kinds = {"bucket": (folds.token_bucket(0.1, 2.0), timers.bucket_fills(0.1, 2.0), "key long, id long, tokens double, allowed boolean"), "window": (folds.fixed_window(30, 1), timers.window_ends(30), "key long, id long, n long, allowed boolean"), "alerts": (folds.cooldown(5.0, 40), timers.cooldown_ends(40), "key long, id long, value double")}
    t, rows = 1_700_000_000.0, []
    for i in range(60):
        rows.append((i % 4, i, t + 7.5 * i, float(i % 11), False))
    rows.append((9, 60, t + 100_000, 0.0, False))
    path = tmp_path / "in"
    path.mkdir()
    for kind, (step, ends, schema) in kinds.items():
        for f in path.iterdir():
            f.unlink()
        out, state = str(tmp_path / kind), str(tmp_path / f"{kind}-state")
        for n in range(0, 61, 20):
            write(path, str(n), rows[n : n + 20])
            with timers.rocksdb(spark):
                stream = timers.fold(timers.timed(runs.watch(spark, str(path), EVENTS), "0 seconds"), "key", ["at", "id"], step, schema, ends)
                stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
        want = folds.fold_batch(spark.createDataFrame(rows, EVENTS), "key", ["at", "id"], step, schema)
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))
        assert {r.key.key for r in states(spark, state, "state").collect()} <= {9}


@pytest.mark.parametrize("step", ["findings", "scans", "feed"])
def test_worker_that_breaks_off(spark, tmp_path, step):
    """Tables after a failure behind any step are those of a run without one."""
    rules = spark.createDataFrame([("TOKEN", "CRITICAL", "token", 2)], "id string, severity string, pattern string, weight int")
    (tmp_path / "in").mkdir()

    def job(n, text):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"id": n, "priority": "high", "enqueued_at": n, "path": "f", "text": text}))

    def go(name, after=lambda *_: None):
        jobs = runs.watch(spark, str(tmp_path / "in"), "id long, priority string, enqueued_at long, path string, text string")
        worker.work(jobs, rules, str(tmp_path / name), str(tmp_path / f"{name}-state"), after).awaitTermination()

    def tables(name):
        return [sorted(map(tuple, worker.stored(spark, str(tmp_path / name), t).collect())) for t in ("findings", "scans", "feed")]

    def breaks(done, batch):
        if done == step:
            raise RuntimeError("broken off")

    assert tables("none") == [[], [], []]
    job(1, "a token\nanother token")
    go("good")
    with pytest.raises(Exception, match="broken off"):
        go("bad", breaks)
    assert tables("bad") == [[], [], []]
    go("bad")
    job(2, None)
    go("good")
    go("bad")
    assert tables("bad") == tables("good") and [len(t) for t in tables("good")] == [2, 2, 1]
    batch = spark.createDataFrame([(1, "high", 1, "f", "token")], "id long, priority string, enqueued_at long, path string, text string")
    worker.run_batch(batch, 0, rules, str(tmp_path / "good"))
    assert tables("bad") == tables("good")


def test_snapshots(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, name string, n long")
    table = Snapshots(spark, str(tmp_path / "t"))
    assert table.version() == -1 and table.create(rows((1, "a", 1), (2, "b", 2), (3, None, 3)), ["id"], 8) == 0
    before = table.manifest()["parts"]
    assert table.merge(rows((2, "B", 20))) == 1
    after = table.manifest()["parts"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) > 1
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1), (2, "B", 20), (3, None, 3)]
    assert table.merge(rows((3, "x", 5), (9, "y", 9)), {"n": F.col("old.n") + F.col("new.n")}, insert=False) == 2
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1), (2, "B", 20), (3, None, 8)]
    assert sorted(map(tuple, table.read(0).collect())) == [(1, "a", 1), (2, "b", 2), (3, None, 3)]
    with pytest.raises(Conflict):
        table.merge(rows((1, "late", 0)), base=1)
    assert table.version() == 2 and table.merge(rows()) == 2
    with pytest.raises(Conflict):
        table.create(rows((1, "a", 1)), ["id"])
    none = Snapshots(spark, str(tmp_path / "e"))
    none.create(rows(), ["id"])
    assert none.read().collect() == [] and none.merge(rows((5, "new", 1))) == 1 and none.read().count() == 1
