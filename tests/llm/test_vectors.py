"""Nearest neighbours against brute force, whitening against a plain computation in exact integers."""

import numpy as np
import pytest

from tests.conftest import SF, SF01
from vigilake.llm import neighbours, queries, whitening


def frame(spark, rows, schema="vec_id long, embedding array<float>"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], schema)


def brute(rows, k):
    """{query: [(vec_id, score)]} over all pairs."""
    rows = [(i, np.float32(v).astype(float)) for i, v in rows]
    ids, x = np.array([i for i, _ in rows]), np.vstack([v for _, v in rows])
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(spark, df, k=20, leaf=512):
    out: dict = {}
    for r in neighbours.search(neighbours.index(df, k + 1, leaf=leaf), df.where("vec_id % 20 = 0"), k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def recall(got, want):
    """Share of true neighbours found; scores of all that is returned must be right and in order."""
    hits = total = 0
    for q, best in want.items():
        mine = got[q]
        assert len(mine) == len(best) and all(a[1] >= b[1] - 1e-9 for a, b in zip(mine, mine[1:]))
        least = best[-1][1] - 1e-9
        hits += sum(s >= least for _, s in mine)
        total += len(best)
    return hits / total


def test_recall_on_a_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 256)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, 20)
    got = found(spark, df, leaf=128)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    scores = {q: dict(best) for q, best in want.items()}
    assert all(abs(s - scores[q][v]) < 1e-12 for q, mine in got.items() for v, s in mine if v in scores[q])


def test_rounds_mend_a_poor_start(spark, monkeypatch):
    """With three partitions into leaves of eight the first edges are few and bad; the rounds find the others."""
    monkeypatch.setattr(neighbours, "BUCKET", 128)
    rng = np.random.default_rng(3)
    rows = list(enumerate(rng.standard_normal((600, 12))))
    nodes = neighbours.index(frame(spark, rows)).nodes
    first = neighbours._merged(nodes.selectExpr("node", "unit", "X'' as ids", "X'' as scores", "X'' as fresh"), neighbours._seeded(nodes, 0, 3, 8))

    def share(packed):
        x = np.vstack([np.float32(v) for _, v in rows])
        most = np.sqrt((x * x).sum(1).max())
        u = np.hstack([x / most, np.sqrt(np.maximum(0, 1 - ((x / most) ** 2).sum(1)))[:, None]])
        alike = u @ u.T
        np.fill_diagonal(alike, -9)
        true = np.argsort(-alike, 1)[:, :20]
        return np.mean([len(set(np.frombuffer(r.ids, "<i8").tolist()) & set(true[r.node].tolist())) / 20 for r in packed.collect()])

    assert share(first) < 0.4 and share(neighbours.graph(nodes, 0, 3, 8)) > 0.9


def test_copies_clusters_and_lengths(spark, monkeypatch):
    """A third of all rows equal, a third near copies, and vectors of very different lengths."""
    monkeypatch.setattr(neighbours, "BUCKET", 200)
    rng = np.random.default_rng(4)
    one, other = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(i, 3 * one) for i in range(300)]
    rows += [(i, other + 0.01 * rng.standard_normal(16)) for i in range(300, 600)]
    rows += [(i, rng.standard_normal(16) * rng.choice([0.1, 1, 5])) for i in range(600, 900)]
    want = brute(rows, 20)
    got = found(spark, frame(spark, rows))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    # equal vectors: the smallest ids, without the query's own
    equal = [v for v, _ in got[40] if v < 300]
    assert equal == [v for v in range(300) if v != 40][: len(equal)] and equal


def test_rows_that_take_no_part(spark):
    good = [(i, [1.0 + i, 2.0, 0.5]) for i in range(0, 25)]
    bad = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [float("nan"), 1, 1]), (180, [float("inf"), 1, 1]), (200, [1.0, 2.0]), (220, [])]
    got = found(spark, frame(spark, good + bad + good[:3]))
    assert {q: [v for v, _ in best] for q, best in got.items()} == {q: [v for v, _ in best] for q, best in brute(good, 20).items()}
    assert found(spark, frame(spark, good[:1])) == {} and found(spark, frame(spark, [])) == {} and found(spark, frame(spark, bad[:2])) == {}
    few = found(spark, frame(spark, good[:4]))
    assert [len(b) for b in few.values()] == [3]
    clash = frame(spark, good).selectExpr("*", "1 as node", "2 as bucket", "3 as score", "4 as ids")
    assert {q: [v for v, _ in best] for q, best in found(spark, clash).items()} == {q: [v for v, _ in best] for q, best in brute(good, 20).items()}


def whitened(spark, df):
    rows = whitening.vectors(df)
    return whitening.whiten(rows, whitening.fit(rows)).collect()


def check(rows, got, components=16):
    """Exact integers for n and deviations, an eigendecomposition of the whole covariance for the rest."""
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = {tuple(v) for v in x.values()}
    n, d = len(fit), len(next(iter(fit)))
    sums = [sum(v[k] for v in fit) for k in range(d)]
    centred = np.array([[(n * v[k] - sums[k]) / n for k in range(d)] for v in sorted(fit)])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    m = min(components, d)
    assert len(got) == m * len(rows)
    for r in got:
        own = x[r.vec_id]
        assert r.n == n and r.deviation == sum((n * own[k] - sums[k]) ** 2 for k in range(d))
        j = r.component - 1
        assert abs(r.explained - values[j] / values.sum()) <= 1e-10 and r.identity_error <= 1e-10
        y = np.array([(n * own[k] - sums[k]) / n for k in range(d)]) @ vectors[:, j] / np.sqrt(values[j])
        assert abs(abs(r.whitened) - abs(y)) < 1e-6


def test_whitening_of_tables(spark):
    for sf in (SF, SF01):
        df = spark.read.parquet(f"{sf}/embeddings.parquet")
        check([(r.vec_id, r.embedding) for r in df.collect()], whitened(spark, df))


def test_few_passes_where_the_range_is_small(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 20)) * 50 * 0.4 ** np.arange(20)
    rows = whitening.vectors(frame(spark, list(enumerate(np.hstack([x, np.zeros((400, 60))])))))
    fitted = whitening.fit(rows, components=4)
    assert fitted.rank == 20 and fitted.residual <= whitening.RESIDUAL and fitted.identity_error < 1e-9
    hard = whitening.fit(whitening.vectors(frame(spark, list(enumerate(rng.standard_normal((400, 80)))))), components=4)
    assert hard.rank == 80 and hard.residual < 1e-12


def test_whitening_edges(spark):
    rng = np.random.default_rng(6)
    rows = list(enumerate(rng.standard_normal((60, 5))))
    bad = [(100, None), (101, [1.0, None, 2.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("-inf"), 0, 0, 0, 0]), (104, [1.0, 2.0]), (105, [])]
    df = frame(spark, rows + bad).selectExpr("*", "1 as n", "2 as component", "3 as x")
    check([(i, np.float32(v)) for i, v in rows], whitened(spark, df))
    copies = rows + [(200 + i, rows[0][1]) for i in range(200)]
    check([(i, np.float32(v)) for i, v in copies], whitened(spark, frame(spark, copies)))
    assert whitened(spark, frame(spark, [])) == [] and whitened(spark, frame(spark, rows[:1] * 3)) == []
    flat = [(i, [i, 2 * i, 7.0]) for i in range(9)]
    assert {r.component for r in whitened(spark, frame(spark, flat))} == {1}


def test_deviations_beyond_64_bits():
    x, sums = np.array([[10**12, 0], [0, 0]], np.int64), np.array([10**12, 0], np.int64)
    with pytest.raises(OverflowError):
        whitening._deviations(x, 2 * 10**6, sums)
    assert whitening._deviations(np.array([[3, 5]], np.int64), 2, np.array([4, 11], np.int64)).tolist() == [4 + 1]
