"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries walk it greedily.

Equal vectors are one node, with its smallest ids. Nodes get one more component that makes all of one length, so the largest inner
products are the least angles; the graph is built on these, in half precision. Its first edges come from random
projections: range partitions by random hyperplanes, split at medians down to small leaves. Each round of NN-descent sends the
sampled neighbours of a node, and nodes that it is a neighbour of, to the node; there those that are new to it are compared with all,
and pairs better than the worst neighbour of either go back. Rounds end when few edges change. A query starts at its own node's
neighbours and at the longest vectors, keeps the best nodes found in a beam, and expands the best ones not yet expanded
until none is left; its scores are exact, on the original vectors in double precision.

Nodes are dealt to buckets of bounded size, so a task holds a bucket's vectors; lists of a node hold at most a set number of
entries, also in the node's role as a neighbour of very many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_groups import groups
from .common import cut, discard
from .shingles import mix

#: Neighbours of a node, and how many of the new and of the other ones, in each direction, take part in a round.
NEIGHBOURS, SAMPLE = 32, 16
#: Random partitions at first, nodes of a leaf, and edges that a leaf gives a node.
PASSES, LEAF, SEEDS = 8, 512, 10
#: Rounds end when fewer than this share of all edges change, or after so many.
SETTLED, ROUNDS = 0.03, 12
#: Nodes of a query's beam, those expanded in one step, and steps.
BEAM, EXPAND, STEPS = 96, 32, 24
#: Nodes of a bucket, and the least number of buckets.
BUCKET, BUCKETS = 4096, 16
#: Below all scores.
NONE = -1e30
#: Long vectors at which every query starts as well.
ENTRIES = 32


def _buckets(n: int) -> int:
    return max(BUCKETS, math.ceil(n / BUCKET))


def _bucket(nodes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(nodes.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal keys."""
    begins = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, int)
    return begins, np.append(begins[1:], len(sorted_keys))


def _best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, most: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different pairs (the first row of each stays), sorted by owner and falling score, at most so many of an owner."""
    order = np.lexsort((other, owner))
    owner, other, score, more = owner[order], other[order], score[order], [m[order] for m in more]
    keep = np.append(True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])) if len(owner) else np.zeros(0, bool)
    owner, other, score, more = owner[keep], other[keep], score[keep], [m[keep] for m in more]
    order = np.lexsort((other, -score, owner))
    owner, other, score, more = owner[order], other[order], score[order], [m[order] for m in more]
    begins, ends = _runs(owner)
    place = np.arange(len(owner)) - np.repeat(begins, ends - begins)
    keep = place < most
    return owner[keep], other[keep], score[keep], *[m[keep] for m in more]


_PACK = pa.schema([("node", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary())])
_PACK_SQL = "node long, ids binary, scores binary"


def _packs(owner: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    begins, ends = _runs(owner)
    spans = list(zip(begins.tolist(), ends.tolist()))
    return pa.RecordBatch.from_arrays(
        [pa.array(owner[begins] if len(begins) else np.zeros(0, np.int64)), _packed([other[b:e].astype("<i8") for b, e in spans]), _packed([score[b:e].astype("<f4") for b, e in spans])], schema=_PACK
    )


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: not null, not zero, only finite components.

    Vectors of another length than most have (the longer, if tied) have no inner product with those and take no part.
    """
    kind = "double" if "double" in embeddings.schema["embedding"].dataType.simpleString() else "float"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where("vec_id is not null")
    rows = rows.where("embedding is not null and exists(embedding, c -> c <> 0) and not exists(embedding, c -> c is null or isnan(c) or abs(c) = double('inf'))")
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (common[0] if common else 0))


def _nodes(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(embedding, node, members) and (node, bucket, length, vector, unit, members) of different vectors, with the most smallest ids of each and the least as the node."""
    same = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.distinct().withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= most)
    classes = cut(few.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("members")), "near-classes")
    square = "aggregate(embedding, 0D, (s, c) -> s + cast(c as double) * cast(c as double))"
    n, longest = classes.agg(F.count("*"), F.max(F.expr(square))).first()
    buckets, wide = _buckets(n), "<f8" if "double" in rows.schema["embedding"].dataType.simpleString() else "<f4"
    scale = math.sqrt(longest or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = x.astype(np.float64) / scale
            unit = np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))[:, None]]).astype("<f2")
            columns = [batch.column(0), pa.array(_bucket(own, buckets)), pa.array(np.sqrt((y * y).sum(1))), _packed(list(x.astype(wide))), _packed(list(unit)), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "bucket", "length", "vector", "unit", "members"])

    out = classes.select("node", "embedding", "members").mapInArrow(run, "node long, bucket long, length double, vector binary, unit binary, members array<long>")
    return classes, cut(out, "near-nodes")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors of equal length as rows."""
    return np.vstack([np.frombuffer(v.as_buffer(), kind) for v in column]) if len(column) else np.zeros((0, 0), kind)


def _leaves(x: np.ndarray, rows: np.ndarray, most: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    todo = [rows]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            yield own
            continue
        a, b = x[rng.choice(own, 2, replace=False)]
        order = own[np.argsort(x[own] @ (a - b), kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]


def _seeded(nodes: DataFrame, seed: int, passes: int, leaf: int) -> DataFrame:
    """First edges as packs: the nearest in each leaf of random partitions."""
    n, one = nodes.count(), nodes.select("unit").first()
    d, bits = len(one[0]) // 2 if one else 1, 24
    planes = np.random.default_rng(seed).standard_normal((passes, d, bits + 1)).astype(np.float32)

    def codes(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), "<f2").astype(np.float32)
            for k in range(passes):
                z = x @ planes[k]
                code = ((z[:, :bits] > 0) @ (1 << np.arange(bits - 1, -1, -1))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(code), pa.array(z[:, bits].astype(float)), *batch.columns], names=["pass", "code", "place", "node", "unit"])

    def leaves(batches):
        for (k,), members in groups(batches, 1):
            own = np.array([m[0] for m in members], np.int64)
            x = np.vstack([np.frombuffer(m[1], "<f2") for m in members]).astype(np.float32)
            for near in _leaves(x, np.arange(len(own)), leaf, np.random.default_rng([seed, k, len(own)])):
                alike = x[near] @ x[near].T
                np.fill_diagonal(alike, -9)
                most = min(SEEDS, len(near) - 1)
                if most < 1:
                    continue
                top = np.argpartition(-alike, most - 1, axis=1)[:, :most]
                yield _packs(*_best(np.repeat(own[near], most), own[near][top.ravel()], np.take_along_axis(alike, top, 1).ravel(), most))

    dealt = nodes.select("node", "unit").mapInArrow(codes, "pass int, code long, place double, node long, unit binary")
    dealt = dealt.repartitionByRange(max(passes, math.ceil(passes * n / (2 * BUCKET))), "pass", "code", "place").sortWithinPartitions("pass", "code", "place")
    return dealt.select("pass", "node", "unit").mapInArrow(leaves, _PACK_SQL)


_STATE = pa.schema([("node", pa.int64()), ("unit", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary()), ("fresh", pa.binary()), ("worst", pa.float32()), ("changed", pa.int64())])
_STATE_SQL = "node long, unit binary, ids binary, scores binary, fresh binary, worst float, changed long"


def _merged(state: DataFrame, packs: DataFrame) -> DataFrame:
    """The state with the best of old and found neighbours; those that took part in the round are new no more."""

    def told(held: list[tuple]) -> pa.RecordBatch:
        owner, other, score, fresh, was = [], [], [], [], []
        units: dict = {}
        for node, first, unit, ids, scores, flags in held:
            ids = np.frombuffer(ids, "<i8")
            other.append(ids)
            owner.append(np.full(len(ids), node, np.int64))
            score.append(np.frombuffer(scores, "<f4"))
            if first == 0:
                units[node] = unit
                flags = np.frombuffer(flags, np.uint8).copy()
                flags[np.flatnonzero(flags)[:SAMPLE]] = 0
                fresh.append(flags)
                was.append(np.ones(len(ids), bool))
            else:
                fresh.append(np.ones(len(ids), np.uint8))
                was.append(np.zeros(len(ids), bool))
        owner, other, score, fresh, was = _best(*map(np.concatenate, (owner, other, score)), NEIGHBOURS, *map(np.concatenate, (fresh, was)))
        begin = np.searchsorted(owner, list(units), "left")
        end = np.searchsorted(owner, list(units), "right")
        spans = list(zip(begin.tolist(), end.tolist()))
        columns = [_packed([a[b:e] for b, e in spans]) for a in (other.astype("<i8"), score.astype("<f4"), fresh.astype(np.uint8))]
        columns.append(pa.array([float(score[e - 1]) if e - b == NEIGHBOURS else NONE for b, e in spans], pa.float32()))
        changed = [int((~was[b:e]).sum()) for b, e in spans]
        return pa.RecordBatch.from_arrays([pa.array(list(units), pa.int64()), pa.array(list(units.values()), pa.binary()), *columns, pa.array(changed, pa.int64())], schema=_STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for (node,), members in groups(batches, 1):
            held += [(node, *m) for m in members]
            if len(held) >= 20_000:
                yield told(held)
                held = []
        if held:
            yield told(held)

    none = F.lit(None).cast("binary")
    both = state.select("node", F.lit(0).alias("kind"), "unit", "ids", "scores", "fresh").unionByName(packs.select("node", F.lit(1).alias("kind"), none.alias("unit"), "ids", "scores", none.alias("fresh")))
    return both.repartition("node").sortWithinPartitions("node", "kind").mapInArrow(run, _STATE_SQL)


_EDGE_SQL = "source long, target long, fresh int"
_EDGE = pa.schema([("source", pa.int64()), ("target", pa.int64()), ("fresh", pa.int32())])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a round: of each node its nearest new ones and its nearest others."""
    for batch in batches:
        source, target, fresh = [], [], []
        for node, ids, flags in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            ids, flags = np.frombuffer(ids, "<i8"), np.frombuffer(flags, np.uint8)
            for flag in (1, 0):
                few = ids[flags == flag][:SAMPLE]
                source.append(np.full(len(few), node, np.int64))
                target.append(few)
                fresh.append(np.full(len(few), flag, np.int32))
        if source:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (source, target, fresh)], schema=_EDGE)


_SENT = pa.schema([("bucket", pa.int64()), ("member", pa.int64()), ("unit", pa.binary()), ("worst", pa.float32()), ("at", pa.binary()), ("fresh", pa.binary())])
_SENT_SQL = "bucket long, member long, unit binary, worst float, at binary, fresh binary"


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's vector once for each bucket with nodes that are to compare it. The vector comes first, the places sorted by bucket."""
    unit = worst = member = bucket = None
    at, fresh, out = [], [], []

    def told():
        out.append((bucket, member, unit, worst, np.array(at, "<i8").tobytes(), np.array(fresh, np.uint8).tobytes()))

    for batch in batches:
        for own, where, vector, score, place, flag in zip(*(c.to_pylist() for c in batch.columns)):
            if at and (own, where) != (member, bucket):
                told()
                at, fresh = [], []
            if vector is not None:
                member, unit, worst, bucket = own, vector, score, None
                continue
            bucket = where
            at.append(place)
            fresh.append(flag)
        if len(out) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SENT)], schema=_SENT)
            out = []
    if at:
        told()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SENT)], schema=_SENT)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of pairs, among the members met at the nodes of a bucket, that are better than the worst neighbour of one of them."""
    for _, rows in groups(batches, 1):
        ids = np.array([r[0] for r in rows], np.int64)
        x = np.vstack([np.frombuffer(r[1], "<f2") for r in rows]).astype(np.float32)
        worst = np.array([r[2] for r in rows], np.float32)
        places = [np.frombuffer(r[3], "<i8") for r in rows]
        at, fresh = np.concatenate(places), np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows]).astype(bool)
        member = np.repeat(np.arange(len(rows)), [len(p) for p in places])
        order = np.lexsort((~fresh, member, at))
        at, member, fresh = at[order], member[order], fresh[order]
        first = np.append(True, (at[1:] != at[:-1]) | (member[1:] != member[:-1]))
        at, member, fresh = at[first], member[first], fresh[first]
        targets, found, scores = [], [], []
        for b, e in zip(*_runs(at)):
            new, every = member[b:e][fresh[b:e]], member[b:e]
            if not len(new) or len(every) < 2:
                continue
            alike = x[new] @ x[every].T
            apart = new[:, None] != every[None, :]
            for good, row_is_target in ((alike > worst[new][:, None], True), (alike > worst[every][None, :], False)):
                i, j = np.nonzero(good & apart)
                targets.append(new[i] if row_is_target else every[j])
                found.append(every[j] if row_is_target else new[i])
                scores.append(alike[i, j])
        if targets:
            yield _packs(*_best(ids[np.concatenate(targets)], ids[np.concatenate(found)], np.concatenate(scores), NEIGHBOURS))


def _round(state: DataFrame, buckets: int, number: int) -> DataFrame:
    edges = cut(state.select("node", "ids", "fresh").mapInArrow(_sampled, _EDGE_SQL), "near-edges")
    turn = Window.partitionBy("target", "fresh").orderBy(F.xxhash64("source", F.lit(number)))
    back = edges.withColumn("nth", F.row_number().over(turn)).where(F.col("nth") <= SAMPLE)
    meets = edges.select(F.col("target").alias("member"), F.col("source").alias("at"), "fresh").unionByName(back.select(F.col("source").alias("member"), F.col("target").alias("at"), "fresh"))

    def placed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_bucket(batch.column(1).to_numpy(zero_copy_only=False), buckets)), *batch.columns[1:]], names=["member", "bucket", "at", "fresh"])

    meets = meets.mapInArrow(placed, "member long, bucket long, at long, fresh int")
    own = state.select(F.col("node").alias("member"), F.lit(-1).cast("long").alias("bucket"), "unit", "worst", F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("fresh"))
    meets = meets.select("member", "bucket", F.lit(None).cast("binary").alias("unit"), F.lit(None).cast("float").alias("worst"), "at", "fresh")
    sent = own.unionByName(meets).repartition("member").sortWithinPartitions("member", "bucket").mapInArrow(_sent, _SENT_SQL)
    packs = cut(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compared, _PACK_SQL), "near-packs")
    out = cut(_merged(state, packs), "near-state")
    discard(edges, packs)
    return out


def graph(nodes: DataFrame, seed: int = 0, passes: int = PASSES, leaf: int = LEAF) -> DataFrame:
    """node, ids, scores: the neighbours of each node of _nodes, nearest first, packed."""
    n = nodes.count()
    buckets, empty = _buckets(n), F.lit(b"")
    blank = nodes.select("node", "unit", empty.alias("ids"), empty.alias("scores"), empty.alias("fresh"))
    state = cut(_merged(blank, _seeded(nodes, seed, passes, leaf)), "near-state")
    for number in range(ROUNDS):
        after = _round(state, buckets, number)
        discard(state)
        state = after
        if (state.agg(F.sum("changed")).first()[0] or 0) <= SETTLED * NEIGHBOURS * n:
            break
    return state.select("node", "ids", "scores")


@dataclass(frozen=True)
class Index:
    """Different vectors, the embedding of each node, and the graph of their neighbours."""

    nodes: DataFrame
    classes: DataFrame
    graph: DataFrame
    copies: int


def index(embeddings: DataFrame, copies: int = 21, seed: int = 0, passes: int = PASSES, leaf: int = LEAF) -> Index:
    """The index of embeddings(vec_id, embedding). Of equal vectors so many of the smallest ids are kept: one more than a search is to return."""
    rows = vectors(embeddings)
    classes, nodes = _nodes(rows, copies)
    return Index(nodes, classes, graph(nodes, seed, passes, leaf), copies)


_BEAM = pa.schema([("node", pa.int64()), ("vector", pa.binary()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())), ("done", pa.list_(pa.bool_())), ("next", pa.list_(pa.int64())), ("worst", pa.float64())])
_BEAM_SQL = "node long, vector binary, ids array<long>, scores array<double>, done array<boolean>, next array<long>, worst double"


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _started(entries: list[int], vectors: np.ndarray, kind: str):
    """Beams of the entries and the query's own node, which is expanded first."""

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            ids, scores = [], []
            for node, vector in zip(own.tolist(), batch.column(1)):
                q = np.frombuffer(vector.as_buffer(), kind).astype(float)
                others = np.array([e != node for e in entries], bool)
                ids.append(np.append(node, np.array(entries, np.int64)[others]))
                scores.append(np.append(q @ q, (vectors @ q)[others]))
            done = [np.arange(len(i)) == 0 for i in ids]
            columns = [_lists(ids, pa.int64()), _lists(scores, pa.float64()), _lists(done, pa.bool_()), _lists([i[:1] for i in ids], pa.int64()), pa.array(np.full(len(own), NONE))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=_BEAM)

    return run


_ASKED = pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("vector", pa.binary()), ("worst", pa.float64()), ("asked", pa.binary())])
_ASKED_SQL = "bucket long, node long, vector binary, worst double, asked binary"


def _asked(buckets: int):
    """Of each query the nodes next to the expanded ones that are not in its beam, by bucket. The beam comes first, then lists of neighbours."""

    def run(batches):
        out = []
        for (node,), members in groups(batches, 1):
            _, vector, known, worst, _ = members[0]
            near = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(m[4], "<i8") for m in members[1:])]))
            near = near[~np.isin(near, np.array(known, np.int64))]
            where = _bucket(near, buckets)
            order = np.argsort(where, kind="stable")
            near, where = near[order], where[order]
            out += [(int(where[b]), node, vector, worst, near[b:e].tobytes()) for b, e in zip(*_runs(where))]
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ASKED)], schema=_ASKED)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ASKED)], schema=_ASKED)

    return run


_ANSWER = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
_ANSWER_SQL = "node long, ids array<long>, scores array<double>"


def _answered(kind: str):
    """Exact scores above the worst of the beam. A bucket's nodes come first, then the queries that ask."""

    def told(out):
        nodes, ids, scores = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(list(ids), pa.int64()), _lists(list(scores), pa.float64())], schema=_ANSWER)

    def run(batches):
        at, ids, held, table, out = None, [], [], None, []
        for batch in batches:
            for bucket, asks, node, vector, worst, asked in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    at, ids, held, table = bucket, [], [], None
                if not asks:
                    ids.append(node)
                    held.append(np.frombuffer(vector, kind))
                    continue
                if table is None:
                    order = np.argsort(ids)
                    own, table = np.array(ids, np.int64)[order], np.vstack(held)[order].astype(float)
                near = np.frombuffer(asked, "<i8")
                score = table[np.searchsorted(own, near)] @ np.frombuffer(vector, kind).astype(float)
                good = score > worst
                if good.any():
                    out.append((node, near[good], score[good]))
            if len(out) >= 2000:
                yield told(out)
                out = []
        if out:
            yield told(out)

    return run


def _kept(beam: int):
    """Beams with what was found, and the best not yet expanded nodes to expand next. The old beam comes first."""

    def told(held):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([h[0] for h in held], pa.int64()),
                pa.array([h[1] for h in held], pa.binary()),
                *[_lists([h[k] for h in held], t) for k, t in ((2, pa.int64()), (3, pa.float64()), (4, pa.bool_()), (5, pa.int64()))],
                pa.array([h[6] for h in held], pa.float64()),
            ],
            schema=_BEAM,
        )

    def run(batches):
        held = []
        for (node,), members in groups(batches, 1):
            ids = np.concatenate([np.array(m[2], np.int64) for m in members])
            scores = np.concatenate([np.array(m[3], float) for m in members])
            done = np.concatenate([np.array(m[4] if m[4] is not None else np.zeros(len(m[2])), bool) for m in members])
            _, ids, scores, done = _best(np.zeros(len(ids), np.int64), ids, scores, beam, done)
            onward = np.flatnonzero(~done)[:EXPAND]
            done[onward] = True
            held.append((node, members[0][1], ids, scores, done, ids[onward], float(scores[-1]) if len(ids) == beam else NONE))
            if len(held) >= 2000:
                yield told(held)
                held = []
        if held:
            yield told(held)

    return run


def search(found: Index, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k indexed vectors with the largest inner products found for each of queries(vec_id, embedding).

    Queries are indexed rows, and their own vec_id is no answer; other rows with an equal vector are. Ties go to smaller ids. Rows that repeat
    an id and vector count once; an id with different vectors is a query for each. Fewer than k others give as many rows. Queries whose vectors take no part give none.
    """
    if k >= found.copies:
        raise ValueError("the index keeps too few ids of equal vectors")
    rows, nodes = vectors(queries).distinct(), found.nodes
    asked = rows.join(found.classes.select("embedding", "node"), "embedding").select(F.col("vec_id").alias("query_id"), "node")
    asked = cut(asked, "near-queries")
    n, kind = nodes.count(), "<f8" if "double" in found.classes.schema["embedding"].dataType.simpleString() else "<f4"
    buckets = _buckets(n)
    long = nodes.orderBy(F.desc("length"), "node").limit(ENTRIES).select("node", "vector").collect()
    first = np.vstack([np.frombuffer(r[1], kind) for r in long]).astype(float) if long else np.zeros((0, 0))
    own = nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "vector")
    beams = cut(own.mapInArrow(_started([r[0] for r in long], first, kind), _BEAM_SQL), "near-beams")
    none = {t: F.lit(None).cast(t) for t in ("binary", "long", "double", "array<long>", "array<boolean>")}
    for _ in range(STEPS):
        hops = beams.select("node", F.explode("next").alias("via")).join(found.graph.select(F.col("node").alias("via"), F.col("ids").alias("near")), "via")
        known = beams.select("node", F.lit(0).alias("kind"), "vector", "ids", "worst", none["binary"].alias("near"))
        hops = hops.select("node", F.lit(1).alias("kind"), none["binary"].alias("vector"), none["array<long>"].alias("ids"), none["double"].alias("worst"), "near")
        wanted = known.unionByName(hops).repartition("node").sortWithinPartitions("node", "kind").mapInArrow(_asked(buckets), _ASKED_SQL)
        held = nodes.select("bucket", F.lit(0).alias("asks"), "node", "vector", none["double"].alias("worst"), none["binary"].alias("asked"))
        met = held.unionByName(wanted.withColumn("asks", F.lit(1))).repartition("bucket").sortWithinPartitions("bucket", "asks")
        answers = met.select("bucket", "asks", "node", "vector", "worst", "asked").mapInArrow(_answered(kind), _ANSWER_SQL)
        old = beams.select("node", F.lit(0).alias("kind"), "vector", "ids", "scores", "done")
        answers = answers.select("node", F.lit(1).alias("kind"), none["binary"].alias("vector"), "ids", "scores", none["array<boolean>"].alias("done"))
        after = cut(old.unionByName(answers).repartition("node").sortWithinPartitions("node", "kind").mapInArrow(_kept(beam), _BEAM_SQL), "near-beams")
        discard(beams)
        beams = after
        if not beams.agg(F.sum(F.size("next"))).first()[0]:
            break
    most = k + 1
    near = beams.select("node", F.explode(F.arrays_zip("ids", "scores")).alias("x"), F.coalesce(F.get("scores", F.lit(k)), F.lit(NONE)).alias("least"))
    near = near.select("node", F.col("x.ids").alias("peer"), F.col("x.scores").alias("score"), "least").where("score >= least")
    named = near.join(nodes.select(F.col("node").alias("peer"), "members"), "peer").select("node", "score", F.explode("members").alias("vec_id"))
    lists = named.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, most).alias("best"))
    out = asked.join(lists, "node").select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return out.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
