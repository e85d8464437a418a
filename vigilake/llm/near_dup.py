"""Near-duplicate classes by a chosen-path set-similarity join.

Documents are sets of word shingles; equal sets are one. Each run hashes every shingle of a set and
chooses those under RATE / (similarity * size), so similar sets share RATE of them on average, and each
chosen shingle is a bucket. All pairs of like size of a small bucket are compared by bottom-k
sketches, which are uniform samples of the sets. A large one is split: each of its sets goes on to a bucket for each shingle
that it chooses from its sketch by a hash of the path so far, until buckets are small. Sets that merely share a passage
part ways after a few steps, while similar ones stay together with the chance that a branching process
lives; runs are repeated until the target recall holds at any depth. Near copies would never part, so a large bucket
first has leaders, found in a sample of it: a set close to one is tied to it, and to all leaders at a distance that
the triangle inequality leaves to a pair alike, and isn't split. The components of these edges hold every candidate pair;
inside each, whole shingle sets are compared exactly, in blocks of bounded size, and only sums of
links and spanning edges leave a task.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_groups import batches_of, give_back, groups, texts_of
from .common import cut, text_of
from .components import components
from .shingles import forget, mix, shingle_sets

#: Chosen shingles of a set at each step, as a multiple of what a similar pair needs to share one on average.
RATE = 1.75
#: The least share of RATE that a similar pair keeps when shingles are chosen from sketches.
KEPT = 0.9
#: Steps of a path; what is left in large buckets after the last one is compared in pairs of blocks.
DEPTH = 8
#: Shingle hashes of a sketch.
SKETCH = 48
#: Sets of a large bucket among which leaders are sought, and how many must be close to one.
SAMPLE, FOLLOWERS = 1024, 8


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold is still unmet with probability under 1 - recall, however often buckets are split."""
    lives = 1.0
    for _ in range(200):
        lives = 1 - math.exp(-RATE * KEPT * lives)
    return max(1, math.ceil(math.log(1 - recall) / (-RATE * lives)))


def marks_for(similarity: float) -> tuple[float, float, float]:
    """Estimated similarities at which sets are candidates, close to a leader, and tied to it, the first and last with a margin for the sketches' errors."""

    def error(s: float) -> float:
        return math.sqrt(max(0.0, s * (1 - s)) / SKETCH)

    bound = 2 * similarity - 1
    return similarity - 4.5 * error(similarity), similarity, bound - 3 * error(bound)


_SETS = pa.schema([("doc_id", pa.int64()), ("code", pa.int64()), ("sid", pa.binary()), ("size", pa.int32()), ("paths", pa.list_(pa.int64())), ("sketch", pa.binary())])
_SETS_SQL = "doc_id long, code long, sid binary, size int, paths array<long>, sketch binary"


def _limit(similarity: float, n: np.ndarray) -> np.ndarray:
    """Hashes up to which shingles of sets of n are chosen."""
    share = np.minimum(1.0, RATE / (similarity * np.maximum(n, 1)))
    return np.where(share >= 1, np.uint64(2**64 - 1), (share * float(2**64 - 2048)).astype(np.uint64))


def _describe(width: int, similarity: float, runs: int):
    seeds = [np.uint64(int.from_bytes(hashlib.blake2b(str(run).encode(), digest_size=8).digest(), "little")) for run in range(runs)]

    def told(ids: pa.Array, codes: pa.Array, texts: list[str]) -> pa.RecordBatch:
        sets = shingle_sets(texts, width)
        n = np.array([len(s) for s in sets])
        flat, owner, begins = np.concatenate(sets), np.repeat(np.arange(len(sets)), n), np.cumsum(n) - n
        limit = _limit(similarity, n)[owner]
        paths, whose = [], []
        for run, seed in enumerate(seeds):
            picked = np.flatnonzero(mix(flat ^ seed) <= limit)
            paths.append(mix(flat[picked] + np.uint64(1 + run)).view(np.int64))
            whose.append(owner[picked])
        order = np.argsort(np.concatenate(whose), kind="stable")
        ends = np.cumsum(np.bincount(np.concatenate(whose), minlength=len(sets)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate(paths)[order]))
        sids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        hashes = (mix(flat ^ np.uint64(7)) >> np.uint64(32)).astype("<u4")
        sketches = [np.sort(hashes[b : b + k])[:SKETCH].tobytes() for b, k in zip(begins.tolist(), n.tolist())]
        return pa.RecordBatch.from_arrays([ids, codes, pa.array(sids, pa.binary()), pa.array(n.astype(np.int32)), lists, pa.array(sketches, pa.binary())], schema=_SETS)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in texts_of(b.column(2), 400_000):
                yield told(b.column(0).slice(start, len(texts)), b.column(1).slice(start, len(texts)), texts)

    return run_all


def _sets(docs: DataFrame, width: int, similarity: float, runs: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("code"), text_of().alias("text"))
    describe = _describe(width, similarity, runs)
    return rows.select("doc_id", "code", "text").mapInArrow(lambda batches: give_back(describe(batches)), _SETS_SQL)


class _Sketch:
    __slots__ = ("sid", "values", "set", "full", "size", "data")

    def __init__(self, size: int, sid: bytes, data: bytes):
        self.sid, self.size, self.data, self.values = sid, size, data, np.frombuffer(data, "<u4").tolist()
        self.set, self.full = frozenset(self.values), len(self.values) >= SKETCH

    def like(self, other: _Sketch) -> float:
        """The similarity estimated from the hashes up to the least last one of the full sketches."""
        end = min((s.values[-1] for s in (self, other) if s.full), default=None)
        n, m = len(self.values), len(other.values)
        if end is not None:
            n, m = bisect.bisect_right(self.values, end), bisect.bisect_right(other.values, end)
        shared = len(self.set & other.set)
        return shared / max(1, n + m - shared)


class _Groups(dict):
    """Disjoint sets: node -> a node nearer the root."""

    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, x, y) -> bool:
        """Whether x and y were apart until now."""
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _compare(members: list[tuple[int, bytes, bytes]], similarity: float, alike: float) -> Iterator[tuple[bytes, bytes]]:
    """Spanning edges of the alike ones of (size, sid, sketch), which come by size; those of unlike size are passed over."""
    if len(members) <= 40:
        few, first, tied = [_Sketch(*m) for m in members], 0, _Groups()
        for i, own in enumerate(few):
            while few[first].size < similarity * own.size - 1e-6:
                first += 1
            for other in few[first:i]:
                if own.like(other) >= alike and tied.join(own.sid, other.sid):
                    yield own.sid, other.sid
        return
    # sets that share hashes are found by lists of the holders of each hash, all of a set's lists at once
    lists = [np.frombuffer(data, "<u4") for _, _, data in members]
    sizes, held = np.array([m[0] for m in members]), np.array([len(v) for v in lists])
    ends = np.cumsum(held)
    table = np.full((len(members), SKETCH), 2**32 - 1, np.uint32)
    for i, v in enumerate(lists):
        table[i, : len(v)] = v
    last = np.where(held >= SKETCH, table[:, -1], np.uint32(2**32 - 1))
    flat, row = np.concatenate(lists), np.repeat(np.arange(len(members)), held)
    order = np.argsort(flat, kind="stable")
    holders, place = row[order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    begin = np.searchsorted(flat[order], flat, "left")
    lows = np.searchsorted(sizes, similarity * sizes - 1e-6, "left")
    label = np.arange(len(members))
    for i in range(1, len(members)):
        low, mine = int(lows[i]), slice(ends[i] - held[i], ends[i])
        n = place[mine] - begin[mine]
        total = int(n.sum())
        if low == i or not total:
            continue
        hits = holders[np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(total)]
        shared = np.bincount(hits, minlength=i)[low:i]
        near = np.flatnonzero(shared >= alike * np.maximum(held[low:i], held[i]) - 1e-9)
        if not len(near):
            continue
        shared, near = shared[near], near + low
        end = np.minimum(last[near], last[i])
        both = np.searchsorted(lists[i], end, "right") + np.minimum((table[near] <= end[:, None]).sum(1), held[near])
        near = near[shared >= alike * (both - shared)]
        for group in np.unique(label[near]).tolist():
            if group != label[i]:
                yield members[i][1], members[int(near[label[near] == group][0])][1]
                label[label == group] = label[i]


def _choices(path: int, data: bytes, similarity: float) -> list[int]:
    """The paths that a set with this sketch takes on from path."""
    values, seed = np.frombuffer(data, "<u4").astype(np.uint64), np.uint64(path % 2**64)
    picked = values[mix((values << np.uint64(32) | values) ^ seed) <= _limit(similarity, np.array([len(values)]))[0]]
    return mix(mix(picked + seed) ^ seed).view(np.int64).tolist()


_MET = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("path", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary())])
_MET_SQL = "a binary, b binary, path long, size int, sketch binary"


def _meet(similarity: float):
    """a, b: edges between the alike sets of a small bucket, and between those of a large one and its leaders. Without b: a takes path on."""
    alike, close, tie = marks_for(similarity)

    def rows(batches):
        for (path, _, large), members in groups(batches, 3):
            if not large:
                for a, b in _compare([m[1:] for m in members], similarity, alike):
                    yield a, b, None, None, None
                continue
            leaders, tied = [_Sketch(*m[1:]) for m in members if m[0]], _Groups()
            for own in (_Sketch(*m[1:]) for m in members if not m[0]):
                joins = False
                for leader in leaders:
                    like = own.like(leader)
                    joins |= like >= close
                    if like >= tie and tied.join(own.sid, leader.sid):
                        yield own.sid, leader.sid, None, None, None
                if not joins:
                    for on in _choices(path, own.data, similarity):
                        yield own.sid, None, on, own.size, own.data

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), _MET)

    return run_all


_HELD = pa.schema([("path", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("sid", pa.binary()), ("sketch", pa.binary())])
_HELD_SQL = "path long, n long, size int, sid binary, sketch binary"


def _lead(similarity: float, most: int):
    """The leaders of each bucket: of a sample, at most so many sets to which enough others are close."""
    _, close, _ = marks_for(similarity)

    def rows(batches):
        for (path, n), members in groups(batches, 2):
            leaders: list[list] = []
            for own in (_Sketch(*m) for m in members):
                found = next((x for x in leaders if own.like(x[0]) >= close), None)
                if found:
                    found[1] += 1
                elif len(leaders) < 4 * most:
                    leaders.append([own, 1])
            leaders.sort(key=lambda x: (-x[1], x[0].sid))
            for own, followers in leaders[:most]:
                if followers >= FOLLOWERS:
                    yield path, n, own.size, own.sid, own.data

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), _HELD)

    return run_all


def _dealt(held: DataFrame, salt: Column, large: Column, leader: Column) -> DataFrame:
    return held.select("path", salt.cast("int").alias("salt"), large.alias("large"), leader.alias("leader"), "size", "sid", "sketch")


def _candidates(reps: DataFrame, similarity: float, limit: int, most_leaders: int, depth: int) -> DataFrame:
    """a, b: edges whose components hold every candidate pair."""
    no, yes, edges = F.lit(False), F.lit(True), None
    rows = reps.select("sid", F.explode("paths").alias("path"))
    for step in range(depth):
        many = cut(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "near-buckets")
        held = rows.join(many, "path")
        if not step:
            held = held.join(reps.select("sid", "size", "sketch"), "sid")
        held = held.select("path", "n", "size", "sid", "sketch")
        dealt = _dealt(held.where(F.col("n") <= limit), F.lit(0), no, no)
        hot = not many.where(F.col("n") > limit).isEmpty()
        if hot:
            large = cut(held.where(F.col("n") > limit), "near-large")
            if step == depth - 1:
                blocks = F.ceil(F.col("n") * 2 / limit)
                pairs = large.withColumn("own", F.pmod(F.xxhash64("sid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
                dealt = dealt.unionByName(_dealt(pairs, F.least("own", "other") * blocks + F.greatest("own", "other"), no, no))
            else:
                salts = F.ceil(F.col("n") / limit)
                dealt = dealt.unionByName(_dealt(large, F.pmod(F.xxhash64("sid"), salts), yes, no))
                if marks_for(similarity)[2] > 0:
                    sample = large.where(F.pmod(F.xxhash64("path", "sid"), F.ceil(F.col("n") / SAMPLE)) == 0)
                    leaders = sample.repartition("path").sortWithinPartitions("path", "size", "sid").mapInArrow(_lead(similarity, most_leaders), _HELD_SQL)
                    shown = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
                    dealt = dealt.unionByName(_dealt(shown, F.col("salt"), yes, yes))
        dealt = dealt.repartition("path", "salt").sortWithinPartitions("path", "salt", "size", "sid")
        out = cut(dealt.mapInArrow(_meet(similarity), _MET_SQL), "near-met")
        found = out.where("b is not null").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        if not hot:
            break
        rows = out.where("b is null").select(F.col("a").alias("sid"), "path", "size", "sketch")
    return edges


_FOUND = pa.schema([("sid", pa.binary()), ("peer", pa.binary()), ("links", pa.int64())])


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of 0/1 matrices over slices of the shingles."""
    if len(left) * len(right) <= 36:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64).reshape(len(left), len(right))
    sides = []
    for side in (left, right):
        sides.append((np.concatenate(side), np.repeat(np.arange(len(side)), [len(s) for s in side])))
    common = np.intersect1d(sides[0][0], sides[1][0])
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), 4096):
        part, grids = common[at : at + 4096], []
        for (values, rows), side in zip(sides, (left, right)):
            place = np.searchsorted(part, values)
            place[place == len(part)] = 0
            hit = part[place] == values
            grid = np.zeros((len(side), len(part)), np.float32)
            grid[rows[hit], place[hit]] = 1
            grids.append(grid)
        total += grids[0] @ grids[1].T
    return total.astype(np.int64)


def _verify(width: int, similarity: float):
    """Exact links between the sets of a block, or of two blocks, of a component."""

    def rows(batches):
        for (_, low, high), members in groups(batches, 3):
            members = [(sid, block, docs, s) for (sid, block, docs, _), s in zip(members, shingle_sets([m[3] for m in members], width))]
            left = [m for m in members if m[1] == low]
            right = left if low == high else [m for m in members if m[1] == high]
            if not right or not left:
                continue
            shared = _shared_counts([m[3] for m in left], [m[3] for m in right])
            a, b = np.array([len(m[3]) for m in left]), np.array([len(m[3]) for m in right])
            linked = shared >= similarity * (a[:, None] + b[None, :] - shared) - 1e-9
            if low == high:
                np.fill_diagonal(linked, False)
            docs_a, docs_b = np.array([m[2] for m in left]), np.array([m[2] for m in right])
            for m, n in zip(left, (linked @ docs_b).tolist()):
                if n:
                    yield m[0], None, n
            if low != high:
                for m, n in zip(right, (docs_a @ linked).tolist()):
                    if n:
                        yield m[0], None, n
            yield from _spanning([m[0] for m in left], [m[0] for m in right], linked)
        forget()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), _FOUND)

    return run


def _spanning(left: list[bytes], right: list[bytes], linked: np.ndarray) -> Iterator[tuple]:
    """An edge wherever a link joins sets that no earlier one has joined."""
    tied = _Groups()
    for i, j in zip(*np.nonzero(linked)):
        if tied.join(left[i], right[j]):
            yield left[i], right[j], 0


#: Bits of the table that tells which texts may be needed, and bits of a row of it.
_BITS, _ROW = 1 << 25, 1 << 15


def _maybe_held(texts: DataFrame, code: str, members: DataFrame, member: str) -> DataFrame:
    """texts less rows whose hash surely is none of the members'; a table of 4 MB, whatever their number, is sent to all tasks."""
    row, place = f"pmod({{0}}, {_BITS}) div {_ROW}", f"pmod({{0}}, {_ROW})"
    marks = members.select(F.expr(row.format(member)).alias("__row"), F.expr(place.format(member)).alias("__place")).groupBy("__row").agg(F.bitmap_construct_agg("__place").alias("__marks"))
    told = texts.join(F.broadcast(marks), F.expr(row.format(code)) == F.col("__row"))
    bit = F.expr(f"shiftright(cast(conv(hex(substring(__marks, cast({place.format(code)} div 8 as int) + 1, 1)), 16, 10) as int), cast({place.format(code)} % 8 as int)) & 1")
    return told.where(bit == 1).drop("__row", "__marks")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.9999, limit: int = 4096, most_leaders: int = 32, block: int = 1024, depth: int = DEPTH) -> DataFrame:
    """doc_id, code, class_id, n_links for every row of docs(doc_id, text, ...).

    Rows are linked when the Jaccard similarity of their sets of width-word shingles is at least
    similarity; words are lower-case runs of letters, digits and underscores. class_id is the
    smallest doc_id of the connected rows and n_links the number of other rows that a row is linked
    to, copies included. code is xxhash64 of the text, to tell rows of one doc_id apart. Texts
    without words, null ones too, are linked to nothing and are classes of their own. Rows that repeat an id
    and text count as copies. A class whose ids are all null has a null class_id. No rows give no rows.

    recall: the least chance that a pair at the threshold is a candidate; limit: sets of a bucket
    whose pairs of like size are all compared; most_leaders: leaders of a larger one; depth: steps after which a bucket that is still larger is
    compared in pairs of blocks; block: sets, of 400 shingles on average at most, that are compared at once inside a component.
    """
    told, reps, full, sizes = _prepared(docs, similarity, width, recall, limit, most_leaders, block, depth)
    dealt = full.join(sizes, "root").select("root", "sid", "block", "docs", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "sid", "block", "docs", "text"
    )
    found = cut(_verified(dealt, width, similarity), "near-found")
    links = found.where("peer is null").groupBy("sid").agg(F.sum("links").alias("links"))
    joined = components(found.where("peer is not null").select(F.col("sid").alias("a"), F.col("peer").alias("b")))
    classes = reps.select("sid", "docs", "least").join(links, "sid", "left").join(joined.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    per_set = classes.join(named, "root").select(F.col("sid").alias("s"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    out = told.select("doc_id", "code", "sid").join(per_set, F.col("sid") == F.col("s"), "left")
    return out.select("doc_id", "code", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _prepared(docs: DataFrame, similarity: float, width: int, recall: float, limit: int, most_leaders: int, block: int, depth: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sets of all documents; one document of each different set; root, sid, block, docs, text of the sets in candidate components; and root, blocks."""
    told = cut(_sets(docs, width, similarity, runs_for(recall)), "near-sets")
    told_sets = told.where("sid is not null")
    counted = told_sets.groupBy("sid").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "code")).alias("rep"), F.min("doc_id").alias("least"))
    reps = cut(
        told_sets.join(counted.select("sid", "docs", "least", "rep"), "sid")
        .where(F.struct("doc_id", "code") == F.col("rep"))
        .dropDuplicates(["sid"])
        .select("sid", "size", "docs", "least", F.col("rep.doc_id").alias("rep_id"), F.col("rep.code").alias("rep_code"), "paths", "sketch"),
        "near-reps",
    )
    near = components(_candidates(reps, similarity, limit, most_leaders, depth))
    roots = near.select(F.col("root").alias("sid"), "root").distinct()
    members = cut(near.select(F.col("node").alias("sid"), "root").unionByName(roots).join(reps.select("sid", "size", "docs", "rep_id", "rep_code"), "sid"), "near-members")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*"), F.sum("size") / 400) / block).cast("int").alias("blocks"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep_id"), text_of().alias("text")).withColumn("rep_code", F.xxhash64("text"))
    texts = _maybe_held(texts, "rep_code", members, "rep_code")
    same = members.rep_id.eqNullSafe(texts.rep_id) & (members.rep_code == texts.rep_code)
    full = members.drop("size").join(texts, same).dropDuplicates(["sid"]).join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    return told, reps, full.select("root", "sid", "block", "docs", "text"), sizes


def _verified(dealt: DataFrame, width: int, similarity: float) -> DataFrame:
    """sid, peer, links from root, low, high, sid, block, docs, text: what _verify finds in each pair of blocks."""
    verify = _verify(width, similarity)
    return dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "sid").mapInArrow(lambda batches: give_back(verify(batches)), "sid binary, peer binary, links long")


def near_classes(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.9999, limit: int = 4096, most_leaders: int = 32, block: int = 1024, depth: int = DEPTH) -> DataFrame:
    """doc_id, code, class of every row in a class of near_duplicates with at least two rows; class is any value that tells classes apart.

    Links are not counted, so pairs that are in one class already need not be compared: each block is compared with itself, then one set of
    each large class of each block with the others, and of two blocks all sets only if they are not one class by then. A class of n near copies costs n comparisons for each set
    of a block, and its texts are sent twice.
    """
    told, reps, full, sizes = _prepared(docs, similarity, width, recall, limit, most_leaders, block, depth)
    full = cut(full, "near-texts")

    def edges(dealt: DataFrame) -> DataFrame:
        return cut(_verified(dealt, width, similarity).where("peer is not null").select(F.col("sid").alias("a"), F.col("peer").alias("b")), "near-found")

    def labelled(links: DataFrame) -> DataFrame:
        """root, sid, block, class: the smallest set that the links so far lead to."""
        joined = components(links).select(F.col("node").alias("sid"), F.col("root").alias("class"))
        return full.select("root", "sid", "block").join(joined, "sid", "left").withColumn("class", F.coalesce("class", "sid"))

    found = edges(full.select("root", F.col("block").alias("low"), F.col("block").alias("high"), "sid", "block", "docs", "text"))
    split = sizes.where("blocks > 1").select("root", "blocks")
    if not split.isEmpty():
        large = labelled(found).join(split.select("root"), "root", "left_semi").groupBy("root", "block", "class").agg(F.count("*").alias("n"), F.min("sid").alias("sid")).where(F.col("n") >= FOLLOWERS)
        heads = full.join(large.select("sid"), "sid", "left_semi").join(large.groupBy("root").agg(F.ceil(F.count("*") / block).alias("parts")), "root")
        part = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
        found = found.unionByName(edges(heads.select("root", part.alias("low"), part.alias("high"), "sid", part.alias("block"), "docs", "text")))
        kinds = labelled(found).join(split.select("root"), "root", "left_semi").groupBy("root", "block").agg(F.min("class").alias("least"), F.max("class").alias("most"))
        low, high = (kinds.select("root", *[F.col(c).alias(f"{side}_{c}") for c in ("block", "least", "most")]) for side in ("low", "high"))
        one = (F.col("low_least") == F.col("low_most")) & (F.col("high_least") == F.col("high_most")) & (F.col("low_least") == F.col("high_least"))
        pairs = low.join(high, "root").where((F.col("low_block") < F.col("high_block")) & ~one).select("root", F.col("low_block").alias("low"), F.col("high_block").alias("high"))
        sides = pairs.withColumn("block", F.explode(F.array("low", "high")))
        found = found.unionByName(edges(full.join(sides, ["root", "block"]).select("root", "low", "high", "sid", "block", "docs", "text")))
    joined = components(found)
    heads = joined.select(F.col("root").alias("sid"), "root").distinct()
    whole = joined.select(F.col("node").alias("sid"), "root").unionByName(heads)
    copies = reps.where("docs > 1").select("sid").join(whole.select("sid"), "sid", "left_anti").select("sid", F.col("sid").alias("root"))
    return told.select("doc_id", "code", "sid").join(whole.unionByName(copies), "sid").select("doc_id", "code", F.col("root").alias("class"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.9999) -> DataFrame:
    """docs less all but the row with the smallest doc_id of each class of near_duplicates, found by near_classes.

    All columns stay as they are. Of a class whose ids are all null, and of rows that share the
    smallest doc_id, the text with the smallest hash stays; rows that repeat both are one document
    and stay together.
    """
    found = near_classes(docs, similarity, width, recall)
    best = found.groupBy("class").agg(F.min(F.struct("doc_id", "code")).alias("best"))
    gone = (
        found.join(best, "class")
        .where(F.struct("doc_id", "code") != F.col("best"))
        .select(F.col("doc_id").alias("__gone_id"), F.col("code").alias("__gone_code"))
        .distinct()
    )
    code = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__gone_id"]) & (code == gone["__gone_code"]), "left_anti")
