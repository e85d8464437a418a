"""Repair of broken conversations: the cheapest edits that make roles take turns again.

Rows that repeat (conv_id, turn, role, text) are counted, ordered by conversation and turn over all tasks and numbered, so a
conversation may lie in many tasks. Blocks of at most BLOCK rows are searched by Dijkstra's algorithm on the
implicit lattice of (rows taken, state of the grammar), with (cost, audit) as priority, the audit being the initials of the edits so
far. A conversation that lies inside a block ends with the first accepting end node that is popped. One that begins or ends
a block may go on elsewhere: there the cheapest way from each state to each state is found, and such tables of
neighbouring blocks are joined by the same search, FAN at a time. Paths of a block end with a row taken, so none of equal cost begins another and
least audits of blocks make up the least audit of the conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_groups import batches_of, groups
from .common import cut

#: Costs of edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a block, and tables joined at once.
BLOCK, FAN = 1024, 64

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = (_START, _SYSTEM, _USER, _ASSISTANT)
#: The grammar (s?(ua)+)? of role initials.
_STEPS = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_ACCEPTS = (_START, _ASSISTANT)
_NAMES = {"u": "user", "a": "assistant"}


def _due(state: int) -> str:
    """Initial of the role that an insertion or a change of role must give."""
    return "a" if state == _USER else "u"


def _row_moves(initial: str, fault: str, copies: int, state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, edits) of the ways to take a row and its copies; all but the first of these are duplicates.

    An insertion between copies costs the same after them, where its audit is smaller.
    """
    yield state, DELETE * copies, "D" * copies
    if fault in ("blank", "duplicate"):
        return
    rest, cost = "D" * (copies - 1), DELETE * (copies - 1) + (TRUNCATED if fault == "truncated" else 0)
    if (state, initial) in _STEPS:
        yield _STEPS[state, initial], cost, "K" + rest
    yield _STEPS[state, _due(state)], cost + REROLE, "R" + rest


def _search(length: int, start: int, moves: Callable, inserts: Callable) -> Iterator[tuple[int, int, str]]:
    """End nodes as (state, cost, audit) in the order in which Dijkstra's algorithm pops them."""
    heap, settled = [(0, "", 0, start)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == length:
            yield state, cost, audit
        else:
            for to, more, edits in moves(i, state):
                if (i + 1, to) not in settled:
                    heapq.heappush(heap, (cost + more, audit + edits, i + 1, to))
        if inserts(i):
            to = _STEPS[state, _due(state)]
            if (i, to) not in settled:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, to))


def _first_accepting(ends: Iterator[tuple[int, int, str]]) -> tuple[int, str]:
    return next((cost, audit) for state, cost, audit in ends if state in _ACCEPTS)


def cheapest(rows: list[tuple[str, str, int]]) -> tuple[int, str]:
    """(cost, audit) of a conversation's rows, each a role initial, a fault or "", and a number of copies."""
    return _first_accepting(_search(len(rows), _START, lambda i, s: _row_moves(*rows[i], s), lambda i: True))


def _ways(length: int, moves: Callable, inserts: Callable) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) for each pair of states that a path joins."""
    return [(start, *end) for start in _STATES for end in _search(length, start, moves, inserts)]


def _breaks(initials: list[tuple[str, int]]) -> int:
    """Adjacent roles that the grammar never has, in runs of (initial, copies)."""
    inner = sum(n - 1 for _, n in initials)
    return inner + sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(initials, initials[1:]))


_WAY = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_PART = [("block", pa.int64()), ("whole", pa.bool_()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("ways", pa.list_(_WAY))]
_PART_SQL = "block long, whole boolean, illegal long, head string, tail string, ways array<struct<start: int, stop: int, cost: long, audit: string>>"


def _as_ways(ways) -> list[dict]:
    return [dict(zip(("start", "stop", "cost", "audit"), way)) for way in ways]


def _blocks(schema: pa.Schema):
    def rows(batches):
        for (block,), members in groups(batches, 1):
            runs: list[tuple] = []
            for conv, initial, fault, copies in members:
                if not runs or runs[-1][0] != conv:
                    runs.append((conv, []))
                runs[-1][1].append((initial, fault, copies))
            for k, (conv, own) in enumerate(runs):
                initials = [(initial, copies) for initial, _, copies in own]
                whole = 0 < k < len(runs) - 1
                if whole:
                    ways = [(_START, _START, *cheapest(own))]
                else:
                    ways = _ways(len(own), lambda i, s, own=own: _row_moves(*own[i], s), lambda i, n=len(own): i < n)
                yield conv, block, whole, _breaks(initials), initials[0][0], initials[-1][0], _as_ways(ways)

    return lambda batches: batches_of(rows(batches), schema, 200)


def _joined(schema: pa.Schema, last: bool):
    """Neighbouring parts of a conversation made one; the last time only the cheapest way of the whole stays."""

    def rows(batches):
        for (conv, block), parts in groups(batches, 2):
            tables = []
            for part in parts:
                table: dict = {}
                for way in part[-1]:
                    table.setdefault(way["start"], []).append((way["stop"], way["cost"], way["audit"]))
                tables.append(table)
            illegal = sum(p[2] for p in parts) + sum(a[4] + b[3] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))

            def moves(i, state, tables=tables):
                return tables[i].get(state, ())

            if last:
                ways = [(_START, _START, *_first_accepting(_search(len(tables), _START, moves, lambda i, n=len(tables): i == n)))]
            else:
                ways = _ways(len(tables), moves, lambda i: False)
            yield conv, block, last, illegal, parts[0][3], parts[-1][4], _as_ways(ways)

    return lambda batches: batches_of(rows(batches), schema, 200)


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of turns broken on purpose, by crc32 of "conv_id:turn" modulo 20.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls count as one space.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    code = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(part[3], "[.!?]", "")).otherwise(part[3])
    return turns.where(code != 0).select("conv_id", "turn", F.when(code == 4, "user").otherwise(part[2]).alias("role"), text.alias("text"), F.when(code == 3, 2).otherwise(1).cast("long").alias("copies"))


def _numbered(turns: DataFrame) -> DataFrame:
    """Different rows in the order of (conv_id, turn, role, text) with the number of their copies, a position, and what the text ends with."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1).cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    begin = F.substring("text", 1, 64)
    dealt = rows.repartitionByRange("conv_id", "turn", "role", begin).sortWithinPartitions("conv_id", "turn", "role", "text")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return cut(dealt.select("*", F.monotonically_increasing_id().alias("pos"), blank.alias("blank"), ended.alias("ended"), same.alias("same")), "turns")


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos, initial, fault, copies: the first fault of each row, or ""."""
    firsts = rows.where("not blank").groupBy("conv_id", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    slim = rows.select("conv_id", "turn", "pos", F.substring("role", 1, 1).alias("initial"), "blank", "ended", "copies").join(firsts, "pos", "left")
    return cut(slim.select("conv_id", "turn", "pos", "initial", fault.alias("fault"), "copies"), "faults")


def _counted(faults: DataFrame) -> DataFrame:
    def number(when: Column, n: Column) -> Column:
        return F.sum(F.when(when, n).otherwise(0)).cast("long")

    own = F.col("fault")
    turns = faults.groupBy("conv_id", "turn").agg(
        number(own == "blank", F.col("copies")).alias("blank"),
        (number(own == "duplicate", F.col("copies")) + number(own.isin("", "truncated"), F.col("copies") - 1)).alias("duplicate"),
        number(own == "truncated", F.lit(1)).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def _plans(faults: DataFrame, size: int, fan: int) -> DataFrame:
    """conv_id, illegal, cost, audit of each conversation."""
    conv = faults.schema["conv_id"]
    sql = f"conv_id {conv.dataType.simpleString()}, {_PART_SQL}"
    schema = pa.schema([("conv_id", pa.int64() if conv.dataType.simpleString() == "bigint" else pa.int32() if conv.dataType.simpleString() == "int" else pa.string()), *_PART])
    dealt = faults.select(F.expr(f"pos div {size}").alias("block"), "conv_id", "initial", "fault", "copies", "pos").repartition("block").sortWithinPartitions("block", "pos").drop("pos")
    parts = cut(dealt.mapInArrow(_blocks(schema), sql), "parts")
    whole, parts = parts.where("whole"), parts.where("not whole")
    while True:
        most = parts.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
        last = most <= fan
        key = F.lit(0).cast("long") if last else F.expr(f"block div {fan}")
        near = parts.select("conv_id", key.alias("key"), *parts.columns[1:]).repartition("conv_id", "key").sortWithinPartitions("conv_id", "key", "block")
        parts = cut(near.mapInArrow(_joined(schema, last), sql), "parts")
        if last:
            break
    way = F.col("ways")[0]
    return whole.unionByName(parts).select("conv_id", "illegal", way["cost"].alias("cost"), way["audit"].alias("audit"))


_TURN = [("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]


def _edited(schema: pa.Schema):
    """Repaired turns of each conversation: its audit comes first, then its rows in order, one at a time."""

    def rows(batches):
        conv, audit, at, state, place, begun = None, "", 0, _START, 0, False

        def inserted():
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                due = _due(state)
                yield conv, place, "I", _NAMES[due], ""
                at, place, state = at + 1, place + 1, _STEPS[state, due]

        for batch in batches:
            for owner, found, role, text, copies in zip(*batch.columns):
                if found.is_valid:
                    if begun:
                        yield from inserted()
                    conv, audit, at, state, place, begun = owner.as_py(), found.as_py(), 0, _START, 0, True
                    continue
                yield from inserted()
                edit, at = audit[at], at + copies.as_py()
                if edit == "D":
                    continue
                name = role.as_py() if edit == "K" else _NAMES[_due(state)]
                yield conv, place, edit, name, text.as_py()
                place, state = place + 1, _STEPS[state, name[0]]
        if begun:
            yield from inserted()

    return lambda batches: batches_of(rows(batches), schema, 200)


def repair(turns: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired turns) of turns(conv_id, turn, role, text, and copies where rows stand for several).

    Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. gaps are turn numbers that are missing between
    the least and the largest; blank, duplicate and truncated count rows by their first fault, illegal adjacent rows
    whose roles can't follow each other. Keeping a row costs nothing, a change of role to user or assistant 3, a deletion
    4 and is required for blank rows and duplicates, an inserted empty turn 3; truncated rows that stay add 3. The audit has K, R, D or I for
    each edit, and is the ASCII-least of the cheapest. Repaired turns: conv_id, position from 0, edit, role, text, in order inside tasks
    that hold whole conversations.

    Rows go by (turn, role, text), null turns first; null roles and texts are one space; a null conv_id is an id. Roles count by their first character. Rows
    that are the same in all four columns are one after the other. No rows give no rows. Other columns are ignored. A conversation's audit is one value and must fit a task;
    its texts pass one at a time.
    """
    rows = _numbered(turns)
    faults = _faults(rows)
    plans = cut(_plans(faults, block, fan), "plans")
    counted = _counted(faults).withColumnRenamed("conv_id", "__conv_id")
    told = plans.join(counted, F.col("conv_id").eqNullSafe(F.col("__conv_id"))).drop("__conv_id")
    conv = rows.schema["conv_id"].dataType.simpleString()
    audits = plans.select("conv_id", F.lit(-1).cast("long").alias("pos"), "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("copies", "long"))])
    both = audits.unionByName(rows.select("conv_id", "pos", F.lit(None).cast("string").alias("audit"), "role", "text", "copies"))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "pos").drop("pos")
    schema = pa.schema([("conv_id", {"bigint": pa.int64(), "int": pa.int32()}.get(conv, pa.string())), *_TURN])
    edited = dealt.mapInArrow(_edited(schema), f"conv_id {conv}, position long, edit string, role string, text string")
    return told.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), edited


def fingerprints(repaired: DataFrame) -> DataFrame:
    """conv_id, turns, sha256 of the newline-joined role:text lines of repaired turns as repair gives them; texts pass through one at a time."""
    conv = repaired.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", {"bigint": pa.int64(), "int": pa.int32()}.get(conv, pa.string())), ("turns", pa.int64()), ("sha256", pa.string())])

    def rows(batches):
        conv, n, code = None, 0, None
        for batch in batches:
            for owner, position, role, text in zip(*batch.columns):
                if position.as_py() == 0:
                    if code:
                        yield conv, n, code.hexdigest()
                    conv, n, code = owner.as_py(), 0, hashlib.sha256()
                code.update((("\n" if n else "") + role.as_py() + ":" + text.as_py()).encode())
                n += 1
        if code:
            yield conv, n, code.hexdigest()

    return repaired.select("conv_id", "position", "role", "text").mapInArrow(lambda batches: batches_of(rows(batches), schema), f"conv_id {conv}, turns long, sha256 string")
