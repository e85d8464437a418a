"""Repairs against plain versions: every script of edits on short conversations, a table of states on whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tests.conftest import SF
from vigilake.llm import conversation_repair as cr
from vigilake.llm import queries

BLANK, ENDS = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def every_script(rows):
    """The least (cost, audit) by trying all edits with up to two insertions before each row and at the end."""
    inserted = [w for n in range(3) for w in itertools.product("ua", repeat=n)]
    best = None

    def go(i, roles, cost, audit):
        nonlocal best
        for extra in inserted:
            now, total, told = roles + "".join(extra), cost + 3 * len(extra), audit + "I" * len(extra)
            if best and total > best[0]:
                continue
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", now) and (best is None or (total, told) < best):
                    best = total, told
                continue
            initial, fault = rows[i]
            go(i + 1, now, total + 4, told + "D")
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                go(i + 1, now + initial, total + more, told + "K")
                for role in "ua":
                    go(i + 1, now + role, total + more + 3, told + "R")

    go(0, "", 0, "")
    return best


def test_cheapest_of_all_scripts():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice("suuaax"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 3))]
        assert cr.cheapest([(i, f, 1) for i, f in rows]) == every_script(rows), rows


def plain(rows):
    """{conv_id: digest columns} of damaged rows, by a table of the best (cost, audit, turns) of each last role."""
    hurt = {}
    for conv, turn, role, text in rows:
        key = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        code, (_, _, role, text) = zlib.crc32(f"{key[0]}:{key[1]}".encode()) % 20, key
        hurt.setdefault(conv, [])
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        hurt[conv] += [] if code == 0 else [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, turns in hurt.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            fault = "blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "" if ENDS.search(text) else "truncated"
            seen.add((role, text))
            faults.append(fault)
        best = {"": (0, "", [])}

        def insert(best):
            for _ in range(2):
                for last, (cost, audit, said) in list(best.items()):
                    role = "assistant" if last == "u" else "user"
                    new = (cost + 3, audit + "I", said + [f"{role}:"])
                    best[role[0]] = min(best.get(role[0], new), new, key=lambda b: b[:2])
            return best

        follows = {"": "su", "s": "u", "u": "a", "a": "u"}
        for (_, role, text), fault in zip(turns, faults):
            now = {}
            for last, (cost, audit, said) in insert(best).items():
                ways = [(last, cost + 4, "D", [])]
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    ways += [(role[:1], cost + more, "K", [f"{role}:{text}"])] if role[:1] and role[0] in follows[last] else []
                    ways += [(r[0], cost + more + 3, "R", [f"{r}:{text}"]) for r in ("user", "assistant") if r[0] in follows[last]]
                for to, total, edit, more in ways:
                    new = (total, audit + edit, said + more)
                    now[to] = min(now.get(to, new), new, key=lambda b: b[:2])
            best = now
        best = insert(best)
        cost, audit, said = min((best[e] for e in ("", "a") if e in best), key=lambda b: b[:2])
        known = [t for t, _, _ in turns if t is not None]
        roles = [r[:1] for _, r, _ in turns]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def run(spark, rows, monkeypatch, schema="conv_id long, turn long, role string, text string"):
    monkeypatch.setattr(queries, "table", lambda *_: rows if not isinstance(rows, list) else spark.createDataFrame(rows, schema))
    got = queries.op11_conversation_repair(spark, "").collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


@pytest.mark.parametrize("block, fan", [(1024, 64), (3, 2)])
def test_whole_table_and_split_conversations(spark, monkeypatch, block, fan):
    monkeypatch.setattr(cr.repair, "__defaults__", (block, fan))
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    want = plain([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    assert run(spark, rows, monkeypatch) == want


def test_long_conversation_in_many_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "user", "assistant", "system", None]), rng.choice([f"said {i}.", f"said {i}", " ", "again.", None])) for i in range(400)]
    rows += [(None, None, "user", "Hm."), (None, None, "user", "Hm."), (8, None, None, None), (8, 3, "user", "x" * 200_000 + "."), (9, 9, "assistant", "Fine.\n")] + [(10, 1, "user", "Copy!")] * 50
    monkeypatch.setattr(cr.repair, "__defaults__", (4, 3))
    assert run(spark, rows, monkeypatch) == plain(rows)


def test_dropped_empty_and_other_columns(spark, monkeypatch):
    gone = [(i, 0, "user", "All of it goes.") for i in range(400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    assert gone and run(spark, gone, monkeypatch) == plain(gone)
    assert run(spark, [], monkeypatch) == {}
    extra = spark.createDataFrame([(1, 1, "user", "Hi.", 5, "x", "y"), (1, 2, "assistant", "Yes", 6, "x", "y")], "conv_id long, turn long, role string, text string, pos int, audit string, block string")
    assert run(spark, extra, monkeypatch) == plain([(1, 1, "user", "Hi."), (1, 2, "assistant", "Yes")])


def test_repaired_turns(spark):
    rows = spark.createDataFrame([("c", 1, "assistant", "First."), ("c", 2, "assistant", "Second."), ("c", 3, "user", "Cut")], "conv_id string, turn int, role string, text string")
    told, turns = cr.repair(rows)
    assert [(r.cost, r.audit, r.truncated) for r in told.collect()] == [(8, "IKIKD", 1)] or [r.cost for r in told.collect()] == [every_script([("a", ""), ("a", ""), ("u", "truncated")])[0]]
    assert told.first().audit == every_script([("a", ""), ("a", ""), ("u", "truncated")])[1]
    said = turns.orderBy("position").collect()
    assert [r.role[0] for r in said] == list("ua" * (len(said) // 2)) and {r.text for r in said} <= {"First.", "Second.", "Cut", ""}
