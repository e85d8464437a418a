"""Matches between all tools, by classes, beside brute force over every pair of tools."""

import pytest

from tests.conftest import SF01
from vigilake.plans import catalog, matching


def of_rule(tool, items, spread):
    return frozenset(v for k, v in enumerate(items) if (tool * (k + 3) + k) % spread < 2)


@pytest.fixture(scope="module")
def sets(spark):
    ids = [r.tool_id for r in matching.tools(spark, SF01).select("tool_id").collect()]
    return {"v": {i: of_rule(i, matching.VARIABLES, 11) for i in ids}, "p": {i: of_rule(i, matching.PROTOCOLS, 13) for i in ids}, "c": {i: of_rule(i, matching.CAPABILITIES, 17) for i in ids}}


def expanded(spark, members, pairs):
    """{(tool, tool): score} of class pairs, and how often a pair of tools came."""
    tools = {}
    for r in catalog.QUERIES[members][0](spark, SF01).collect():
        tools.setdefault(r["class"], []).append(r.tool_id)
    out, n = {}, 0
    for r in catalog.QUERIES[pairs][0](spark, SF01).collect():
        assert (r.tools_a, r.tools_b) == (len(tools[r.a]), len(tools[r.b]))
        for x in tools[r.a]:
            for y in tools[r.b]:
                if x != y:
                    out[x, y] = r.score
                    n += 1
    assert n == len(out)
    return out


def test_shared_variables_of_all_tools(spark, sets):
    own = sets["v"]
    got = {(min(p), max(p)): s for p, s in expanded(spark, "variable_members", "j12_variable_classes").items()}
    want = {(x, y): round(len(own[x] & own[y]) / max(len(own[x]), len(own[y])), 6) for x in own for y in own if x < y and own[x] & own[y] and len(own[x] & own[y]) / max(len(own[x]), len(own[y])) >= 0.3}
    assert got == want and max(max(p) for p in got) >= 400


def test_a_third_of_the_variables_is_enough(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["c", "d", "e"]), (3, ["c", "b", "a", "a"]), (4, []), (5, None), (6, ["d", "w", "x", "y"])]
    members = matching.M.item_classes(spark.createDataFrame(rows, "tool_id long, variables array<string>"), "variables")
    assert {r.tool_id for r in members.collect()} == {1, 2, 3, 6}
    abc, cde = '["a","b","c"]', '["c","d","e"]'
    assert {tuple(r) for r in matching.M.shared_variable_classes(members).collect()} == {(abc, abc, 1.0, 2, 2), (abc, cde, 0.333333, 2, 1)}


@pytest.mark.parametrize("members, pairs, which, fits, each, most", [("capability_members", "j14_capability_classes", "c", matching.M.CAPABILITY_FITS, 0.3, 1), ("protocol_members", "j13_protocol_classes", "p", matching.M.PROTOCOL_FITS, 0.4, 0.8)])
def test_fits_of_all_tools(spark, sets, members, pairs, which, fits, each, most):
    own = sets[which]
    want = {}
    for x in own:
        for y in own:
            n = sum(w in own[y] for h in own[x] for w in fits.get(h, [])) if x != y else 0
            if n:
                want[x, y] = round(min(most, n * each), 6)
    assert expanded(spark, members, pairs) == want and max(max(p) for p in want) >= 400


def test_root_cause_of_a_large_group_by_hand(spark):
    rows = [("g", f"f{k % 7}" if k % 11 else None, (k * 37) % 260 if k % 13 else None, ["LOW", "HIGH"][k % 2], f"call w{k % 5} w{k % 3}" if k % 6 else "") for k in range(90)] + [("one", "f", 1, "LOW", "x")]
    got = {r.g: (r.findings, r.similarity) for r in matching.M.root_cause_similarity(spark.createDataFrame(rows, "g string, file string, line int, severity string, evidence string"), ["g"]).collect()}
    total, big = 0.0, rows[:90]
    for i, x in enumerate(big):
        for y in big[:i]:
            a, b = set(x[4].split()), set(y[4].split())
            total += 0.3 * (x[1] == y[1]) + 0.2 * (None not in (x[2], y[2]) and abs(x[2] - y[2]) < 50) + 0.1 * (x[3] == y[3]) + 0.4 * (len(a & b) / len(a | b) if a and b else 0)
    assert got == {"g": (90, pytest.approx(total / (90 * 89 / 2), abs=1e-6)), "one": (1, 0.0)}


def test_correlations_of_one_busy_user_by_hand(spark):
    from datetime import datetime, timedelta

    from vigilake.operators.context import recent_correlations

    start = datetime(2024, 1, 1)
    rows = [(k, 1 if k % 3 else None, start + timedelta(days=(k * 7) % 90), [f"a{k % 2}", f"b{k % 3}", f"c{k % 4}"] if k % 17 else []) for k in range(200)]
    got = {}
    for r in recent_correlations(spark.createDataFrame(rows, "scan_id long, user_id long, seen_at timestamp, items array<string>")).collect():
        got.setdefault(r.a, []).append((r.jaccard, r.b))
    for i, user, when, items in rows:
        past = [(len(set(items) & set(x)) / len(set(items) | set(x)), t, j) for j, u, t, x in rows if items and x and u == user and (t, j) < (when, i) and (when - t).days <= 30]
        want = sorted((p for p in past if p[0] > 0.3), reverse=True)[:5]
        assert sorted(got.get(i, [])) == sorted((round(s, 6), j) for s, _, j in want)


def test_correlations_of_odd_scans_in_two_shuffles(spark):
    """Months that meet, times before 1970, equal times, ids, null times and items, and each scan shuffled once before what is found for it."""
    import random
    from datetime import datetime, timedelta

    from vigilake.operators.context import recent_correlations

    rng, start = random.Random(3), datetime(1969, 6, 1)
    rows = [(k, k % 2, start + timedelta(days=rng.randint(0, 500), hours=rng.choice([0, 0, 23])), rng.sample(["a", "b", "c", "d", None], rng.randint(0, 4))) for k in range(400)]
    rows += [(k, 1, None, ["a", "b"]) for k in range(400, 405)] + [(500, 0, start + timedelta(days=200), ["a", "b", None]), (500, 1, start + timedelta(days=200), ["a", "b", "a"])]
    frame = spark.createDataFrame(rows, "scan_id long, user_id long, seen_at timestamp_ntz, items array<string>")
    found = recent_correlations(frame)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    want = {}
    for i, user, when, items in rows:
        own = set(items) - {None}
        for j, u, then, other in rows:
            both = set(other) - {None}
            if items and other and u == user and when and then and (then, j) < (when, i) and (when.date() - then.date()).days <= 30:
                jaccard = 1.0 if set(items) == set(other) else len(own & both) / max(1, len(own | both))
                if jaccard > 0.3:
                    want.setdefault(i, []).append((round(jaccard, 6), then, j))
    want = sorted((i, j, s) for i, some in want.items() for s, _, j in sorted(some, reverse=True)[:5])
    assert sorted((r.a, r.b, r.jaccard) for r in found.collect()) == want and len(want) > 500
