"""Automaton scans, scans of uncloaked texts, whole contents and the flow on texts made by hand."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilake.operators import content, flow, rulescan

RULES = "id string, phase string, severity string, pattern string, weight int, description string, file_filter struct<filename_exact: array<string>, extensions: array<string>, filename_suffix: array<string>>, suppress struct<path_contains: array<string>, filename_suffix: array<string>, line_contains: array<string>, nearby_contains: array<string>, file_header_contains: array<string>, safe_domains: array<string>>"


def rule(id, pattern, filter=None, suppress=None):
    return (id, "code_patterns", "HIGH", pattern, 2, "", filter, suppress)


def found(spark, files, rules, **more):
    files = spark.createDataFrame(files, "path string, text string")
    return sorted((r.path, r.line, r.offset, r.rule) for r in rulescan.scan_rules(files, spark.createDataFrame(rules, RULES), **more).collect())


PIECES = st.sampled_from(["abc", "x", "(foo|bar)", "[0-9]", "(?:ab)+", "q?", "\\s*", ".", "(a|bc|)", "K", "ſ", "e{2,3}", "\\.", "^", "$", "\\b", "(?=ab)"])


@given(st.lists(PIECES, min_size=1, max_size=5), st.text(alphabet="abcfooxKksſ0 .eqé", max_size=25), st.booleans())
@settings(max_examples=400, deadline=None)
def test_required_words_stand_in_all_that_matches(pieces, text, folded):
    """The automaton passes over no line that the pattern matches."""
    pattern = ("(?i)" if folded else "") + "".join(pieces)
    rules = rulescan.RuleSet([pattern])
    got = [m for m in rulescan.line_matches(rules, text, False)]
    assert bool(got) == bool(text and re.search(pattern, text))


WIDER = [*["abc", "x", "(foo|bar)", "[0-9]", "(?:ab)+", "q?", "\\s*", ".", "(a|bc|)", "e{2,3}", "^", "$", "\\b", "(?=ab)"], "[0-9]{2,}", "\\d{2}", "(^|[^0-9])", "[%$]{2}", ".*", "(?<=a)", "(?i:kk)", "(?:[0-9]ab|xx)", "(?>ab)", "[.,]{1,3}?", "(\\d\\d)", "(?!x)", "a\\bb"]


@given(st.lists(st.lists(st.sampled_from(WIDER), min_size=1, max_size=5), min_size=1, max_size=4), st.text(alphabet="abcfooxKk01 .,%$eqé\n\r", max_size=60), st.booleans())
@settings(max_examples=400, deadline=None)
def test_first_matches_where_few_places_are_tried(patterns, text, folded):
    """Of each rule and line the first match of a search, also of rules with one pattern."""
    patterns = [("(?i)" if folded else "") + "".join(p) for p in patterns] * 2
    want, begin = [], 0
    for n, body in enumerate(text.split("\n")):
        last = begin + len(body) == len(text)
        for rule, pattern in enumerate(patterns):
            found = (body or not last) and re.search(pattern, body.removesuffix("\r"))
            if found:
                want.append((n + 1, begin + found.start(), rule))
        begin += len(body) + 1
    assert [m[:3] for m in rulescan.line_matches(rulescan.RuleSet(patterns), text, False)] == want


def test_rules_are_tried_at_few_places(monkeypatch):
    """Numbers are looked for at runs of digits, words where they stand, and equal patterns once; no line is searched with a pattern."""
    number, word = "(^|[^0-9])[0-9]{3}([^0-9]|$)", "(^|[^a-z])abc[a-z]{2}([^a-z]|$)"
    rules = rulescan.RuleSet([number, word, number])
    assert [(p.pattern, r) for p, r in rules.runs] == [("[0-9]+", [(0, 3, 0, 1)])] and rules.loose == [] and rules.alike == {0: [0, 2], 1: [1]}
    tried, first = [], rulescan._first
    monkeypatch.setattr(rulescan, "_first", lambda pattern, body, places: tried.append(sorted(places)) or first(pattern, body, places))
    text = "z" * 1000 + " abcde 12 123 " + "abcd " * 3
    assert [m[1:3] for m in rulescan.line_matches(rules, text, False)] == [(1009, 0), (1000, 1), (1009, 2)]
    assert tried == [[(1000, 1001), (1013, 1014), (1018, 1019), (1023, 1024)], [(1009, 1010)]]


def test_snippets_are_the_same_with_and_without_suppression(spark):
    """Rules without suppression leave long lines in the tasks, but for what a snippet shows."""
    lines = ["  abc " + "é" * n + " " * pad + tail for n in (0, 92, 97, 98, 197, 200, 300) for pad in (0, 3, 90) for tail in ("", "z", "z" * 300)]
    files = spark.createDataFrame([("a.js", "\n".join(lines))], "path string, text string")
    one, other = [rule("ALL", "abc")], [rule("ALL", "abc"), rule("NONE", "never", None, (["x"], None, None, None, None, None))]
    shown = [[(r.line, r.snippet) for r in rulescan.scan_rules(files, spark.createDataFrame(rules, RULES)).collect()] for rules in (one, other)]
    assert sorted(shown[0]) == sorted(shown[1]) and len(shown[0]) == len(lines)


def test_words_of_patterns():
    assert rulescan.required_words(r"(?i)child_process|EXEC\s*\(") == ("child_process", "exec")
    assert rulescan.required_words(r"a(bc)+d?efg") == ("efg",)
    for none in (r"[0-9]{16}", "(abc)?x", "a|", "(", "x*", "é"):
        assert rulescan.required_words(none) == ()


def test_filters_suppression_blocks_and_bad_patterns(spark):
    files = [("a/x.js", "eval(1)\nsafe eval(2)\neval(3)\n\n\nlater"), ("b.min.js", "eval(4)"), ("Makefile", "eval(5)\r\n"), ("c.js", None), ("d.js", ""), ("ok/e.js", "eval(6)")]
    rules = [
        rule("ALL", r"eval\("), rule("JS", r"eval\(", ([], [".js"], [])), rule("EXACT", r"eval\(", (["Makefile"], None, None)), rule("END", r"eval\(", (None, None, ["min.js"])), rule("NONE", r"eval\(", ([], [], [])),
        rule("LINE", r"eval\(", None, (["ok/"], ["min.js"], ["safe"], ["later"], [], [])), rule("HEAD", r"eval\(", None, (None, None, None, None, ["eval(5)"], ["eval(4)"])), rule("BAD", "(eval"), rule("DIGIT", "[0-9]"), rule("BACK", r"(e)val\1?"),
    ]
    got = found(spark, files, rules)
    every = [("Makefile", 1, 0), ("a/x.js", 1, 0), ("a/x.js", 2, 13), ("a/x.js", 3, 21), ("b.min.js", 1, 0), ("ok/e.js", 1, 0)]
    by = {id: [(p, line) for p, line, _, r in got if r == id] for id in [r[0] for r in rules]}
    places = [(p, n) for p, n, _ in every]
    assert by["ALL"] == places == by["NONE"] == by["BACK"] == by["DIGIT"] and by["BAD"] == []
    assert by["JS"] == [p for p in places if p[0].endswith(".js")] and by["EXACT"] == [("Makefile", 1)] and by["END"] == [("b.min.js", 1)]
    assert by["LINE"] == [("Makefile", 1), ("a/x.js", 1)] and by["HEAD"] == [p for p in places if p[0] not in ("Makefile", "b.min.js")]
    assert found(spark, files, rules, block=3) == got and found(spark, [], rules) == [] and found(spark, files, []) == []


def test_offsets_in_cloaked_texts(spark):
    text = "﻿ok\nx = ev​al‮(y) é‍é\na‍b eval("
    assert found(spark, [("f", text)], [rule("EVAL", r"eval\(")]) == [("f", 2, text.index("ev"), "EVAL"), ("f", 3, text.index("eval("), "EVAL")]
    assert found(spark, [("f", text)], [rule("EVAL", r"eval\(")], decloak=False) == [("f", 3, text.index("eval("), "EVAL")]


def test_columns_of_files_and_rules_stay(spark):
    files = spark.createDataFrame([(1, "f", "eval(", [1, 2], {"k": "v"})], "line long, path string, text string, list array<int>, map map<string,string>").withColumnRenamed("line", "scan_id")
    rules = spark.createDataFrame([("E", "eval", "p")], "id string, pattern string, pack string")
    row = rulescan.scan_rules(files, rules).first()
    assert (row.scan_id, row.list, row.map, row.pack, row.rule, row.weight, row.severity) == (1, [1, 2], {"k": "v"}, "p", "E", 1, None)


def test_matches_over_lines(spark):
    rules = [{"id": "FETCH", "phase": "network_exfil", "severity": "HIGH", "pattern": r"fetch\(\s*'http"}, {"id": "START", "phase": "code_patterns", "severity": "LOW", "pattern": "^let"}, {"id": "code-eval", "phase": "code_patterns", "severity": "HIGH", "pattern": r"\beval\("}]
    text = "let a\nfetch(\n  'http://x')\nLET b; x.eval(1); eval(2)\n/eval(3)/.test(x)\n'eval(4)'"
    got = content.content_findings(spark.createDataFrame([("a.js", text), ("b.js", None), ("c.js", "")], "path string, text string"), rules).collect()
    assert sorted((r.rule, r.line, r.offset, r.nth) for r in got) == [("FETCH", 2, 6, 1), ("START", 1, 0, 1), ("START", 4, text.index("LET"), 1), ("code-eval", 4, text.index("eval(2)"), 1)]
    assert {r.snippet for r in got if r.rule == "FETCH"} == {"let a\nfetch(\n  'http://x')"}


@pytest.fixture
def files(spark):
    rows = [(1, "a.js", "ev​al(x)", "d1"), (1, "b.d.ts", "eval(y)\nLICENSE", "d1"), (2, ".env", "LICENSE", "good"), (3, "c.js", None, "d3"), (4, "d.js", "eval(z)", "good")]
    return spark.createDataFrame(rows, "scan_id long, path string, text string, digest string")


PACKS = "pack string, id string, phase string, severity string, pattern string"


def test_flow(spark, files):
    packs = spark.createDataFrame([("calls", "EVAL", "code_patterns", "HIGH", r"eval\("), ("chain", "LIC", "obfuscation", "LOW", "LICENSE"), ("chain", "NEVER", "code_patterns", "LOW", "never")], PACKS)
    hidden = [{"id": "DOT", "severity": "LOW", "kind": "hidden_file"}]
    got = sorted(map(tuple, flow.scan(files, packs, metadata_rules=hidden).select("scan_id", "path", "rule", "phase").collect()))
    assert got == [
        (1, "a.js", "EVAL", "code_patterns"), (1, "a.js", "UNICODE-3", "obfuscation"), (1, "b.d.ts", "LIC", "obfuscation"), (2, ".env", "DOT", "provenance"),
        (2, ".env", "LIC", "code_patterns"), (2, ".env", "LIC", "obfuscation"), (4, "d.js", "EVAL", "code_patterns"),
    ]
    only = flow.scan(files, packs, metadata_rules=hidden, phases=["obfuscation"])
    assert sorted((r.scan_id, r.rule) for r in only.collect()) == [(1, "LIC"), (1, "UNICODE-3"), (2, "LIC")]
    users = spark.createDataFrame([("code_patterns", "EVAL", r"^a\.", None, True), ("obfuscation", "LIC", None, None, False)], "pattern_type string, rule string, file_pattern string, evidence_pattern string, suppress boolean")
    kept = flow.scan(files, packs, user_rules=users, approved=spark.createDataFrame([("good",)], "digest string"), veto_rule="EVAL", least_severity="LOW")
    assert sorted((r.scan_id, r.rule) for r in kept.collect()) == [(1, "LIC"), (1, "UNICODE-3"), (4, "EVAL")]
    scored = {r.scan_id: (r.score, r.verdict, r.findings) for r in flow.verdicts(kept, files).collect()}
    assert set(scored) == {1, 2, 3, 4} and scored[3] == (0, "LOW_RISK", 0) and scored[4][2] == 1


def test_tree_with_ignore_files(spark, tmp_path):
    from vigilake.sources import trees

    files = {
        "a.py": "x", ".env": "KEY=1", ".gitignore": "*.log\n!keep.log\nbuilt/\n/top.txt\n", "run.log": "", "keep.log": "k", "built/x.py": "", "built/deep/keep.log": "", "top.txt": "", "sub/top.txt": "t",
        "sub/.gitignore": "!run.log\nsecret*\n", "sub/run.log": "r", "sub/secret.txt": "", "sub/in/.gitignore": "!secret.txt\n**/gone\n", "sub/in/secret.txt": "s", "sub/in/a/gone": "", "node_modules/m/x.js": "",
        ".git/config": "", "bin": "a\0b", ".scanignore": "sub/in/a/\n", "sub/in/a/b.txt": "", "x y/é.txt": "é",
    }
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    ignoring = {".gitignore", "sub/.gitignore", "sub/in/.gitignore", ".scanignore"}
    got = {r.path: (r.length, r.text) for r in trees.tree(spark, str(tmp_path)).collect()}
    assert set(got) - ignoring == {"a.py", ".env", "keep.log", "sub/top.txt", "sub/run.log", "sub/in/secret.txt", "x y/é.txt"}
    assert got["x y/é.txt"] == (2, "é") and got[".env"] == (5, "KEY=1")
    (tmp_path / ".git").rename(tmp_path / "not-git")
    open_tree = {r.path for r in trees.tree(spark, str(tmp_path)).collect()}
    assert {"run.log", "built/x.py", "top.txt", "sub/secret.txt", "sub/in/a/gone"} - open_tree == {"sub/in/a/gone"} and "sub/in/a/b.txt" not in open_tree
    spark.dataSource.register(trees.Tree)
    few = spark.read.format("tree").options(path=str(tmp_path), folders=2, contents="false").load()
    many = spark.read.format("tree").options(path=str(tmp_path), folders=1000).load()
    assert sorted(r.path for r in few.collect()) == sorted(r.path for r in many.collect()) and few.where("content is not null").count() == 0
    assert spark.read.format("tree").options(path=str(tmp_path / "none")).load().count() == 0


def test_chains_of_copies(spark):
    from vigilake.operators import dataflow

    text = "a = input()\nb = a\nc = g(b, 1)\na = 3\neval(c); eval(a)\nconst d = b;\nos.system(d)\nz == input()\nb = 2\neval(b)\nif x: eval(q)"
    rows = [("f", text), ("clean", text + "\nescape(x)"), ("none", None), ("late", "eval(a)\na = input()"), ("self", "a = input()\na = a + 1\neval(a)")]
    got = dataflow.flows(spark.createDataFrame(rows, "path string, text string"), ["input()"], ["eval(", "os.system("], ["escape("])
    want = [("eval(", 1, 5, 2), ("os.system(", 1, 7, 2)]
    assert sorted(tuple(r) for r in got.collect()) == sorted([(p, "input()", s, f, last, h, p == "clean") for p in ("f", "clean") for s, f, last, h in want] + [("self", "input()", "eval(", 1, 3, 1, False)])


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_similar_sets_are_those_of_brute_force(spark, least):
    import random

    from vigilake.operators import setjoin

    rng = random.Random(9)
    sets = [(i, list({rng.randint(0, 30) for _ in range(rng.randint(1, 7))} | ({99} if i % 3 == 0 else set())) + [1] * (i % 5 == 0)) for i in range(250)] + [(900, []), (901, None)]
    frame = spark.createDataFrame(sets, "id int, items array<int>")
    own = [(i, set(s)) for i, s in sets if s]
    pairs = [(i, j, len(s & t), len(s), len(t)) for k, (i, s) in enumerate(own) for j, t in own[k + 1 :]]
    for most in (4096, 7):
        jaccard = {(r.a, r.b): r.jaccard for r in setjoin.by_jaccard(frame, least, most).collect()}
        assert jaccard == {(i, j): s / (n + m - s) for i, j, s, n, m in pairs if s / (n + m - s) >= least}
        larger = setjoin.by_larger(frame, least, most).collect()
        assert len(larger) == len({(r.a, r.b) for r in larger}) and {(r.a, r.b): r.share for r in larger} == {(i, j): s / max(n, m) for i, j, s, n, m in pairs if s / max(n, m) >= least}


def test_few_pairs_meet_at_a_frequent_item(spark):
    """Large sets that share nothing but one item of all sets never meet there."""
    from pyspark.sql import functions as F

    from vigilake.operators import setjoin

    sets = spark.range(3000).select("id", F.array_append(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.col("id") * 10 + k), F.lit(-1).cast("long")).alias("items"))
    assert setjoin.prefixes(sets, 0.5).where("item = -1").count() == 0 and setjoin.by_jaccard(sets, 0.5).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_similar_sets_of_few_and_of_many_items(spark, least):
    """Sizes on both sides of the one up to which sets meet at combinations, also within a pair."""
    import random

    from vigilake.operators import setjoin

    rng, sets = random.Random(4), []
    for k in range(40):
        whole = rng.sample(range(60), rng.randint(1, 40))
        sets += [(f"s{k}-{j}", [f"i{x}" for x in whole if rng.random() > 0.1 * j] + [None] * (j % 2)) for j in range(4)]
    frame, own = spark.createDataFrame(sets, "id string, items array<string>"), [(i, set(s) - {None}) for i, s in sets]
    pairs = [(*sorted((i, j)), len(s & t), len(s), len(t)) for k, (i, s) in enumerate(own) for j, t in own[k + 1 :] if s and t]
    for most in (4096, 5):
        jaccard = setjoin.by_jaccard(frame, least, most).collect()
        assert sorted((r.a, r.b, r.jaccard) for r in jaccard) == sorted((i, j, s / (n + m - s)) for i, j, s, n, m in pairs if s / (n + m - s) >= least)
        larger = setjoin.by_larger(frame, least, most).collect()
        assert sorted((r.a, r.b, r.share) for r in larger) == sorted((i, j, s / max(n, m)) for i, j, s, n, m in pairs if s / max(n, m) >= least)


@pytest.mark.parametrize("by", ["by_larger", "by_jaccard"])
def test_sets_of_few_items_out_of_few_meet_seldom(spark, monkeypatch, by):
    """Five of 100 items: a single item is in a twentieth of all sets, three of them in hardly any."""
    from pyspark.sql import functions as F

    from vigilake.operators import setjoin

    met, told = setjoin._met, []
    monkeypatch.setattr(setjoin, "_met", lambda heads, key, *more: told.append(heads.groupBy(key).agg(F.count("*").alias("n"))) or met(heads, key, *more))
    sets = spark.range(4000).select("id", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.pmod(F.xxhash64("id", j), F.lit(100))).alias("items"))
    assert getattr(setjoin, by)(sets, 0.6).count() > 0 and len(told) == 1
    assert told[0].agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] < 4000 * 40


def test_percentiles_of_large_and_odd_groups(spark):
    from pyspark.sql import functions as F

    from vigilake.operators import scoring

    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") < 5, None).otherwise("cold").alias("g"), F.when(F.col("id") % 50 > 0, F.floor(F.col("id") * 7919 % 4001 / 10)).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("one", 5)], "g string, v long")).repartition(7)
    shares = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    held = {}
    for r in rows.collect():
        held.setdefault(r.g, []).append(r.v)
    want = {g: tuple(sorted(v, key=lambda x: (x is not None, x or 0))[min(int(len(v) * p), len(v) - 1)] for p in shares.values()) for g, v in held.items()}
    assert {r.g: (r.p0, r.p50, r.p90, r.p100) for r in scoring.sorted_percentiles(rows, "g", "v", shares).collect()} == want
    assert scoring.sorted_percentiles(rows.limit(0), "g", "v", shares).count() == 0
