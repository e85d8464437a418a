import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vigilake.functions import names as N
from vigilake.functions import severity as S
from vigilake.operators import matching, reconcile, registry, rulescan, scanning, scoring
from vigilake.sources import files, lockfiles, reports

FINDING = "scan_id long, file string, rule string, line int, severity string, phase string, weight int"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("score, verdict", [(0, "LOW_RISK"), (9, "LOW_RISK"), (10, "MEDIUM_RISK"), (24, "MEDIUM_RISK"), (25, "HIGH_RISK"), (49, "HIGH_RISK"), (50, "CRITICAL_RISK")])
def test_verdict_bounds(spark, score, verdict):
    assert one(spark, S.verdict(F.col("s")), s=score) == verdict


def test_only_a_critical_finding_makes_a_scan_critical(spark):
    rows = [(1, "a.js", "R", 1, "LOW", "code_patterns", 100), (2, "a.js", "R", 1, "CRITICAL", "code_patterns", 1), (3, "a.js", "R", None, "MEDIUM", "code_patterns", 5)]
    got = {r.scan_id: (r.score, r.verdict) for r in scoring.scan_scores(spark.createDataFrame(rows, FINDING)).collect()}
    assert got == {1: (100, "HIGH_RISK"), 2: (5, "CRITICAL_RISK"), 3: (10, "MEDIUM_RISK")}


@pytest.mark.parametrize("path, weight", [("node_modules/readme.md", 0.1), ("tests/readme.txt", 0.2), ("tests/a.py", 0.3), ("src/a.py", 1.0), ("SPEC/x.JS", 0.3)])
def test_context_weight(spark, path, weight):
    assert one(spark, S.context_weight(F.col("p")), p=path) == weight


@pytest.mark.parametrize(
    "vector, score",
    [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.0/AV:L/AC:H/PR:L/UI:R/S:U/C:L/I:N/A:N", 2.2), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.1/AV:N/AC:L", None), ("CVSS:2/AV:N", None), ("x", None)],
)
def test_cvss(spark, vector, score):
    assert one(spark, S.cvss3(F.col("v")), v=vector) == score


@pytest.mark.parametrize("name, target, alike", [("requests", "requests", False), ("requets", "requests", True), ("reqvests2", "requests", True), ("flask", "requests", False), ("numpy_", "numpy", True), ("l0dash", "lodash", True)])
def test_lookalikes(spark, name, target, alike):
    assert one(spark, N.is_lookalike(F.col("n"), F.col("t")), n=name, t=target) == alike


def test_snippet_cuts_between_characters(spark):
    text = "é" * 150
    got = one(spark, N.snippet(F.col("t")), t="  " + text + " ")
    assert got == "é" * 100 + " ..." and one(spark, N.snippet(F.col("t")), t="  short ") == "short"


@pytest.mark.parametrize(
    "command, decision",
    [("vigilake pip requests", "allow"), ("cd x; vigilake npm y", "allow"), ("npm install --save-dev", "ask"), ("npm install -D jest", "deny"), ("echo hi", "allow"), ("git -C d clone u", "deny"), ("a;npm i b", "deny"), ("npm --prefix d ci", "ask"), ("sh -c 'pip install q'", "deny"), ("pip install -r r.txt", "ask"), ("pip install for-r", "deny"), ("VIGILAKE_BYPASS=1 pip install q", "allow")],
)
def test_commands_follow_their_order(spark, command, decision):
    assert one(spark, scanning.command_decision(F.col("c")), c=command) == decision


@pytest.mark.parametrize("path, steers", [("CLAUDE.md", True), ("x/Gemini.md", True), ("team.windsurfrules", True), (".cursor/rules/a", True), (".github/instructions/b.md", True), ("readme.md", False), ("skills/a.md", False), ("prompt.md", False)])
def test_instruction_files(spark, path, steers):
    assert one(spark, N.is_instruction_file(F.col("p")), p=path) == steers


@pytest.mark.parametrize("text, left", [("a" + chr(0x180E) + chr(0x200D) + "b", "a" + chr(0x200D) + "b"), ("a" + chr(0x200C) + "b" + chr(0x200F), "ab"), (chr(0xFEFF) + "x", "x"), (chr(0xE000) + "y", chr(0xE000) + "y")])
def test_decloaked_looks_at_the_text_as_it_was(spark, text, left):
    assert one(spark, N.decloaked(F.col("t")), t=text) == left


def test_lines_and_nearby(spark):
    rows = scanning.lines_of(spark.createDataFrame([("a", "1\r\n2\n\n4\n"), ("b", ""), ("c", "x")], "path string, text string")).collect()
    assert [(r.path, r.line, r.body) for r in rows] == [("a", 1, "1"), ("a", 2, "2"), ("a", 3, ""), ("a", 4, "4"), ("c", 1, "x")]
    assert rows[0].nearby == "1\n2\n\n4" and rows[2].nearby == "\n4"


def test_rules_fire_and_must_not(spark):
    rule = {"id": "X", "phase": "code_patterns", "severity": "HIGH", "pattern": r"\beval\(", "weight": 5, "description": "eval", "file_filter": {"filename_exact": ["Makefile"], "extensions": [".js"]}, "suppress": {"path_contains": ["vendor/"], "line_contains": ["// ok"], "nearby_contains": ["SAFE"], "file_header_contains": ["generated"]}}
    body = "eval(x)\n"
    cases = {"a.js": (body, 1), "Makefile": (body, 1), "a.py": (body, 0), "vendor/a.js": (body, 0), "b.js": ("eval(x) // ok\n", 0), "c.js": (body + "\n\nSAFE", 0), "d.js": (body + "\n\n\nSAFE", 1), "e.js": ("generated\n" + body, 0), "f.js": ("medieval(x)", 0), "g.js": ("eval(a) eval(b)", 1)}
    found = scanning.scan_lines(spark.createDataFrame([(p, t) for p, (t, _) in cases.items()], "path string, text string"), [rule]).collect()
    assert sorted(r.path for r in found) == sorted(p for p, (_, n) in cases.items() if n)
    assert {r.snippet for r in found if r.path == "a.js"} == {"eval: eval(x)"}
    joined = rulescan.scan_rules(spark.createDataFrame([("a", body)], "path string, text string"), spark.createDataFrame([("X", "p", "LOW", "eval")], "id string, phase string, severity string, pattern string"))
    assert [(r.path, r.line, r.rule) for r in joined.collect()] == [("a", 1, "X")]


def test_hidden_characters(spark):
    rows = [("skills/SKILL.md", "a\nb" + chr(0x202E)), ("x.js", "a" + chr(0x200D) + "b\n" + chr(0xE001)), ("cjk.md", "日本" + chr(0x1F469) + chr(0x200D) + chr(0x1F4BB))]
    got = {(r.path, r.rule, r.severity, r.weight, r.line) for r in scanning.hidden_characters(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("skills/SKILL.md", "UNICODE-2", "HIGH", 5, 2), ("x.js", "UNICODE-3", "MEDIUM", 2, 1), ("x.js", "UNICODE-1", "MEDIUM", 2, 2)}


def test_diff_keeps_repeats_and_null_lines(spark):
    schema = "file string, rule string, line int"
    old, new = spark.createDataFrame([("a", "R", None), ("b", "R", 1), ("b", "R", 1)], schema), spark.createDataFrame([("a", "R", None), ("c", "R", 2), ("c", "R", 2)], schema)
    got = sorted((r.file, r.change) for r in reconcile.scan_diff(old, new).collect())
    assert got == [("a", "unchanged"), ("b", "resolved"), ("b", "resolved"), ("c", "new"), ("c", "new")]


def test_version_compare_takes_the_last(spark):
    schema = "file string, rule string, line int, severity string, n int"
    old = spark.createDataFrame([("a", "R", 1, "LOW", 1), ("a", "R", 1, "HIGH", 2), ("b", "R", None, "LOW", 3)], schema)
    new = spark.createDataFrame([("a", "R", 1, "LOW", 1), ("b", "R", None, "LOW", 2), ("c", "R", 1, "LOW", 3)], schema)
    got = {(r.file, r.change) for r in reconcile.version_compare(old, new, "n").collect()}
    assert got == {("a", "severity_changed"), ("c", "added")}


def test_digest_layout(spark):
    rows = [("x", "b", "2"), ("x", "a", "1")]
    got = reconcile.content_digests(spark.createDataFrame(rows, "artifact string, path string, hash string")).first()
    assert got.digest == hashlib.sha256(b"a\x001\nb\x002\n").hexdigest() and got.files == 2


def test_upsert_and_merge(spark):
    t = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, n int")
    u = spark.createDataFrame([("a", 5, 2), ("a", 6, 3), ("c", 7, 1)], "k string, v int, n int")
    assert sorted(map(tuple, registry.upsert(t, u, ["k"], "n").select("k", "v", "n").collect())) == [("a", 6, 3), ("b", 2, 1), ("c", 7, 1)]
    assert sorted(map(tuple, registry.merge_add(t, u, ["k"], ["v"]).collect())) == [("a", 12), ("b", 2), ("c", 7)]


def test_best_matches_take_each_pair_once(spark):
    rows = [(1, 90.0, "Search", "npm", ["A", "B"], ["HTTP"], []), (2, 50.0, "Database", "npm", ["A"], ["HTTP", "REST"], None), (3, 70.0, "Database", "mcps", None, [], ["reads_files"])]
    tools = spark.createDataFrame(rows, "tool_id long, trust double, category string, ecosystem string, variables array<string>, protocols array<string>, capabilities array<string>")
    got = [tuple(r) for r in matching.best_matches(tools, matching.PROTOCOL_FITS, matching.CAPABILITY_FITS, matching.CATEGORY_FITS).where("a = 1").orderBy("rank").collect()]
    assert got == [(1, 2, 56.0, 1), (1, 3, 48.0, 2)]


# --- sources


def test_requirements(spark):
    text = "# c\nrequests==2.0 # why\nflask>=1\n-r other\n\nnumpy[x]==1.1; python_version>'3'\nuv ~= 2\n"
    got = [(r.name, r.version) for r in lockfiles.requirements(spark.createDataFrame([("r", text)], "path string, text string")).collect()]
    assert got == [("requests", "2.0"), ("flask", None), ("numpy", "1.1"), ("uv", None)]


def test_package_lock(spark):
    v3 = json.dumps({"packages": {"": {"version": "0"}, "node_modules/a": {"version": "1"}, "node_modules/a/node_modules/@s/b": {"version": "2"}}})
    v1 = json.dumps({"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2", "dependencies": {"c": {"version": "3"}}}}}, "d": {"version": "4"}}})
    got = {tuple(r) for r in lockfiles.package_lock(spark.createDataFrame([("v3", v3), ("v1", v1)], "path string, text string")).collect()}
    assert got == {("v3", "a", "1"), ("v3", "@s/b", "2"), ("v1", "a", "1"), ("v1", "b", "2"), ("v1", "c", "3"), ("v1", "d", "4")}


def test_cargo_and_go(spark):
    cargo = 'version = 3\n\n[[package]]\nname = "a"\nversion = "1.0"\nchecksum = "x"\n\n[[package]]\nname = "b"\nversion = "2"\n'
    assert [tuple(r)[1:] for r in lockfiles.cargo_lock(spark.createDataFrame([("c", cargo)], "path string, text string")).collect()] == [("a", "1.0", "x"), ("b", "2", None)]
    go = "module m\nrequire h/a v1.0.0 // indirect\nrequire (\n\th/b v2.0.0\n\t// h/c v3\n\th/d v4.0.0 // x\n)\n"
    assert sorted(tuple(r)[1:] for r in lockfiles.go_mod(spark.createDataFrame([("g", go)], "path string, text string")).collect()) == [("h/a", "v1.0.0"), ("h/b", "v2.0.0"), ("h/d", "v4.0.0")]


def test_source_tree(spark, tmp_path):
    for name, body in {"a.py": b"x = 1\n", "node_modules/b.js": b"y", ".hidden": b"z", "bin.dat": b"a\x00b", "sub/c.txt": b"caf\xe9"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    got = {r.path: r.text for r in files.source_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x = 1\n", ".hidden": "z", "sub/c.txt": "caf�"} or got == {"a.py": "x = 1\n", "sub/c.txt": "caf�"}


def test_packs_signatures_and_feeds(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"meta": {"id": "m", "version": "1"}, "rules": [{"id": "R", "phase": "credentials", "severity": "LOW", "pattern": "x"}]}, indent=1))
    (tmp_path / "bad.json").write_text("{nope")
    assert [(r.pack, r.id, r.pattern) for r in files.rule_pack(spark, str(tmp_path)).collect()] == [("m", "R", "x")]
    (tmp_path / "s1").write_text('{"signatures": [{"id": "A", "pattern": "p"}]}')
    (tmp_path / "s2").write_text('[{"id": "B", "pattern": "q", "severity": "HIGH", "phase": "credentials"}]')
    got = {(r.id, r.severity, r.phase) for n in ("s1", "s2") for r in files.signatures(spark, str(tmp_path / n)).collect()}
    assert got == {("A", "LOW", "code_patterns"), ("B", "HIGH", "credentials")}
    (tmp_path / "e").write_text(json.dumps({"data": [{"cve": "CVE-1", "epss": "0.5"}, {"cve": "CVE-2", "epss": "x"}]}))
    assert [(r.cve, r.epss) for r in files.epss(spark, str(tmp_path / "e")).collect()] == [("CVE-1", 0.5)]
    (tmp_path / "k").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1"}, {"cveID": "CVE-1"}]}))
    assert [r.cve for r in files.kev(spark, str(tmp_path / "k")).collect()] == ["CVE-1"]


def test_reports(spark):
    f = spark.createDataFrame([(1, "b.js", "R2", 3, "LOW", "s2"), (1, "a.js", "R1", None, "CRITICAL", "s1"), (1, "c.js", "R1", 1, "HIGH", "s3")], "scan_id long, file string, rule string, line int, severity string, snippet string")
    run = json.loads(reports.sarif(f).first().report)["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["R1", "R2"] and [r["level"] for r in run["results"]] == ["error", "note", "error"]
    c = spark.createDataFrame([("p", "pip", "b", "1"), ("p", "npm", "a", None)], "path string, package_type string, name string, version string")
    bom = json.loads(reports.cyclonedx(c).first().report)
    assert [x["purl"] for x in bom["components"]] == ["pkg:npm/a", "pkg:pypi/b@1"]
    s = spark.createDataFrame([(k, "npm", "p", "1", "LOW_RISK") for k in range(5)], "scan_id long, ecosystem string, package string, version string, verdict string").withColumn("scanned_at", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    assert [i["id"] for i in json.loads(reports.feed(s, 3).first().feed)["items"]] == ["4", "3", "2"]
    assert one(spark, reports.badge_colour(F.col("v")), v="LOW_RISK") == "#4c1"


# --- contents


def test_content_findings_of_null_and_empty_files(spark):
    from vigilake.operators import content

    rules = [{"id": "code-eval", "phase": "code_patterns", "severity": "HIGH", "pattern": r"\beval\("}, {"id": "novel-version-hijack", "phase": "obfuscation", "severity": "LOW", "pattern": "hijack"}]
    rows = [("a.js", None), ("b.js", ""), ("c.js", "x\r\neval(1)\n// eval(2)"), ("d.js", "hijack"), ("e.js", "hijack\n||"), ("f.js", "s = 'it' + eval(z) + `${eval(q)}`")]
    got = sorted((r.path, r.line, r.rule, r.snippet) for r in content.content_findings(spark.createDataFrame(rows, "path string, text string"), rules).collect())
    assert got == [("c.js", 2, "code-eval", "x\neval(1)\n// eval(2)"), ("e.js", 1, "novel-version-hijack", "hijack\n||"), ("f.js", 1, "code-eval", "s = 'it' + eval(z) + `${eval(q)}`")]
    assert content.prompt_findings(spark.createDataFrame([(1, None), (2, "")], "prompt_id long, text string"), [{"id": "p", "severity": "CRITICAL", "pattern": "x", "weight": 1}]).count() == 0


def test_rules_that_are_data_are_of_any_number(spark):
    """Rules beyond a block are one more pass, with the same findings."""
    rules = spark.createDataFrame([(f"R{k}", "p", "LOW", "x" if k % 2 else f"word{k}") for k in range(40)], "id string, phase string, severity string, pattern string")
    files_ = spark.createDataFrame([("a", "x"), ("b", "a word4 and word40")], "path string, text string")
    want = {("a", f"R{k}") for k in range(1, 40, 2)} | {("b", "R4")}
    for block in (3, 40, 1000):
        assert {(r.path, r.rule) for r in rulescan.scan_rules(files_, rules, block=block).collect()} == want


def test_verification_without_hash_or_publisher(spark):
    requests = spark.createDataFrame([(1, "h", "p"), (2, None, None), (3, "x", "q")], "id long, artifact_hash string, publisher_id string")
    threats = spark.createDataFrame([("h",), ("h",)], "hash string")
    publishers = spark.createDataFrame([("p", 2, None), ("q", None, 10.0)], "publisher_id string, flagged int, trust double")
    assert sorted((r.id, r.score, r.verdict) for r in reconcile.verification(requests, threats, publishers).collect()) == [(1, 60.0, "CRITICAL_RISK"), (2, 0.0, "LOW_RISK"), (3, 10.0, "MEDIUM_RISK")]
