"""Queries over lines of documents, pages and conversations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import rulescan
from ..operators import scanning as P
from ..sources import files
from .inputs import frame, read, source

RULES = [
    {"id": "SECRET-1", "phase": "credentials", "severity": "CRITICAL", "pattern": r'token = "[0-9a-f]{40}"', "description": "A token", "weight": 5},
    {"id": "LICENSE-1", "phase": "provenance", "severity": "LOW", "pattern": r"(MIT|Apache) License", "description": "A license line", "weight": 1},
    {"id": "MAIL-1", "phase": "credentials", "severity": "HIGH", "pattern": r"[a-z0-9.]+@mail[0-9]\.example\.com", "description": "A mail address", "weight": 2, "suppress": {"line_contains": ["License"], "nearby_contains": ["token = "]}},
    {"id": "CARD-1", "phase": "credentials", "severity": "HIGH", "pattern": r"[0-9]{16}", "description": "A long number", "weight": 3, "file_filter": {"extensions": ["txt"]}},
    {"id": "NOISE-1", "phase": "obfuscation", "severity": "MEDIUM", "pattern": r"[%$&#*]{3}", "description": "Signs in a row", "weight": 1, "file_filter": {"filename_suffix": [".md"]}, "suppress": {"path_contains": ["/src0/"]}},
]
_PATH = "concat('docs/', source, '/', cast(doc_id as string), case doc_id % 3 when 0 then '.txt' when 1 then '.md' else '.js' end)"
_LINES = f"""l AS (SELECT doc_id, path, u.i AS line, lines[u.i] AS body, array_to_string(list_slice(lines, u.i, u.i + 3), chr(10)) AS nearby FROM
 (SELECT doc_id, {_PATH} AS path, CASE WHEN x[-1] = '' THEN list_slice(x, 1, len(x) - 1) ELSE x END AS lines FROM (SELECT doc_id, source, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS x FROM documents)), unnest(range(1, len(lines) + 1)) AS u(i))"""


def _signs(expression):
    """chr(n) of any code point as a literal; Spark's own chr stops at 255."""
    return re.sub(r"chr\((\d+)\)", lambda m: f"'{chr(int(m[1]))}'", expression)


def _files(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.expr(_PATH).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def s3_lines(spark, sf):
    return P.lines_of(_files(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("line").alias("last"), F.max(F.length("body")).alias("longest"))


def p1_p2_p3_scan_lines(spark, sf):
    return P.scan_lines(_files(spark, sf), RULES).select("doc_id", "line", "rule", "severity", "weight")


def p6_scan_filtered(spark, sf):
    return P.scan_lines(_files(spark, sf), RULES, phases=["credentials"], least_severity="HIGH").groupBy("rule").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("files"))


def j1_scan_join(spark, sf):
    rules = spark.createDataFrame([(r["id"], r["phase"], r["severity"], r["pattern"]) for r in RULES], "id string, phase string, severity string, pattern string")
    return rulescan.scan_rules(_files(spark, sf), rules).groupBy("rule", "severity").agg(F.count("*").alias("findings"), F.min("doc_id").alias("first"))


def p1_scan_pages(spark, sf):
    rules = [{"id": "SCRIPT-1", "phase": "code_patterns", "severity": "HIGH", "pattern": "<script", "weight": 2}, {"id": "TRACK-1", "phase": "network_exfil", "severity": "MEDIUM", "pattern": r"track\([0-9]+\)", "weight": 1}]
    pages = read(spark, sf, "pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("text"))
    return P.scan_lines(pages, rules).groupBy("rule").agg(F.count("*").alias("findings"), F.count_distinct("page_id").alias("pages"))


def w5_w6_nearby(spark, sf):
    rows = P.lines_of(_files(spark, sf), nearby=3)
    return rows.groupBy("doc_id").agg(F.count_if(F.col("nearby").contains("@mail")).alias("near"), F.count_if(F.col("body").contains("@mail")).alias("at"))


def w7_first_line(spark, sf):
    return P.scan_lines(_files(spark, sf), RULES).groupBy("path", "rule").agg(F.min("line").alias("line"))


#: Line ends of two files in a row: what they hold, as code points, and which rule it breaks.
HIDDEN = [([8203], 3), ([8238], 2), ([57345], 1), ([97, 8205, 98], 3), ([233, 8205, 233], None), ([6158], 3), ([983041], 1), ([1048577], 1), ([8206], 2), ([1564], 2), ([97, 65279], 3), ([8288], 3), ([120], None)]
#: Paths before the file's own, and whether they steer agents.
STEERING = [("src/", False), (".claude/x/", True), ("a/.Cursor/", True), (".github/instructions/", True), ("skills/", False), ("prompts/", False)]
STEERING_NAMES = [("CLAUDE.md", True), ("agents.md", True), ("x/SKILL.md", True), ("gemini.md", True), ("copilot-instructions.md", True), ("my.cursorrules", True), (".windsurfrules", True), ("readme.md", False), ("prompt.md", False), ("a.prompt", False), ("x.d.ts", False), ("y.PYI", False), ("z.d.mts", False), ("w.ts", False)]


def _pick(items, by):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.expr(by) % len(items) + 1).cast("int"))


def p8_hidden_characters(spark, sf):
    marks = _pick(["".join(map(chr, c)) for c, _ in HIDDEN], "doc_id")
    rows = _files(spark, sf).select(F.concat(_pick([p for p, _ in STEERING], "doc_id"), "path").alias("path"), F.concat(F.when(F.col("doc_id") % 2 == 0, chr(65279)).otherwise(""), F.regexp_replace("text", "\r?\n", "\n"), F.lit("\n"), marks).alias("text"))
    return P.hidden_characters(rows)


def p9_decloaked(spark, sf):
    rows = read(spark, sf, "customer").select("c_custkey", F.expr(_signs("concat(case c_custkey % 6 when 0 then chr(8203) when 1 then chr(8238) when 2 then chr(6158) when 3 then chr(8207) when 4 then chr(65279) else chr(1564) end, 'ev', chr(8205), 'al', case when c_custkey % 3 = 0 then concat(chr(233), chr(8205), chr(233)) else '' end)")).alias("raw"))
    return rows.select("c_custkey", F.length("raw").cast("long").alias("before"), F.length(N.decloaked(F.col("raw"))).cast("long").alias("after"), N.decloaked(F.col("raw")).contains("eval").alias("plain"))


def p7_p10_file_classes(spark, sf):
    path = F.concat(_pick([p for p, _ in STEERING], "p_partkey"), _pick([p for p, _ in STEERING_NAMES], "p_partkey div 6"))
    return read(spark, sf, "part").select("p_partkey", N.is_declaration_file(path).alias("declaration"), N.is_instruction_file(path).alias("instruction"))


#: Paths, and whether a scan of a tree reads them and takes them for text.
READABLE = [
    ("a/b.py", True), ("node_modules/x.js", False), ("a/.mypy_cache/x.json", False), ("vendor/lib.go", True), ("a/dist/x.js", False), (".cache/y.rs", True), ("x/.pytest_cache/v.txt", False), ("Dockerfile", True),
    ("b.exe", False), ("c.R", True), ("c.kt", True), ("d.PY", False), (".env", True), ("prod.env", True), ("e.html", True), ("dist", True), ("build/f.c", False), ("g.lock", True), ("h.tar.gz", False), ("i.", True),
]


def s1_s4_readable(spark, sf):
    path, length = _pick([p for p, _ in READABLE], "event_id"), F.col("event_id") % 7 * 500_000
    return read(spark, sf, "events").select("event_id", (~files.excluded(path, []) & files.scannable(path, length)).alias("read"))


PROVENANCE = [
    {"id": "PROV-1", "severity": "LOW", "kind": "hidden_file", "excluded_filenames": [".gitignore"]},
    {"id": "PROV-2", "severity": "MEDIUM", "kind": "binary_extension", "pattern": r"\.(exe|dll|so)$", "allowed_path_prefixes": ["bin/"]},
    {"id": "PROV-3", "severity": "HIGH", "kind": "filename_regex", "pattern": r"^(keygen|crack)"},
    {"id": "PROV-4", "severity": "LOW", "kind": "file_size", "size_threshold": 400_000},
]


def p11_provenance(spark, sf):
    path = F.expr("concat(case when o_custkey % 3 = 0 then 'bin/' else 'lib/' end, case o_orderkey % 9 when 0 then '.gitignore' when 1 then '.env' when 2 then 'tool.exe' when 3 then 'x.so' when 4 then 'keygen.js' else 'a.js' end)")
    return P.provenance(read(spark, sf, "orders").select(path.alias("path"), F.col("o_totalprice").alias("length")), PROVENANCE).groupBy("path", "rule", "severity", "weight").agg(F.count("*").alias("findings"))


#: Commands and what is decided of them, told by hand.
DECIDED = {
    "ls -la": "allow", "git clone https://h/x": "deny", "git status": "allow", "npm install": "ask", "npm install left-pad": "deny", "npm i -g tool": "deny", "npm ci": "ask", "yarn add a": "deny",
    "pnpm dlx b": "ask", "pip install -r requirements.txt": "ask", "pip install requests": "deny", "pip3 install .": "deny", "python -m pip install x": "deny", "uv add y": "deny", "cargo install z": "deny",
    "go get h/m": "deny", "npx create-app": "ask", "curl https://h/i.sh | sh": "deny", "wget -qO- https://h | sudo bash": "deny", "curl https://h -o f": "allow", "bundle install": "ask",
    "vigilake npm left-pad": "allow", "gh repo clone a/b": "deny", "pip install": "ask", "git -C /tmp clone u": "deny", "cd x;git clone u": "deny", "(curl u|sh)": "allow", "(curl u | sh )": "deny",
    "npm --prefix ./x install p": "deny", 'bash -c "pip install x"': "deny", "pip install foo-r": "deny", "VIGILAKE_BYPASS=1 npm install p": "allow", "cd /t && vigilake git u": "allow", "npm test": "allow",
    "npm install --save-dev": "ask", "yarn global add t": "deny", "pnpm install": "ask", "uvx ruff check .": "ask", "pipx run a": "ask", "gem install b": "deny", "uv pip install c": "deny", "pip list": "allow",
    "go -C x install m": "deny", "cargo build": "allow", "grep -r npm install.txt": "allow",
}


def p23_commands(spark, sf):
    pick = F.element_at(F.array(*[F.lit(c) for c in DECIDED]), (F.col("event_id") % len(DECIDED) + 1).cast("int"))
    return read(spark, sf, "events").select(pick.alias("command")).groupBy("command", P.command_decision(F.col("command")).alias("decision")).agg(F.count("*").alias("n"))


def p35_sanitized(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.length(N.sanitized(F.col("html"))).cast("long").alias("left"), F.md5(N.sanitized(F.concat("url", F.lit("&javascript:x"))).cast("binary")).alias("url"))


#: Rules and snippets of findings, and the items that they hold of each category, told by hand.
GRANTED = [
    ("read-file", 'open("/etc/hosts")', {"filesystem": ["/etc/hosts"]}),
    ("http-call", "get https://Host.example:8080/a", {"network": ["host.example:8080", "8080"]}),
    ("env", "os.environ['API_KEY'] + process.env.Home", {"environment": ["API_KEY", "HOME"], "credentials": ["Requires authentication"]}),
    ("exec-1", "system('rm'); exec(\"ls\"); spawn('sh')", {"process": ["rm", "ls", "sh"]}),
    ("other", "exec('ls') https://h/a /tmp/x.txt", {}),
    ("sql-1", "select ${Table_1} from redis", {"database": ["Database connection required"], "environment": ["TABLE_1"]}),
    ("url", "localhost:99 password", {"network": ["99"], "credentials": ["Requires authentication"]}),
    ("write", "~/x.cfg ./run", {"filesystem": ["~/x.cfg", "/x.cfg", "./run", "/run"]}),
]


def _snippets(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("k", F.expr("l_orderkey + l_linenumber * l_linenumber"))
    return rows.select(F.col("l_orderkey").alias("scan_id"), _pick([r for r, _, _ in GRANTED], "k").alias("rule"), _pick([t for _, t, _ in GRANTED], "k").alias("snippet"))


def p40_permissions(spark, sf):
    return P.permissions(_snippets(spark, sf)).select("scan_id", "category", F.array_join("items", ",").alias("items"))


def a51_permission_risk(spark, sf):
    return P.permission_risk(P.permissions(_snippets(spark, sf)))


def p37_policy(spark, sf):
    text = F.expr("concat('use KEY_', cast(scan_id % 4 as string), ' and URL and ', case when weight = 1 then 'DB_HOST' else 'x' end)")
    return P.policy(frame(spark, sf, "findings").withColumn("snippet", text), ["URL", "HTTP"])


def p21_p15_long_words(spark, sf):
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = read(spark, sf, "documents").where(low.contains("token") | low.contains("secret"))
    return rows.select("doc_id", "source", F.size(F.regexp_extract_all("text", F.lit(r"[0-9a-f]{40}"), 0)).cast("long").alias("hashes"))


def p14_all_matches(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(?i)\bthe\b"), 0)).cast("long").alias("n"))
    return rows.where("n > 0")


def t13_timeline(spark, sf):
    rows = frame(spark, sf, "findings").withColumn("found_at", F.expr("case when line = 3 then null else cast(found_at as string) end"))
    return P.timeline(rows, "scan_id", "found_at", ["line", "file", "rule"]).select("scan_id", "position", "found_at", "line", "file", "rule")


def t15_directory(spark, sf):
    return P.directory(frame(spark, sf, "tools"), "tool_id", 100).select("tool_id", "stars", "risk_score", "position")


def _rule_sql(r):
    tests = [f"regexp_matches(body, '{r['pattern']}')"]
    f, s = r.get("file_filter") or {}, r.get("suppress") or {}
    tests += [f"ends_with(path, '.{e}')" for e in f.get("extensions", [])] + [f"ends_with(path, '{e}')" for e in f.get("filename_suffix", [])]
    tests += [f"NOT contains(body, '{x}')" for x in s.get("line_contains", [])] + [f"NOT contains(nearby, '{x}')" for x in s.get("nearby_contains", [])] + [f"NOT contains(path, '{x}')" for x in s.get("path_contains", [])]
    return f"SELECT doc_id, path, line, '{r['id']}' AS rule, '{r['severity']}' AS severity, CAST({r['weight']} AS INTEGER) AS weight, '{r['phase']}' AS phase FROM l WHERE " + " AND ".join(tests)


_FOUND = f"WITH {_LINES}, f AS (" + " UNION ALL ".join(_rule_sql(r) for r in RULES) + ")"
def _literal(x):
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def _values(rows, columns):
    return f"(VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) {columns}"


_ITEMS = f"SELECT DISTINCT l_orderkey AS scan_id, category, item FROM lineitem JOIN {{}} ON (l_orderkey + l_linenumber * l_linenumber) % {len(GRANTED)} = k".format(
    _values([(k, c, i) for k, (_, _, found) in enumerate(GRANTED) for c, items in found.items() for i in items], "g(k, category, item)")
)
_STEERING = _values([(k, p, s) for k, (p, s) in enumerate(STEERING)], "s(sk, folder, strong)")

QUERIES = {
    "s3_lines": (s3_lines, f"WITH {_LINES} SELECT doc_id, count(*) AS lines, CAST(max(line) AS INTEGER) AS last, CAST(max(length(body)) AS INTEGER) AS longest FROM l GROUP BY 1"),
    "p1_p2_p3_scan_lines": (p1_p2_p3_scan_lines, f"{_FOUND} SELECT doc_id, CAST(line AS INTEGER) AS line, rule, severity, weight FROM f"),
    "p6_scan_filtered": (p6_scan_filtered, f"{_FOUND} SELECT rule, count(*) AS findings, count(DISTINCT doc_id) AS files FROM f WHERE phase = 'credentials' AND severity IN ('HIGH', 'CRITICAL') GROUP BY 1"),
    "j1_scan_join": (j1_scan_join, f"WITH {_LINES}, r(rule, severity, pattern) AS (VALUES " + ", ".join(f"('{r['id']}', '{r['severity']}', '{r['pattern']}')" for r in RULES) + ") SELECT rule, severity, count(*) AS findings, min(doc_id) AS first FROM l JOIN r ON regexp_matches(body, pattern) GROUP BY 1, 2"),
    "p1_scan_pages": (
        p1_scan_pages,
        """WITH l AS (SELECT page_id, unnest(regexp_split_to_array(html, '\\r?\\n')) AS body FROM pages), r(rule, pattern) AS (VALUES ('SCRIPT-1', '<script'), ('TRACK-1', 'track\\([0-9]+\\)'))
SELECT rule, count(*) AS findings, count(DISTINCT page_id) AS pages FROM l JOIN r ON regexp_matches(body, pattern) GROUP BY 1""",
    ),
    "w5_w6_nearby": (w5_w6_nearby, f"WITH {_LINES} SELECT doc_id, count(*) FILTER (contains(nearby, '@mail')) AS near, count(*) FILTER (contains(body, '@mail')) AS \"at\" FROM l GROUP BY 1"),
    "w7_first_line": (w7_first_line, f"{_FOUND} SELECT path, rule, CAST(min(line) AS INTEGER) AS line FROM f GROUP BY 1, 2"),
    "p8_hidden_characters": (
        p8_hidden_characters,
        f"""WITH d AS (SELECT doc_id, {_PATH} AS path, len(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) AS n FROM documents)
SELECT folder || path AS path, 'UNICODE-' || CAST(rule AS VARCHAR) AS rule, CASE WHEN strong THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CAST(CASE WHEN strong THEN 5 ELSE 2 END AS INTEGER) AS weight, CAST(n + 1 AS INTEGER) AS line
FROM d JOIN {_STEERING} ON doc_id % {len(STEERING)} = sk JOIN {_values([(k, r) for k, (_, r) in enumerate(HIDDEN)], "h(hk, rule)")} ON doc_id % {len(HIDDEN)} = hk WHERE rule IS NOT NULL""",
    ),
    "p9_decloaked": (p9_decloaked, "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 9 ELSE 6 END AS BIGINT) AS before, CAST(CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE 4 END AS BIGINT) AS after, true AS plain FROM customer"),
    "p7_p10_file_classes": (
        p7_p10_file_classes,
        f"""SELECT p_partkey, name IN ('x.d.ts', 'y.PYI', 'z.d.mts') AS declaration, strong OR named AS instruction
FROM part JOIN {_STEERING} ON p_partkey % {len(STEERING)} = sk JOIN {_values([(k, p, s) for k, (p, s) in enumerate(STEERING_NAMES)], "m(mk, name, named)")} ON p_partkey // 6 % {len(STEERING_NAMES)} = mk""",
    ),
    "s1_s4_readable": (s1_s4_readable, f"SELECT event_id, readable AND (name NOT IN ('Dockerfile', '.env', 'dist', 'i.') OR event_id % 7 < 2) AS read FROM events JOIN {_values([(k, p, r) for k, (p, r) in enumerate(READABLE)], 'r(rk, name, readable)')} ON event_id % {len(READABLE)} = rk"),
    "p11_provenance": (
        p11_provenance,
        """WITH p AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN 'bin/' ELSE 'lib/' END AS dir, CASE o_orderkey % 9 WHEN 0 THEN '.gitignore' WHEN 1 THEN '.env' WHEN 2 THEN 'tool.exe' WHEN 3 THEN 'x.so' WHEN 4 THEN 'keygen.js' ELSE 'a.js' END AS name, o_totalprice AS size FROM orders),
f AS (SELECT dir || name AS path, 'PROV-1' AS rule, 'LOW' AS severity, 1 AS weight FROM p WHERE name = '.env' UNION ALL SELECT dir || name, 'PROV-2', 'MEDIUM', 2 FROM p WHERE name IN ('tool.exe', 'x.so') AND dir = 'lib/' UNION ALL SELECT dir || name, 'PROV-3', 'HIGH', 3 FROM p WHERE name = 'keygen.js' UNION ALL SELECT dir || name, 'PROV-4', 'LOW', 1 FROM p WHERE size > 400000)
SELECT path, rule, severity, CAST(weight AS INTEGER) AS weight, count(*) AS findings FROM f GROUP BY 1, 2, 3, 4""",
    ),
    "p23_commands": (p23_commands, "WITH c(k, command, decision) AS (VALUES " + ", ".join(f"({k}, '{c}', '{d}')" for k, (c, d) in enumerate(DECIDED.items())) + f") SELECT command, decision, count(*) AS n FROM events JOIN c ON event_id % {len(DECIDED)} = k GROUP BY 1, 2"),
    "p35_sanitized": (
        p35_sanitized,
        """SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?i)javascript:', '', 'g'), '[;&|`$<>]', '', 'g')) AS left,
 md5(regexp_replace(regexp_replace(regexp_replace(url || '&javascript:x', '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?i)javascript:', '', 'g'), '[;&|`$<>]', '', 'g')) AS url FROM pages""",
    ),
    "p40_permissions": (p40_permissions, f"SELECT scan_id, category, string_agg(item, ',' ORDER BY item) AS items FROM ({_ITEMS}) GROUP BY 1, 2"),
    "a51_permission_risk": (
        a51_permission_risk,
        f"""WITH s AS (SELECT scan_id, CAST(sum(CASE category WHEN 'process' THEN 10 WHEN 'credentials' THEN 8 WHEN 'filesystem' THEN 6 WHEN 'database' THEN 6 WHEN 'network' THEN 4 ELSE 2 END) AS BIGINT) AS score FROM ({_ITEMS}) GROUP BY 1) SELECT scan_id, score, CASE WHEN score >= 20 THEN 'HIGH' WHEN score >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s""",
    ),
    "p37_policy": (
        p37_policy,
        f"""SELECT scan_id, NOT bool_or(phase = 'network_exfil') AS network, CASE WHEN bool_or(phase = 'install_hooks') THEN 'read_only' ELSE 'workspace' END AS filesystem, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'strict' ELSE 'standard' END AS preset,
 CASE WHEN bool_or(weight = 1) THEN 'DB_HOST,' ELSE '' END || 'KEY_' || CAST(scan_id % 4 AS VARCHAR) AS environment FROM {source("findings")} GROUP BY scan_id""",
    ),
    "p21_p15_long_words": (p21_p15_long_words, "SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[0-9a-f]{40}')) AS BIGINT) AS hashes FROM documents WHERE contains(lower(text), 'token') OR contains(lower(text), 'secret')"),
    "p14_all_matches": (p14_all_matches, "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\\bthe\\b')) AS BIGINT) AS n FROM documents WHERE len(regexp_extract_all(text, '(?i)\\bthe\\b')) > 0"),
    "t13_timeline": (
        t13_timeline,
        f"""WITH f AS (SELECT scan_id, CASE WHEN line = 3 THEN NULL ELSE CAST(found_at AS VARCHAR) END AS found_at, line, file, rule FROM {source("findings")})
SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY coalesce(found_at, ''), line NULLS FIRST, file, rule) AS INTEGER) AS position FROM f""",
    ),
    "t15_directory": (t15_directory, f"SELECT tool_id, stars, risk_score, CAST(row_number() OVER (ORDER BY stars DESC, risk_score, tool_id) AS INTEGER) AS position FROM {source('tools')} QUALIFY position <= 100"),
}
