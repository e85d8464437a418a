"""Queries of scans with many rules, over whole contents, and of the scan flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals as G
from ..operators import content as C
from ..operators import context, dataflow, flow, rulescan, scanning, setjoin
from ..sources import trees
from ..streaming.runs import shared_path
from .inputs import read
from .text import RULES, _FOUND, _LINES, _PATH, _files, _values

#: Of rule k: three letters, how many letters follow in the word, and whether case counts. Every fiftieth is a run of digits, of which no word can be required.
_WORD = "chr(cast(97 + k % 26 as int)) || chr(cast(97 + k div 26 % 26 as int)) || chr(cast(97 + k * 7 div 676 % 26 as int))"
_MORE, _ANY_CASE, _DIGITS = "1 + k % 4", "k % 3 = 0", "k % 50 = 49"


def _generated(spark, n):
    """n rules that are rows: words, some in any case, and numbers."""
    border = "case when {} then '(?i)' else '' end || '(^|[^a-z])' || {} || '[a-z]{{' || ({}) || '}}([^a-z]|$)'"
    pattern = f"case when {_DIGITS} then '(^|[^0-9])[0-9]{{' || (1 + k div 50 % 12) || '}}([^0-9]|$)' else {border.format(_ANY_CASE, _WORD, _MORE)} end"
    return spark.range(n).withColumnRenamed("id", "k").selectExpr("'G-' || k as id", "'code_patterns' as phase", "case when k % 2 = 0 then 'HIGH' else 'LOW' end as severity", f"{pattern} as pattern", "cast(1 + k % 3 as int) as weight")


def _generated_sql(n, lines):
    """Words and numbers of the lines by what they begin with and how long they are; a join, not a scan with patterns."""
    return f"""r AS (SELECT k, 'G-' || CAST(k AS VARCHAR) AS rule, CASE WHEN k % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity, {_DIGITS.replace(' div ', ' // ')} AS digits, {_ANY_CASE} AS folded,
 {_WORD.replace(' div ', ' // ')} AS word, {_MORE} AS more, 1 + k // 50 % 12 AS run FROM (SELECT CAST(range AS BIGINT) AS k FROM range({n}))),
v AS (SELECT DISTINCT id, line, folded, x FROM (SELECT id, line, false AS folded, unnest(regexp_extract_all(body, '[a-z]+')) AS x FROM {lines} UNION ALL SELECT id, line, true, unnest(regexp_extract_all(lower(body), '[a-z]+')) FROM {lines})),
f AS (SELECT DISTINCT rule, severity, id, line FROM r JOIN v ON v.folded = r.folded AND NOT digits AND length(x) = 3 + more AND left(x, 3) = word
 UNION ALL SELECT DISTINCT rule, severity, id, line FROM r JOIN (SELECT id, line, unnest(regexp_extract_all(body, '[0-9]+')) AS x FROM {lines}) ON digits AND length(x) = run)"""


def p1_automaton_scan(spark, sf):
    return rulescan.scan_rules(_files(spark, sf), _generated(spark, 200)).select("doc_id", "line", "rule", "severity")


def j1_automaton_rules(spark, sf):
    found = rulescan.scan_rules(_files(spark, sf), _generated(spark, 2000))
    return found.groupBy("rule", "severity").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("files"), F.min("doc_id").alias("first"))


def j1_automaton_pages(spark, sf):
    pages = read(spark, sf, "pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("text"))
    return rulescan.scan_rules(pages, _generated(spark, 2000)).groupBy("rule", "severity").agg(F.count("*").alias("findings"), F.count_distinct("page_id").alias("files"), F.min("page_id").alias("first"))


#: Patterns over whole texts, as Python and DuckDB both read them: they cross line ends, stand at line starts, or repeat.
WHOLE = [
    {"id": "BREAK", "phase": "code_patterns", "severity": "LOW", "pattern": r"[.!?]\n+[a-z]", "description": "a sentence after a line end"},
    {"id": "OPENING", "phase": "code_patterns", "severity": "MEDIUM", "pattern": r"^(the|die|la|el) [a-z]+", "description": "an article opens a line"},
    {"id": "MAIL", "phase": "credentials", "severity": "HIGH", "pattern": r"[a-z0-9]+@mail[0-9][.]example[.]com[ \n]", "description": "a mail address"},
    {"id": "TOKEN", "phase": "credentials", "severity": "CRITICAL", "pattern": r"token = \"[0-9a-f]{40}\"", "description": "a token"},
]


def p14_whole_content(spark, sf):
    files = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    found = C.content_findings(files, WHOLE)
    return found.select(F.col("path").cast("long").alias("doc_id"), "rule", "line", "offset", "nth", F.md5(F.col("snippet").cast("binary")).alias("snippet"))


_WHOLE_SQL = " UNION ALL ".join(
    f"""SELECT doc_id, '{r["id"]}' AS rule, text, regexp_split_to_array(text, '(?im)' || '{r["pattern"]}') AS parts, regexp_extract_all(text, '(?im)' || '{r["pattern"]}') AS found FROM documents WHERE text IS NOT NULL""" for r in WHOLE
).replace("\\n", "' || chr(10) || '")


#: A call split by a character without width, and a file name for each document.
_HIDDEN = "case doc_id % 7 when 0 then concat(text, chr(10), 'ev​al(x)') when 1 then concat('‮', text) when 2 then replace(text, 'token', 'to‍ken') else text end"
_NAMES = "case doc_id % 5 when 0 then 'a.d.ts' when 1 then 'CLAUDE.md' when 2 then 'b.pyi' when 3 then '.hidden' else 'c.js' end"
_PACKS = [
    ("calls", "EVAL", "code_patterns", "HIGH", r"\beval\s*\(", 5), ("secrets", "TOKEN", "credentials", "CRITICAL", 'token = "[0-9a-f]{40}"', 2), ("supply", "LICENSE", "obfuscation", "LOW", "(MIT|Apache) License", 5),
    ("supply", "MAIL", "network_exfil", "MEDIUM", "@mail[0-9]", 3), ("supply", "SIGNS", "code_patterns", "LOW", "[%$&#*]{3}", 5),
]


def _flow(spark, sf):
    docs = read(spark, sf, "documents").selectExpr("doc_id as scan_id", f"{_NAMES} as path", f"{_HIDDEN} as text", "case when doc_id % 11 = 0 then 'good' else 'd' || doc_id end as digest".replace("'d' || doc_id", "concat('d', doc_id)"))
    packs = spark.createDataFrame(_PACKS, "pack string, id string, phase string, severity string, pattern string, weight int")
    cloud = spark.createDataFrame([("CLOUD", "network_exfil", "HIGH", "https?://", 3)], "id string, phase string, severity string, pattern string, weight int")
    users = spark.createDataFrame([("network_exfil", "MAIL", r"\.js$", None, True), ("obfuscation", "LICENSE", None, None, False)], "pattern_type string, rule string, file_pattern string, evidence_pattern string, suppress boolean")
    approved = spark.createDataFrame([("good",), ("",)], "digest string")
    hidden = [{"id": "PROV-1", "severity": "LOW", "kind": "hidden_file"}]
    return docs, flow.scan(docs, packs, cloud, hidden, users, approved, "EVAL", least_severity=None)


def u5_flow_findings(spark, sf):
    return _flow(spark, sf)[1].select("scan_id", "rule", "phase", "severity", "weight", F.coalesce("line", F.lit(0)).alias("line"))


def u5_scan_flow(spark, sf):
    docs, found = _flow(spark, sf)
    return flow.verdicts(found, docs)


_FLOW = f"""WITH d AS (SELECT doc_id, doc_id % 5 AS n, regexp_split_to_array(CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'eval(x)' ELSE text END, '\\r?\\n') AS lines, text FROM documents),
l AS (SELECT doc_id, n, u.i AS line, lines[u.i] AS body FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
m(rule, run, severity, weight, pattern) AS (VALUES ('EVAL', 'code_patterns', 'HIGH', 5, '\\beval\\s*\\('), ('TOKEN', 'credentials', 'CRITICAL', 2, 'token = "[0-9a-f]{{40}}"'),
 {", ".join(f"('{i}', '{run}', '{s}', {w}, '{p}')" for pack, i, _, s, p, w in _PACKS if pack == "supply" for run in ("obfuscation", "network_exfil", "code_patterns"))}),
a AS (SELECT doc_id AS scan_id, rule, run AS phase, severity, weight, line FROM l JOIN m ON regexp_matches(body, pattern) WHERE NOT (run = 'code_patterns' AND n IN (0, 2)) AND NOT (rule = 'MAIL' AND run = 'network_exfil' AND n = 4)
 UNION ALL SELECT doc_id, 'CLOUD', 'network_exfil', 'HIGH', 3, line FROM l WHERE regexp_matches(body, 'https?://')
 UNION ALL SELECT doc_id, 'UNICODE-3', 'obfuscation', CASE WHEN n = 1 THEN 'HIGH' ELSE 'MEDIUM' END, CASE WHEN n = 1 THEN 5 ELSE 2 END, len(lines) FROM d WHERE doc_id % 7 = 0
 UNION ALL SELECT doc_id, 'UNICODE-2', 'obfuscation', CASE WHEN n = 1 THEN 'HIGH' ELSE 'MEDIUM' END, CASE WHEN n = 1 THEN 5 ELSE 2 END, 1 FROM d WHERE doc_id % 7 = 1
 UNION ALL SELECT doc_id, 'UNICODE-3', 'obfuscation', CASE WHEN n = 1 THEN 'HIGH' ELSE 'MEDIUM' END, CASE WHEN n = 1 THEN 5 ELSE 2 END, min(line) FROM l WHERE doc_id % 7 = 2 AND contains(body, 'token') GROUP BY doc_id, n
 UNION ALL SELECT doc_id, 'PROV-1', 'provenance', 'LOW', 1, 0 FROM d WHERE n = 3),
k AS (SELECT * FROM a WHERE scan_id % 11 > 0 OR scan_id IN (SELECT scan_id FROM a WHERE rule = 'EVAL'))"""


#: A program for each document: a value from an entry handed on over up to ten names, with lines of the document between, and one of the names given anew.
_CHAIN = """concat(case when doc_id % 4 = 0 then 'v0 = request.args' when doc_id % 4 = 1 then 'let v0 = input()' else 'v0 = 5' end, chr(10), text, chr(10),
 concat_ws(chr(10), transform(sequence(1, cast(1 + doc_id % 10 as int)), i -> concat('v', i, ' = f(v', i - 1, ', w', i, ')'))), chr(10),
 case when doc_id % 7 = 0 then 'v1 = 0' when doc_id % 7 = 1 then 'v0 = input() + v1' when doc_id % 7 = 2 then 'v0 == input()' else 'x = escape(v0)' end, chr(10), 'v3 = v1', chr(10),
 case when doc_id % 3 = 0 then concat('eval(v', 1 + doc_id % 10, ')') when doc_id % 3 = 1 then 'y = os.system(v3); eval(v1)' else 'os.system(v0)' end)"""
_SOURCES, _SINKS, _CLEANERS = ["input()", "request.args"], ["eval(", "os.system("], ["escape("]


def p33_def_use_chains(spark, sf):
    files = read(spark, sf, "documents").selectExpr("cast(doc_id as string) as path", f"{_CHAIN} as text")
    return dataflow.flows(files, _SOURCES, _SINKS, _CLEANERS).withColumn("path", F.col("path").cast("long"))


_CHAINS = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_CHAIN.replace("transform(sequence(1, cast(1 + doc_id % 10 as int)), i -> concat('v', i, ' = f(v', i - 1, ', w', i, ')'))", "array_to_string([('v' || i || ' = f(v' || (i - 1) || ', w' || i || ')') for i in range(1, 2 + doc_id % 10)], chr(10))")} AS text FROM documents),
l AS (SELECT doc_id, u.i AS line, lines[u.i] AS body FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS lines FROM d), unnest(range(1, len(lines) + 1)) AS u(i)),
g AS (SELECT doc_id, line, regexp_extract(body, '^\s*(?:(?:const|let|var)\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=([^=].*)?$', 1) AS name, regexp_extract(body, '^\s*(?:(?:const|let|var)\s+)?[A-Za-z_][A-Za-z0-9_]*\s*=([^=].*)?$', 1) AS value FROM l),
a AS (SELECT * FROM g WHERE name <> ''),
k(sink) AS (VALUES ('eval('), ('os.system(')), e(entry) AS (VALUES ('input()'), ('request.args')),
s AS (SELECT doc_id, line, sink, substr(body, instr(body, sink) + length(sink)) AS rest FROM l JOIN k ON contains(body, sink)),
c AS (SELECT DISTINCT u.doc_id, u.line AS line, max(a.line) OVER (PARTITION BY u.doc_id, u.line, u.var) AS source FROM (SELECT doc_id, line, unnest(regexp_extract_all(value, '[A-Za-z_][A-Za-z0-9_]*')) AS var FROM a) u JOIN a ON a.doc_id = u.doc_id AND a.name = u.var AND a.line < u.line),
t AS (SELECT DISTINCT u.doc_id, u.line AS line, sink, max(a.line) OVER (PARTITION BY u.doc_id, u.line, sink, u.var) AS source FROM (SELECT doc_id, line, sink, unnest(regexp_extract_all(rest, '[A-Za-z_][A-Za-z0-9_]*')) AS var FROM s) u JOIN a ON a.doc_id = u.doc_id AND a.name = u.var AND a.line < u.line),
r AS (SELECT doc_id, entry, line AS first, line AS "at", 0 AS hops FROM a JOIN e ON contains(value, entry) UNION SELECT r.doc_id, entry, first, c.line, hops + 1 FROM r JOIN c ON c.doc_id = r.doc_id AND c.source = r."at")
SELECT r.doc_id AS path, entry, sink, CAST(first AS INTEGER) AS first, CAST(t.line AS INTEGER) AS last, CAST(min(hops) AS INTEGER) AS hops, bool_or(contains(text, 'escape(')) AS sanitized FROM r JOIN t ON t.doc_id = r.doc_id AND t.source = r."at" JOIN d ON d.doc_id = r.doc_id GROUP BY ALL"""


def _order_sets(spark, sf):
    """The goods of each order, and one that a third of all orders has."""
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.expr("l_partkey % 300")).alias("items"))
    return rows.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_orderkey") % 3 == 0, F.array_union("items", F.array(F.lit(-1).cast("long")))).otherwise(F.col("items")).alias("items"))


def u6_similar_orders(spark, sf):
    return setjoin.by_jaccard(_order_sets(spark, sf), 0.6).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def j12_overlapping_orders(spark, sf):
    return setjoin.by_larger(_order_sets(spark, sf), 0.6).select("a", "b", F.round("share", 6).alias("share"))


_ORDERS = """WITH s AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 300 AS item FROM lineitem UNION SELECT DISTINCT l_orderkey, -1 FROM lineitem WHERE l_orderkey % 3 = 0),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.id AS a, y.id AS b, count(*) AS s FROM s x JOIN s y ON x.item = y.item AND x.id < y.id GROUP BY 1, 2),
q AS (SELECT a, b, s, x.n AS n, y.n AS m FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b)"""

#: Where documents go in a tree: a folder by source, one of five below it, and a name.
_TREE_PATH = "concat(source, '/d', doc_id % 5, '/', case when doc_id % 4 = 0 then 'node_modules/' when doc_id % 4 = 1 then 'sub/' else '' end, doc_id, '-', case doc_id % 7 when 0 then 'x' when 1 then 'notes.txt' when 2 then 'run.log' when 3 then 'keep.log' when 4 then 'tmp.js' else 'y.md' end)"


def s1_tree_walk(spark, sf):
    """Documents written to files, and read back but for what ignore files at three levels leave out."""
    files = read(spark, sf, "documents").selectExpr(f"case when doc_id % 11 = 0 then concat(source, '/.hidden/', doc_id) else {_TREE_PATH} end as path", "text")
    tops = read(spark, sf, "documents").select("source").distinct()
    ignoring = spark.createDataFrame([(".scanignore", "# logs\n*.log\n!*-keep.log\n")], "path string, text string")
    ignoring = ignoring.unionByName(tops.selectExpr("concat(source, '/.scanignore') as path", "'d3/\n/d4/sub\n' as text"))
    ignoring = ignoring.unionByName(tops.selectExpr("concat(source, '/d1/.scanignore') as path", "concat('*.js', char(10), '!sub/*.js', char(10), '*-keep.log') as text"))
    root = shared_path(spark, "tree")
    trees.write_tree(files.unionByName(ignoring), root)
    found = trees.tree(spark, root).where("not endswith(path, '.scanignore')")
    return found.select("path", "length", F.md5(F.col("text").cast("binary")).alias("digest"))


_WALKED = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, doc_id % 5 AS d, doc_id % 7 AS n, doc_id % 4 AS s, doc_id % 11 = 0 AS hidden FROM documents)
SELECT CASE WHEN hidden THEN source || '/.hidden/' || doc_id ELSE {_TREE_PATH} END AS path, CAST(strlen(text) AS BIGINT) AS length, md5(text) AS digest FROM d
WHERE hidden OR (s > 0 AND n <> 2 AND d <> 3 AND NOT (d = 4 AND s = 1) AND NOT (d = 1 AND n = 3) AND NOT (d = 1 AND n = 4 AND s <> 1))"""

QUERIES = {
    "s1_tree_walk": (s1_tree_walk, _WALKED),
    "p33_def_use_chains": (p33_def_use_chains, _CHAINS),
    "u6_similar_orders": (u6_similar_orders, f"{_ORDERS} SELECT a, b, round(s / (n + m - s)::DOUBLE, 6) AS jaccard FROM q WHERE s / (n + m - s)::DOUBLE >= 0.6"),
    "j12_overlapping_orders": (j12_overlapping_orders, f"{_ORDERS} SELECT a, b, round(s / greatest(n, m)::DOUBLE, 6) AS share FROM q WHERE s / greatest(n, m)::DOUBLE >= 0.6"),
    "p1_automaton_scan": (p1_automaton_scan, f"WITH {_LINES}, s AS (SELECT doc_id AS id, line, body FROM l), {_generated_sql(200, 's')} SELECT id AS doc_id, CAST(line AS INTEGER) AS line, rule, severity FROM f"),
    "j1_automaton_rules": (j1_automaton_rules, f"WITH {_LINES}, s AS (SELECT doc_id AS id, line, body FROM l), {_generated_sql(2000, 's')} SELECT rule, severity, count(*) AS findings, count(DISTINCT id) AS files, min(id) AS first FROM f GROUP BY 1, 2"),
    "j1_automaton_pages": (
        j1_automaton_pages,
        f"WITH p AS (SELECT page_id, regexp_split_to_array(html, '\\r?\\n') AS lines FROM pages), s AS (SELECT page_id AS id, u.i AS line, lines[u.i] AS body FROM p, unnest(range(1, len(lines) + 1)) AS u(i)), {_generated_sql(2000, 's')} SELECT rule, severity, count(*) AS findings, count(DISTINCT id) AS files, min(id) AS first FROM f GROUP BY 1, 2",
    ),
    "p14_whole_content": (
        p14_whole_content,
        f"""WITH w AS ({_WHOLE_SQL}),
m AS (SELECT doc_id, rule, text, u.i AS i, CAST(list_sum(list_transform(parts[1:u.i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:u.i - 1], lambda x: length(x))), 0) AS BIGINT) AS "offset" FROM w, unnest(range(1, len(found) + 1)) AS u(i)),
p AS (SELECT doc_id, rule, i, "offset", string_split(text, chr(10)) AS lines, 1 + length("left"(text, "offset")) - length(replace("left"(text, "offset"), chr(10), '')) AS line FROM m)
SELECT doc_id, rule, CAST(line AS INTEGER) AS line, "offset", CAST(row_number() OVER (PARTITION BY doc_id, rule, line ORDER BY i) AS INTEGER) AS nth,
 md5("left"(array_to_string(list_transform(lines[greatest(line - 1, 1):line + CASE WHEN line + 1 = len(lines) AND lines[-1] = '' THEN 0 ELSE 1 END], lambda x: regexp_replace(x, '\\r$', '')), chr(10)), 500)) AS snippet FROM p""",
    ),
    "u5_flow_findings": (u5_flow_findings, f"{_FLOW} SELECT scan_id, rule, phase, severity, CAST(weight AS INTEGER) AS weight, CAST(line AS INTEGER) AS line FROM k"),
    "u5_scan_flow": (
        u5_scan_flow,
        f"""{_FLOW}, s AS (SELECT doc_id AS scan_id, CAST(coalesce(sum(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 5 END * weight), 0) AS BIGINT) AS score, count(rule) AS findings, coalesce(bool_or(severity = 'CRITICAL'), false) AS critical
 FROM documents LEFT JOIN k ON scan_id = doc_id GROUP BY 1)
SELECT scan_id, score, findings, CASE WHEN critical THEN 'CRITICAL_RISK' WHEN score >= 25 THEN 'HIGH_RISK' WHEN score >= 10 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS verdict FROM s""",
    ),
}


def p4_snippets(spark, sf):
    """What findings quote: at most 200 bytes of a line, cut between characters."""
    rules = spark.createDataFrame([("LONG", "LOW", "[.!?] ", "A sentence")], "id string, severity string, pattern string, description string")
    return rulescan.scan_rules(_files(spark, sf), rules).select("doc_id", "line", F.md5(F.col("snippet").cast("binary")).alias("snippet"), F.octet_length("snippet").alias("bytes"))


#: Strings, comments and calls between the lines of a document.
_CALLS = "concat(replace(text, '`', ''), chr(10), 'eval(a); ''eval(b)'' + eval (c) // eval(d)', chr(10), '/* eval(e)', chr(10), 'eval(f) */ \"eval(g)\" eval(', cast(doc_id as string), ') # eval(h)')"


def p16_live_text(spark, sf):
    """Calls outside of strings and comments, in documents with apostrophes and quotation marks of their own."""
    return read(spark, sf, "documents").selectExpr("doc_id", f"{_CALLS} as text").select("doc_id", context.live_calls(F.col("text")).alias("calls"))


_PIECES = r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|/\*[\s\S]*?(?:\*/|\z)|//[^\n]*|#[^\n]*|\beval\s*\("""

#: A value decoded, and decoded again under its name or another's.
_DECODED = "concat(text, chr(10), 'a', doc_id % 3, ' = atob(x)', chr(10), case when doc_id % 5 < 2 then 'y = base64.b64decode(a0)' when doc_id % 5 = 2 then 'a9 = 1' else 'z = atob(q + a1 )' end, chr(10), 'h = bytes.fromhex(s).decode()', chr(10), case when doc_id % 4 = 0 then 'atob( h )' else 'atob(hh)' end)"


def p21_chains_text(spark, sf):
    rows = read(spark, sf, "documents").selectExpr("doc_id", f"{_DECODED} as text")
    return rows.select("doc_id", context.decode_chain(F.col("text")).alias("decoded"), context.hex_chain(F.col("text")).alias("hexed"))


def p25_signals_text(spark, sf):
    """What pages and documents say of kinds, providers and infrastructure, part words too."""
    docs = read(spark, sf, "documents").selectExpr("'document' as source", "doc_id as id", "text").unionByName(read(spark, sf, "pages").selectExpr("'page' as source", "page_id as id", "html as text"))
    found = [F.array_join(G.detected(F.col("text"), table), ",").alias(name) for name, table in (("kinds", G.KINDS), ("providers", G.PROVIDERS), ("infrastructure", G.INFRASTRUCTURE))]
    return docs.where("text is not null").select("source", "id", *found)


def _detected_sql(table):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'''contains(t, '{w.lower()}')''' for w in words)} THEN '{k}' END" for k, words in table.items()) + "], lambda x: x IS NOT NULL), ',')"


def p40_permissions_text(spark, sf):
    """Permissions told by the lines of documents that a scan found."""
    rules = spark.createDataFrame([("read-file-url", "@|https?:|/|[0-9]{4}"), ("exec-command", "token|password|=")], "id string, pattern string")
    found = rulescan.scan_rules(_files(spark, sf), rules).select(F.col("doc_id").alias("scan_id"), "rule", "snippet")
    return scanning.permissions(found).select("scan_id", "category", F.array_join("items", ",").alias("items"))


_SNIP = "CASE WHEN strlen(trim(body)) <= 200 THEN trim(body) ELSE trim(list_max(list_transform(list_filter(range(0, 201), lambda n: strlen(\"left\"(trim(body), n)) <= 200), lambda n: \"left\"(trim(body), n)))) || ' ...' END"
_GRANTS = [
    ("environment", "true", r"process\.env\.([a-z_][a-z0-9_]*)"), ("environment", "true", r"os\.environ\[?['\"]([a-z_][a-z0-9_]*)['\"]?\]?"), ("environment", "true", r"getenv\(['\"]([a-z_][a-z0-9_]*)['\"]?\)"), ("environment", "true", r"\$\{?([a-z_][a-z0-9_]*)\}?"),
    ("filesystem", "rule = 'read-file-url'", r"([~/]\S+\.\w+)"), ("filesystem", "rule = 'read-file-url'", r"(/[a-zA-Z0-9/_.-]+)"), ("filesystem", "rule = 'read-file-url'", r"(\./[a-zA-Z0-9/_.-]+)"),
    ("network", "rule = 'read-file-url'", r"https?://([^/\s]+)"), ("network", "rule = 'read-file-url'", r"localhost:(\d+)"), ("network", "rule = 'read-file-url'", r":(\d+)"),
    ("process", "rule = 'exec-command'", r"exec\(['\"]([^'\"]+)['\"]"), ("process", "rule = 'exec-command'", r"spawn\(['\"]([^'\"]+)['\"]"), ("process", "rule = 'exec-command'", r"system\(['\"]([^'\"]+)['\"]"),
]


def _quoted(pattern):
    return "'" + pattern.replace("'", "''") + "'"


QUERIES |= {
    "p4_snippets": (p4_snippets, f"WITH {_LINES}, s AS (SELECT doc_id, line, 'A sentence: ' || {_SNIP} AS snippet FROM l WHERE regexp_matches(body, '[.!?] ')) SELECT doc_id, CAST(line AS INTEGER) AS line, md5(snippet) AS snippet, CAST(strlen(snippet) AS INTEGER) AS bytes FROM s"),
    "p16_live_text": (p16_live_text, f"SELECT doc_id, CAST(len(list_filter(regexp_extract_all({_CALLS}, {_quoted(_PIECES)}), lambda p: regexp_matches(p, '^eval'))) AS INTEGER) AS calls FROM documents WHERE text IS NOT NULL"),
    "p21_chains_text": (p21_chains_text, "SELECT doc_id, doc_id % 3 = 0 AND doc_id % 5 < 2 OR doc_id % 3 = 1 AND doc_id % 5 > 2 AS decoded, doc_id % 4 = 0 AS hexed FROM documents WHERE text IS NOT NULL"),
    "p25_signals_text": (p25_signals_text, f"SELECT source, id, {_detected_sql(G.KINDS)} AS kinds, {_detected_sql(G.PROVIDERS)} AS providers, {_detected_sql(G.INFRASTRUCTURE)} AS infrastructure FROM (SELECT 'document' AS source, doc_id AS id, lower(text) AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'page', page_id, lower(html) FROM pages WHERE html IS NOT NULL)"),
    "p40_permissions_text": (
        p40_permissions_text,
        f"""WITH {_LINES}, s AS (SELECT doc_id, rule, lower({_SNIP}) AS t FROM l JOIN (VALUES ('read-file-url', '@|https?:|/|[0-9]{{4}}'), ('exec-command', 'token|password|=')) r(rule, p) ON regexp_matches(body, p)),
g AS ({" UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, unnest({'list_transform(' if c == 'environment' else ''}regexp_extract_all(t, {_quoted(p)}, 1){', lambda x: upper(x))' if c == 'environment' else ''}) AS item FROM s WHERE {when}" for c, when, p in _GRANTS)}
 UNION ALL SELECT doc_id, 'database', 'Database connection required' FROM s WHERE regexp_matches(t, 'database|sql|postgres|mysql|mongodb|redis|sqlite') UNION ALL SELECT doc_id, 'credentials', 'Requires authentication' FROM s WHERE regexp_matches(t, 'api[_-]?key|access[_-]?token|secret[_-]?key|password|token|credential'))
SELECT doc_id AS scan_id, category, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM g GROUP BY 1, 2""",
    ),
}
