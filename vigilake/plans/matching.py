"""Queries that match tools, names and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import categories as K
from ..functions import names as N
from ..functions import signals as G
from ..operators import matching as M
from .inputs import frame, read, source

TOOLS, FINDINGS, USAGE = source("tools"), source("findings"), source("usage")
#: What findings say, as an expression for Spark and DuckDB.
DESCRIPTION = "concat(case scan_id % 3 when 0 then 'This was the dynamic call' when 1 then 'Network access from that file' else 'Dynamic code' end, case line % 2 when 0 then ' with network' else ' and install' end)"
EVIDENCE = "case when line = 5 then null else concat('run(', file, ') as ', phase, case scan_id % 2 when 0 then ' eval' else ' exec' end) end"
TARGETS = ["red-widget-1", "small-ring-12", "blue-gear", "large-bolt-3", "green-widget"]
_TARGETS = "(VALUES " + ", ".join(f"('{t}')" for t in TARGETS) + ") g(target)"
VARIABLES = ["API_KEY", "DB_URL", "TOKEN", "HOST", "PORT", "REGION", "BUCKET"]
PROTOCOLS = ["HTTP", "REST", "WebSocket", "gRPC", "GraphQL", "Webhook"]
CAPABILITIES = ["accesses_database", "reads_files", "processes_user_input", "makes_network_calls", "handles_credentials", "generates_content"]
CATEGORIES = {"data": "Database", "search": "Search", "web": "API Integration", "communication": "Communication", "storage": "File System", "code": "Code Tools"}


def tools(spark, sf):
    return frame(spark, sf, "tools")


def j25_lookalikes(spark, sf):
    return M.lookalikes(tools(spark, sf).select("tool_id", "name"), TARGETS).select("tool_id", "target")


def j26_t9_lookalike_alerts(spark, sf):
    return M.lookalike_alerts(tools(spark, sf).select("name").distinct(), TARGETS)


def _own(tool, items, spread):
    """An array of the items whose place, mixed with the tool, comes out low; the SQL has the same rule."""
    return F.array_compact(F.array(*[F.when((F.col(tool) * (k + 3) + k) % spread < 2, F.lit(v)) for k, v in enumerate(items)]))


def _own_sql(tool, items, spread):
    return "SELECT tool_id, v FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in enumerate(items)) + f") x(k, v), (SELECT p_partkey AS tool_id FROM part) WHERE ({tool} * (k + 3) + k) % {spread} < 2"


def variable_members(spark, sf):
    return M.item_classes(tools(spark, sf).select("tool_id", _own("tool_id", VARIABLES, 11).alias("variables")), "variables")


def protocol_members(spark, sf):
    return M.item_classes(tools(spark, sf).select("tool_id", _own("tool_id", PROTOCOLS, 13).alias("protocols")), "protocols")


def capability_members(spark, sf):
    return M.item_classes(tools(spark, sf).select("tool_id", _own("tool_id", CAPABILITIES, 17).alias("capabilities")), "capabilities")


def j12_variable_classes(spark, sf):
    return M.shared_variable_classes(variable_members(spark, sf))


def j12_shared_variables(spark, sf):
    return M.matches_per_tool(variable_members(spark, sf), M.both_ways(j12_variable_classes(spark, sf)))


def j13_protocol_classes(spark, sf):
    return M.complementary_classes(protocol_members(spark, sf), M.PROTOCOL_FITS, 0.4, 0.8)


def j13_protocols(spark, sf):
    return M.matches_per_tool(protocol_members(spark, sf), j13_protocol_classes(spark, sf))


def j14_capability_classes(spark, sf):
    return M.complementary_classes(capability_members(spark, sf), M.CAPABILITY_FITS)


def j14_complementary(spark, sf):
    return M.matches_per_tool(capability_members(spark, sf), j14_capability_classes(spark, sf))


def _named(spark, sf):
    category = F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair]), F.col("category"))
    return tools(spark, sf).select("tool_id", "ecosystem", category.alias("category"), "risk_score")


def j15_category_match(spark, sf):
    return M.category_matches(_named(spark, sf), M.CATEGORY_FITS)


def j16_best_matches(spark, sf):
    rows = _named(spark, sf).select("tool_id", "ecosystem", "category", F.greatest(F.lit(0.0), 100.0 - F.col("risk_score") * 5).alias("trust"), _own("tool_id", VARIABLES, 11).alias("variables"), _own("tool_id", PROTOCOLS, 13).alias("protocols"), _own("tool_id", CAPABILITIES, 17).alias("capabilities"))
    return M.best_matches(rows, M.PROTOCOL_FITS, M.CAPABILITY_FITS, M.CATEGORY_FITS)


def j17_tool_matches(spark, sf):
    t = tools(spark, sf).select("tool_id", "name")
    m = read(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("a"), (F.col("l_suppkey") * 7 % 500).alias("b"), F.round(F.col("l_discount") * 10, 4).alias("score")).where("a <> b").groupBy("a", "b").agg(F.max("score").alias("score"))
    rows = m.join(t.select(F.col("tool_id").alias("a"), F.col("name").alias("primary_name")), "a").join(t.select(F.col("tool_id").alias("b"), F.col("name").alias("secondary_name")), "b")
    return rows


def t11_stack(spark, sf):
    return M.stack(tools(spark, sf))


def _metrics(spark, sf):
    return read(spark, sf, "events").select((F.col("user_id") % 200 + 1).alias("tool_id"), F.col("ts").alias("seen_at"), F.expr("cast(regexp_extract(props, '[0-9]+', 0) as int)").alias("downloads"), (F.col("event_id") % 13).alias("stars"))


def _trending(spark, sf):
    return M.trending(_metrics(spark, sf), tools(spark, sf), F.expr("timestamp_ntz'2024-01-16 00:00:00'"))


def j11_w4_trending(spark, sf):
    return _trending(spark, sf).select("tool_id", "score", "growth", "direction")


def w3_w8_ranks(spark, sf):
    now = F.expr("timestamp_ntz'2024-02-01 00:00:00'")
    cache = read(spark, sf, "events").select((F.col("user_id") % 200 + 1).alias("tool_id"), (F.col("event_id") * 7 % 40 + 1).alias("rank"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 12 days")).alias("expires_at"))
    top = M.top_ranked(_trending(spark, sf).drop("direction"), 30)
    return M.rank_changes(top, M.previous_ranks(cache, now)).select("tool_id", "score", F.col("rank").cast("long").alias("rank"), "previous", "change", "direction")


def w11_latest_metrics(spark, sf):
    rows = _metrics(spark, sf).select("tool_id", F.to_date("seen_at").alias("date"), "downloads", "stars")
    return M.latest_metrics(rows)


def _described(spark, sf):
    return frame(spark, sf, "findings").selectExpr("*", f"{DESCRIPTION} as description", f"{EVIDENCE} as evidence")


def a35_pattern_groups(spark, sf):
    return M.pattern_groups(_described(spark, sf))


def j29_root_cause(spark, sf):
    return M.root_cause_similarity(_described(spark, sf), ["scan_id", "phase"])


def p28_p42_tool_category(spark, sf):
    rows = tools(spark, sf)
    return rows.select("tool_id", K.tool_category(F.col("name"), F.col("description")).alias("category"), K.described_category(F.col("description")).alias("described"))


#: Names and descriptions, and their categories by both and by the description alone, told by hand.
CATEGORIZED = [
    ("pg-dbtool", "Email helper", "database_connectors", "AI/LLM"), ("helper", "Sends SQL", "database_connectors", "Database"), ("mailer", "plain words", "ai_llm_tools", "AI/LLM"), ("note", "An email tool", "ai_llm_tools", "AI/LLM"),
    ("audit-log", "Good", "security_tools", "Uncategorized"), ("x", "Finds vulnerabilities", "security_tools", "Uncategorized"), ("x", "A REST gateway", "api_integrations", "API Integration"), ("eslint-y", "Good", "code_tools", "Uncategorized"),
    ("x", "Checks syntax", "code_tools", "Uncategorized"), ("fsx", "Good", "file_system_tools", "Uncategorized"), ("x", "Lists a directory", "file_system_tools", "File System"), ("k8s-up", "Good", "devops_tools", "Uncategorized"),
    ("solr-x", "Good", "search_tools", "Uncategorized"), ("x", "An index", "search_tools", "Search"), ("robot", "Good", "communication_tools", "Uncategorized"), ("x", "Good for observability", "monitoring_tools", "Uncategorized"),
    ("etl-x", "Good", "data_tools", "Uncategorized"), ("spec-x", "Good", "testing_tools", "Uncategorized"), ("x", "Good", "code_tools", "Uncategorized"), ("x", "Webhook to Slack", "communication_tools", "API Integration"),
    ("x", "Build it", "code_tools", "Code Tools"), ("x", "Hides a secret", "code_tools", "Security"), ("x", "Docker up", "devops_tools", "DevOps"), ("x", "A message", "code_tools", "Communication"), (None, None, "code_tools", "Uncategorized"),
]


def p28_p42_told_categories(spark, sf):
    row = F.expr(f"cast(p_partkey % {len(CATEGORIZED)} as int)")
    name, said = (F.get(F.array(*[F.lit(c[k]) for c in CATEGORIZED]), row) for k in (0, 1))
    return read(spark, sf, "part").select("p_partkey", K.tool_category(name, said).alias("category"), K.described_category(said).alias("described"))


_IMPORTS = "case tool_id % 7 when 0 then array('requests', 'psycopg2') when 1 then array('axios') when 2 then array('MyDatabase', 'flask', 'express') when 3 then array('paramiko') else array() end"
_ENVS = "case tool_id % 5 when 0 then array('REDIS_URL') when 1 then array('WS_HOST') else array() end"


def p46_tags(spark, sf):
    """Protocols, runtimes and capabilities of tools."""
    rows = tools(spark, sf).selectExpr("tool_id", "case tool_id % 4 when 0 then 'pypi' when 1 then 'npm' when 2 then 'mcp' else 'skills' end as ecosystem", "case when tool_id % 6 = 0 then concat(description, ' in Docker') else description end as description", f"cast({_IMPORTS} as array<string>) as imports", f"cast({_ENVS} as array<string>) as envs")
    calls = F.expr("case tool_id % 3 when 0 then array('HTTPS GET') when 1 then array('raw') else cast(array() as array<string>) end")
    files = F.expr("case tool_id % 8 when 0 then array('w') else cast(array() as array<string>) end")
    tags = K.capability_tags(F.col("envs"), calls, files, F.col("imports"))
    return rows.select("tool_id", *[F.array_join(c, ",").alias(n) for n, c in (("protocols", K.protocols(F.col("description"), F.col("imports"), F.col("envs"))), ("runtimes", K.runtimes(F.col("ecosystem"), F.col("description"), F.col("imports"))), ("tags", tags))])


def p42_derived_capabilities(spark, sf):
    found = [F.expr(f"case when tool_id % {n} = 0 then {some} else cast(array() as array<string>) end") for n, some in ((2, "array('A')"), (3, "array('HTTP')"), (5, "array('database', 'file_operations')"))]
    return tools(spark, sf).select("tool_id", F.array_join(K.derived_capabilities(*found), ",").alias("capabilities"))


def p26_p27_priority(spark, sf):
    rows = tools(spark, sf).withColumn("name", F.expr("case when tool_id % 10 = 3 then concat('@openai/', name) else name end")).withColumn("ecosystem", F.expr("case when tool_id % 8 = 0 then 'clawhub' else ecosystem end")).withColumn("downloads", F.expr("downloads % 2000"))
    alike = N.is_lookalike(F.col("name"), F.lit(TARGETS[0]))
    for t in TARGETS[1:]:
        alike = alike | N.is_lookalike(F.col("name"), F.lit(t))
    priority = K.scan_priority(F.col("ecosystem"), alike, G.in_scope(F.col("name")), F.col("downloads"))
    return rows.groupBy(priority.alias("priority"), G.about_ai(F.concat_ws(" ", "name", "description")).alias("ai")).agg(F.count("*").alias("tools"))


def install_commands(spark, sf):
    rows = tools(spark, sf).selectExpr("tool_id", "name", "case tool_id % 5 when 0 then 'clawhub' when 1 then 'mcp' when 2 then 'npm' when 3 then 'pypi' else 'github' end as ecosystem", "case tool_id % 3 when 0 then null when 1 then '' else '1.2' end as version")
    return rows.select("tool_id", K.install_command(F.col("ecosystem"), F.col("name"), F.col("version")).alias("command"))


def diff_summaries(spark, sf):
    rows = tools(spark, sf)
    return rows.select("tool_id", K.diff_summary(F.col("stars"), F.col("tool_id") % 7, F.col("tool_id") % 3, F.col("risk_score"), F.col("stars")).alias("summary"))


#: Packages and evidence, and the patterns that come of them.
EVIDENT = [("a.b", "eval\\(", "eval\\("), ("a.b", "eval(", "(import\\s+a\\.b|require\\s*\\(\\s*['\\\"](a\\.b)['\\\"])"), ("my-x", "plain", "(import\\s+my\\-x|require\\s*\\(\\s*['\\\"](my\\-x)['\\\"])"), ("y", None, "(import\\s+y|require\\s*\\(\\s*['\\\"](y)['\\\"])"), ("z", "^os$", "^os$")]


def p36_evidence_patterns(spark, sf):
    row = F.expr(f"cast(p_partkey % {len(EVIDENT)} as int)")
    package, evidence = (F.get(F.array(*[F.lit(e[k]) for e in EVIDENT]), row) for k in (0, 1))
    return read(spark, sf, "part").select("p_partkey", K.evidence_pattern(package, evidence).alias("pattern"))


def p30_ecosystems(spark, sf):
    given = F.element_at(F.array(*map(F.lit, ["ClawHub", "skill", "GitHub", "MCP", "npm", "PyPI"])), (F.col("scan_id") % 6 + 1).cast("int"))
    return frame(spark, sf, "findings").groupBy(given.alias("given"), N.ecosystem(given).alias("ecosystem")).agg(F.count("*").alias("findings"))


def trust_scores(spark, sf):
    rows = tools(spark, sf).selectExpr("*", "cast(tool_id % 14 as int) as forks", "case tool_id % 4 when 0 then null when 1 then 'unknown' else '1.0' end as version", "cast(tool_id % 9 as int) as issues")
    return rows.select(
        "tool_id", F.greatest(F.lit(0), 100 - 5 * F.col("risk_score")).alias("strict"), F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("risk_score"))).alias("plain"),
        F.round(M.collected_trust(*map(F.col, ("stars", "downloads", "forks", "version", "issues"))), 6).alias("collected"),
    )


_LOOKALIKE = """low <> target AND (levenshtein(low, target) <= 2 OR ((starts_with(low, target || '-') OR ends_with(low, '-' || target)) AND length(replace(replace(replace(low, target, ''), '-', ''), '_', '')) > 0 AND ({tries})))""".format(
    tries=" OR ".join(f"(contains(low, '{a}') AND levenshtein(replace(low, '{a}', '{b}'), target) <= 1)" for a, b in N.CONFUSABLES.items())
)
def _words_sql(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_TOOL_CASE = "CASE " + " ".join(f"WHEN {_words_sql('lower(name)', names)} OR {_words_sql('lower(description)', said)} THEN '{c}'" for c, names, said in K.TOOL_TERMS) + " ELSE 'code_tools' END"
_SAID_CASE = "CASE " + " ".join(f"WHEN {_words_sql('lower(description)', words)} THEN '{c}'" for c, words in K.DESCRIBED.items()) + " ELSE 'Uncategorized' END"
_PROTOCOL_LIST = ", ".join(f"CASE WHEN {_words_sql('t', words)} THEN '{p}' END" for p, words in K.PROTOCOL_TERMS.items())


def _rows_sql(rows, columns):
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) {columns}"


def _list_sql(items):
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"


_METRICS = "(SELECT user_id % 200 + 1 AS tool_id, ts, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS downloads, event_id % 13 AS stars FROM events)"
_TRENDING = f"""WITH p AS (SELECT tool_id, avg(downloads) FILTER (ts >= TIMESTAMP '2024-01-16') AS n, coalesce(avg(downloads) FILTER (ts < TIMESTAMP '2024-01-16'), 0) AS b, coalesce(avg(stars) FILTER (ts >= TIMESTAMP '2024-01-16'), 0) AS s FROM {_METRICS} GROUP BY 1),
g AS (SELECT p.*, 100 - risk_score AS trust, CASE WHEN b = 0 THEN CASE WHEN n > 0 THEN 100 ELSE 0 END WHEN n = 0 THEN -100 ELSE (n - b) * 100 / b END AS g FROM p JOIN {TOOLS} t ON p.tool_id = t.tool_id WHERE n IS NOT NULL),
r AS (SELECT tool_id, round((n / max(n) OVER () * 0.4::DOUBLE + greatest(0, least(1, (g + 100) / 600::DOUBLE)) * 0.3::DOUBLE + s / max(s) OVER () * 0.2::DOUBLE + trust / 100::DOUBLE * 0.1::DOUBLE) * 100, 4) AS score, round(g, 4) AS growth, b, n FROM g)"""

_VARS, _PROTS, _CAPS = _own_sql("tool_id", VARIABLES, 11), _own_sql("tool_id", PROTOCOLS, 13), _own_sql("tool_id", CAPABILITIES, 17)
_CATEGORY = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items()) + " END"


def _pairs_sql(fits):
    return ", ".join(f"('{have}', '{want}')" for have, wants in fits.items() for want in wants)


_SETS = "WITH o AS ({of}), s AS (SELECT tool_id, list_sort(list(v)) AS s FROM o GROUP BY 1), c AS (SELECT CAST(to_json(s) AS VARCHAR) AS class, s, count(*) AS tools FROM s GROUP BY 2)"
_FITTING = """SELECT a.class AS a, b.class AS b, round(least(count(*) * {each}::DOUBLE, {most}::DOUBLE), 6) AS score, max(a.tools) AS tools_a, max(b.tools) AS tools_b
FROM c a JOIN c b ON a.class <> b.class OR a.tools > 1 JOIN (VALUES {fits}) f(have, want) ON list_contains(a.s, have) AND list_contains(b.s, want) GROUP BY 1, 2"""
_SHARED = f"""SELECT a, b, round(n / CAST(greatest(na.n0, nb.n0) AS DOUBLE), 6) AS score FROM (SELECT x.tool_id AS a, y.tool_id AS b, count(*) AS n FROM ({_VARS}) x JOIN ({_VARS}) y ON x.v = y.v AND x.tool_id <> y.tool_id GROUP BY 1, 2)
JOIN (SELECT tool_id, count(*) AS n0 FROM ({_VARS}) GROUP BY 1) na ON na.tool_id = a JOIN (SELECT tool_id, count(*) AS n0 FROM ({_VARS}) GROUP BY 1) nb ON nb.tool_id = b WHERE n / CAST(greatest(na.n0, nb.n0) AS DOUBLE) >= 0.3"""


def _fits(of, fits, each, most):
    return f"SELECT x.tool_id AS a, y.tool_id AS b, round(least(count(*) * {each}::DOUBLE, {most}::DOUBLE), 6) AS score FROM ({of}) x JOIN (VALUES {_pairs_sql(fits)}) f(have, want) ON x.v = have JOIN ({of}) y ON y.v = want AND x.tool_id <> y.tool_id GROUP BY 1, 2"


QUERIES = {
    "j25_lookalikes": (j25_lookalikes, f"SELECT tool_id, target FROM (SELECT tool_id, replace(lower(name), '_', '-') AS low FROM {TOOLS}), {_TARGETS} WHERE {_LOOKALIKE}"),
    "j26_t9_lookalike_alerts": (
        j26_t9_lookalike_alerts,
        f"""WITH d AS (SELECT DISTINCT name, target, levenshtein(lower(name), target) AS d, round(1 - levenshtein(lower(name), target) / CAST(greatest(length(name), length(target)) AS DOUBLE), 6) AS s FROM {TOOLS}, {_TARGETS} WHERE lower(name) <> target)
SELECT name, target, CAST(d AS INTEGER) AS distance, s AS similarity, CASE WHEN d <= 2 AND s >= 0.7::DOUBLE THEN 'HIGH' WHEN d <= 3 AND s >= 0.6::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS level FROM d WHERE d <= 4 AND s >= 0.5::DOUBLE""",
    ),
    "variable_members": (variable_members, f"SELECT tool_id, CAST(to_json(list_sort(list(v))) AS VARCHAR) AS class FROM ({_VARS}) GROUP BY 1"),
    "protocol_members": (protocol_members, f"SELECT tool_id, CAST(to_json(list_sort(list(v))) AS VARCHAR) AS class FROM ({_PROTS}) GROUP BY 1"),
    "capability_members": (capability_members, f"SELECT tool_id, CAST(to_json(list_sort(list(v))) AS VARCHAR) AS class FROM ({_CAPS}) GROUP BY 1"),
    "j12_variable_classes": (
        j12_variable_classes,
        f"""{_SETS.format(of=_VARS)}
SELECT a.class AS a, b.class AS b, round(len(list_intersect(a.s, b.s)) / CAST(greatest(len(a.s), len(b.s)) AS DOUBLE), 6) AS score, a.tools AS tools_a, b.tools AS tools_b
FROM c a JOIN c b ON a.class <= b.class AND (a.class < b.class OR a.tools > 1) WHERE len(list_intersect(a.s, b.s)) / CAST(greatest(len(a.s), len(b.s)) AS DOUBLE) >= 0.3""",
    ),
    "j12_shared_variables": (j12_shared_variables, f"WITH p AS ({_SHARED}) SELECT a AS tool_id, count(*) AS matches, max(score) AS best FROM p GROUP BY 1"),
    "j13_protocol_classes": (j13_protocol_classes, f"{_SETS.format(of=_PROTS)} SELECT * FROM ({_FITTING.format(fits=_pairs_sql(M.PROTOCOL_FITS), each=0.4, most=0.8)})"),
    "j13_protocols": (j13_protocols, f"WITH p AS ({_fits(_PROTS, M.PROTOCOL_FITS, 0.4, 0.8)}) SELECT a AS tool_id, count(*) AS matches, max(score) AS best FROM p GROUP BY 1"),
    "j14_capability_classes": (j14_capability_classes, f"{_SETS.format(of=_CAPS)} SELECT * FROM ({_FITTING.format(fits=_pairs_sql(M.CAPABILITY_FITS), each=0.3, most=1.0)})"),
    "j14_complementary": (j14_complementary, f"WITH p AS ({_fits(_CAPS, M.CAPABILITY_FITS, 0.3, 1.0)}) SELECT a AS tool_id, count(*) AS matches, max(score) AS best FROM p GROUP BY 1"),
    "j16_best_matches": (
        j16_best_matches,
        f"""WITH t AS (SELECT tool_id, ecosystem, {_CATEGORY} AS category, greatest(0, 100 - risk_score * 5)::DOUBLE AS trust FROM {TOOLS}), r(c, related) AS (VALUES {_pairs_sql(M.CATEGORY_FITS)}),
p AS ({_SHARED} UNION ALL {_fits(_PROTS, M.PROTOCOL_FITS, 0.4, 0.8)} UNION ALL {_fits(_CAPS, M.CAPABILITY_FITS, 0.3, 1.0)}
 UNION ALL SELECT x.tool_id, y.tool_id, CAST(CASE WHEN x.ecosystem <> y.ecosystem THEN 0.6 ELSE 0.4 END AS DOUBLE) FROM t x JOIN r ON x.category = c JOIN t y ON y.category = related),
v AS (SELECT a, b, max(round(score * (x.trust + y.trust) / 2, 6)) AS value FROM p JOIN t x ON x.tool_id = a JOIN t y ON y.tool_id = b WHERE a <> b GROUP BY 1, 2)
SELECT a, b, value, CAST(row_number() OVER (PARTITION BY a ORDER BY value DESC, b) AS INTEGER) AS rank FROM v QUALIFY rank <= 20""",
    ),
    "j15_category_match": (
        j15_category_match,
        f"""WITH t AS (SELECT tool_id, ecosystem, {_CATEGORY} AS category FROM {TOOLS}), r(c, related) AS (VALUES {_pairs_sql(M.CATEGORY_FITS)})
SELECT x.tool_id AS a, y.tool_id AS b, CAST(CASE WHEN x.ecosystem <> y.ecosystem THEN 0.6 ELSE 0.4 END AS DOUBLE) AS score FROM t x JOIN r ON x.category = c JOIN t y ON y.category = related AND x.tool_id <> y.tool_id QUALIFY row_number() OVER (PARTITION BY x.tool_id ORDER BY CASE WHEN x.ecosystem <> y.ecosystem THEN 0.6 ELSE 0.4 END DESC, y.tool_id) <= 10""",
    ),
    "j17_tool_matches": (
        j17_tool_matches,
        f"""WITH m AS (SELECT l_partkey % 500 AS a, l_suppkey * 7 % 500 AS b, max(round(l_discount * 10, 4)) AS score FROM lineitem WHERE l_partkey % 500 <> l_suppkey * 7 % 500 GROUP BY 1, 2)
SELECT b, a, score, x.name AS primary_name, y.name AS secondary_name FROM m JOIN {TOOLS} x ON x.tool_id = a JOIN {TOOLS} y ON y.tool_id = b""",
    ),
    "t11_stack": (
        t11_stack,
        f"""WITH f AS (SELECT category, tool_id, 100 - risk_score AS trust FROM {TOOLS} QUALIFY row_number() OVER (PARTITION BY category ORDER BY stars DESC, tool_id) <= 5)
SELECT category, tool_id, trust FROM f WHERE trust >= 70 QUALIFY row_number() OVER (PARTITION BY category ORDER BY trust DESC, tool_id) = 1""",
    ),
    "j11_w4_trending": (j11_w4_trending, f"{_TRENDING} SELECT tool_id, score, growth, CASE WHEN growth >= 25 THEN 'up' WHEN growth <= -25 THEN 'down' ELSE 'stable' END AS direction FROM r"),
    "w3_w8_ranks": (
        w3_w8_ranks,
        f"""{_TRENDING}, t AS (SELECT tool_id, score, growth, b, n, row_number() OVER (ORDER BY score DESC, tool_id) AS rank FROM r QUALIFY rank <= 30),
c AS (SELECT user_id % 200 + 1 AS tool_id, event_id * 7 % 40 + 1 AS previous FROM events WHERE ts + INTERVAL 12 DAY > TIMESTAMP '2024-01-31' AND ts < TIMESTAMP '2024-01-31 23:00:00' QUALIFY row_number() OVER (PARTITION BY user_id % 200 + 1 ORDER BY ts, event_id * 7 % 40) = 1),
d AS (SELECT t.*, previous, coalesce(previous - rank, 0) AS change FROM t LEFT JOIN c ON c.tool_id = t.tool_id)
SELECT tool_id, score, rank, previous, change, CASE WHEN b = 0 AND n > 0 THEN 'new' WHEN growth >= 25 OR change > 0 THEN 'up' WHEN growth <= -25 OR change < 0 THEN 'down' ELSE 'stable' END AS direction FROM d""",
    ),
    "w11_latest_metrics": (w11_latest_metrics, f"SELECT tool_id, CAST(ts AS DATE) AS date, downloads, stars FROM {_METRICS} QUALIFY row_number() OVER (PARTITION BY tool_id ORDER BY CAST(ts AS DATE) DESC, downloads DESC, stars DESC) = 1"),
    "a35_pattern_groups": (
        a35_pattern_groups,
        f"""WITH d AS (SELECT *, {DESCRIPTION} AS description FROM {FINDINGS}), s AS (SELECT rule, severity, count(*) AS n, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS k FROM d GROUP BY 1, 2), f AS (SELECT rule, count(DISTINCT file) AS files, count(*) AS total FROM d GROUP BY 1),
w AS (SELECT rule, word, count(*) AS n FROM (SELECT rule, unnest(list_distinct(regexp_extract_all(lower(description), '\\w+'))) AS word FROM d) WHERE length(word) >= 4 AND word NOT IN ({", ".join(f"'{x}'" for x in M.STOP_WORDS)}) GROUP BY 1, 2),
c AS (SELECT w.rule, string_agg(word, ',' ORDER BY word) AS common FROM w JOIN f ON f.rule = w.rule WHERE n >= total * 0.5 GROUP BY 1)
SELECT s.rule, CAST(sum(n) AS BIGINT) AS findings, max(files) AS files, arg_max(severity, k) AS worst, coalesce(max(common), '') AS common, string_agg(severity || '=' || CAST(n AS VARCHAR), ',' ORDER BY k DESC) AS severities FROM s JOIN f ON s.rule = f.rule LEFT JOIN c ON c.rule = s.rule GROUP BY 1""",
    ),
    "j29_root_cause": (
        j29_root_cause,
        f"""WITH f AS (SELECT *, row_number() OVER () AS i, list_distinct(regexp_extract_all(lower({EVIDENCE}), '\\w+')) AS words FROM {FINDINGS}),
p AS (SELECT x.scan_id, x.phase, CASE WHEN x.file = y.file THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN abs(x.line - y.line) < 50 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN x.severity = y.severity THEN 0.1 ELSE 0 END::DOUBLE
  + 0.4::DOUBLE * coalesce(len(list_intersect(x.words, y.words)) / CAST(len(x.words) + len(y.words) - len(list_intersect(x.words, y.words)) AS DOUBLE), 0) AS s FROM f x JOIN f y ON x.scan_id = y.scan_id AND x.phase = y.phase AND x.i < y.i)
SELECT g.scan_id, g.phase, n AS findings, coalesce(round(CASE WHEN m > 1 THEN 1 ELSE m END, 6), 0) AS similarity FROM (SELECT scan_id, phase, count(*) AS n FROM f GROUP BY 1, 2) g LEFT JOIN (SELECT scan_id, phase, avg(s) AS m FROM p GROUP BY 1, 2) p ON p.scan_id = g.scan_id AND p.phase = g.phase""",
    ),
    "p28_p42_tool_category": (p28_p42_tool_category, f"SELECT tool_id, {_TOOL_CASE} AS category, {_SAID_CASE} AS described FROM {TOOLS}"),
    "p28_p42_told_categories": (p28_p42_told_categories, f"SELECT p_partkey, category, described FROM part JOIN {_rows_sql([(k, *c[2:]) for k, c in enumerate(CATEGORIZED)], 'c(k, category, described)')} ON p_partkey % {len(CATEGORIZED)} = k"),
    "p46_tags": (
        p46_tags,
        f"""WITH b AS (SELECT tool_id, tool_id % 4 AS e, CASE WHEN tool_id % 6 = 0 THEN description || ' in Docker' ELSE description END AS description, {_IMPORTS.replace("array(", "list_value(").replace("else list_value()", "else list_value()::VARCHAR[]")} AS imports, {_ENVS.replace("array(", "list_value(").replace("else list_value()", "else list_value()::VARCHAR[]")} AS envs FROM {TOOLS}),
x AS (SELECT *, lower(description || ' ' || array_to_string(imports, ' ') || ' ' || array_to_string(envs, ' ')) AS t FROM b)
SELECT tool_id, {_list_sql(_PROTOCOL_LIST)} AS protocols, {_list_sql("CASE WHEN e = 0 OR e > 1 AND tool_id % 7 IN (0, 2) THEN 'python' END, CASE WHEN e = 1 OR e > 1 AND tool_id % 7 IN (1, 2) THEN 'node' END, CASE WHEN tool_id % 6 = 0 THEN 'docker' END")} AS runtimes,
 {_list_sql("CASE WHEN tool_id % 5 < 2 THEN 'reads_env_vars' END, CASE WHEN tool_id % 3 < 2 THEN 'makes_network_calls' END, CASE WHEN tool_id % 8 = 0 THEN 'accesses_filesystem' END, CASE WHEN tool_id % 7 = 2 THEN 'requires_database' END, CASE WHEN tool_id % 3 = 0 THEN 'makes_http_calls' END")} AS tags FROM x""",
    ),
    "p42_derived_capabilities": (p42_derived_capabilities, f"SELECT tool_id, {_list_sql("CASE WHEN tool_id % 2 = 0 THEN 'requires_env_vars:1.0' END, CASE WHEN tool_id % 3 = 0 THEN 'makes_network_calls:1.0' END, CASE WHEN tool_id % 5 = 0 THEN 'accesses_database:0.8' END, CASE WHEN tool_id % 5 = 0 THEN 'reads_files:0.8' END")} AS capabilities FROM {TOOLS}"),
    "install_commands": (install_commands, f"SELECT tool_id, CASE tool_id % 5 WHEN 0 THEN 'npx skills add ' || name || CASE WHEN tool_id % 3 = 2 THEN '@1.2' ELSE '' END WHEN 1 THEN '# Add to claude_desktop_config.json: ' || name WHEN 2 THEN 'npm install ' || name || CASE WHEN tool_id % 3 = 2 THEN '@1.2' ELSE '' END WHEN 3 THEN 'pip install ' || name || CASE WHEN tool_id % 3 = 2 THEN '==1.2' ELSE '' END ELSE '# Install ' || name || ' from github' END AS command FROM {TOOLS}"),
    "diff_summaries": (diff_summaries, f"SELECT tool_id, format('{{}} new, {{}} resolved, {{}} unchanged (score: {{}} → {{}}, {{}}{{}})', stars, tool_id % 7, tool_id % 3, risk_score, stars, CASE WHEN stars >= risk_score THEN '+' ELSE '' END, stars - risk_score) AS summary FROM {TOOLS}"),
    "p36_evidence_patterns": (p36_evidence_patterns, f"SELECT p_partkey, pattern FROM part JOIN {_rows_sql([(k, e[2]) for k, e in enumerate(EVIDENT)], 'e(k, pattern)')} ON p_partkey % {len(EVIDENT)} = k"),
    "p26_p27_priority": (
        p26_p27_priority,
        f"""WITH t AS (SELECT tool_id, CASE WHEN tool_id % 10 = 3 THEN '@openai/' || name ELSE name END AS name, description, CASE WHEN tool_id % 8 = 0 THEN 'clawhub' ELSE ecosystem END AS ecosystem, downloads % 2000 AS downloads FROM {TOOLS}),
l AS (SELECT DISTINCT tool_id FROM (SELECT tool_id, replace(lower(name), '_', '-') AS low FROM t), {_TARGETS} WHERE {_LOOKALIKE})
SELECT CASE WHEN l.tool_id IS NOT NULL THEN 'critical' WHEN ecosystem = 'clawhub' OR ecosystem = 'npm' AND starts_with(name, '@openai/') OR downloads > 1000 THEN 'high' ELSE 'normal' END AS priority, {_words_sql("lower(name || ' ' || description)", G.AI_WORDS)} AS ai, count(*) AS tools FROM t LEFT JOIN l ON l.tool_id = t.tool_id GROUP BY 1, 2""",
    ),
    "p30_ecosystems": (p30_ecosystems, f"SELECT given, ecosystem, count(*) AS findings FROM {FINDINGS} JOIN (VALUES (0, 'ClawHub', 'skills'), (1, 'skill', 'skills'), (2, 'GitHub', 'mcps'), (3, 'MCP', 'mcps'), (4, 'npm', 'npm'), (5, 'PyPI', 'pypi')) e(k, given, ecosystem) ON scan_id % 6 = k GROUP BY 1, 2"),
    "trust_scores": (
        trust_scores,
        f"""WITH t AS (SELECT tool_id, risk_score, stars, downloads, tool_id % 14 AS forks, tool_id % 9 AS issues, tool_id % 4 > 1 AS told FROM {TOOLS})
SELECT tool_id, greatest(0, 100 - 5 * risk_score) AS strict, greatest(0, least(100, 100 - risk_score)) AS plain,
 round(least(100, least(30, stars / 10::DOUBLE) + least(25, downloads / 100::DOUBLE) + least(20, forks * 2) + CASE WHEN told THEN 15 ELSE 0 END + CASE WHEN stars > 0 AND issues / stars::DOUBLE < 0.1 THEN 10 ELSE 0 END), 6) AS collected FROM t""",
    ),
}
