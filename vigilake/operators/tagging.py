"""What findings and descriptions say of a tool: capabilities, signals, patterns and compliance names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import contains_any

# The phase and the words of a snippet, and the words of a description, that tell a capability.
SNIPPET_CAPABILITIES = {
    "authentication": ("credentials", ["env", "password"]), "network": ("network_exfil", ["fetch", "http"]), "database": (None, ["database", "sql"]), "security": (None, ["security", "audit"]), "code": (None, ["code", "eval"]),
}
DESCRIPTION_CAPABILITIES = {
    "database": ["database", "sql", "postgres", "mysql"], "ai_llm": ["ai", "gpt", "llm", "assistant"], "authentication": ["auth", "login", "password"], "network": ["network", "http", "api", "fetch"],
    "security": ["security", "audit", "scan"], "code": ["code", "programming", "development"],
}
#: Variables by the first of these words in a snippet of the credentials phase.
VARIABLE = r"(?i)(AWS_|GITHUB_|API_KEY|SECRET|TOKEN|PASSWORD|DATABASE_URL|REDIS_URL)"
PROTOCOLS = {"HTTP": ["http", "fetch", "axios", "request("], "Webhook": ["webhook"], "WebSocket": ["socket"], "gRPC": ["grpc"]}
IMPORTS = {"database": ["psycopg", "pymongo", "redis", "mysql", "sqlite"], "http_client": ["requests", "httpx", "axios", "fetch"], "file_operations": ["pathlib", "os.path", "fs.", "file"]}
#: Compliance pattern of a rule, the first whose name stands in it, else of its phase.
RULE_PATTERNS = {
    "INSTALL_HOOK_NPM": "npm_install_hook", "INSTALL_HOOK_PIP": "pypi_setup_hook", "SQL_INJECTION": "sql_injection", "COMMAND_INJECTION": "command_injection", "XSS_REFLECTED": "xss_reflected",
    "XSS_STORED": "xss_stored", "PATH_TRAVERSAL": "path_traversal", "HARDCODED_SECRET": "hardcoded_secret", "EVAL_USAGE": "eval_usage", "DESERIALIZATION": "deserialization", "WEAK_CRYPTO": "weak_crypto",
    "MISSING_AUTH": "missing_auth", "CREDENTIAL_ACCESS": "credential_theft", "NETWORK_EXFIL": "network_exfiltration", "BACKDOOR": "backdoor", "OBFUSCATION": "obfuscation",
}
PHASE_PATTERNS = {"install_hooks": "npm_install_hook", "code_patterns": "eval_usage", "network": "network_exfiltration", "credentials": "credential_theft", "obfuscation": "obfuscation"}


def capabilities(tools: DataFrame, findings: DataFrame) -> DataFrame:
    """tool_id, capabilities (sorted array) of tools(tool_id, description) with findings(tool_id, phase, snippet); tools without any have an empty one."""
    low, phase = F.lower(F.coalesce("snippet", F.lit(""))), F.coalesce("phase", F.lit(""))
    told = [F.when((phase == F.lit(p or "-")) | contains_any(low, words), F.lit(tag)) for tag, (p, words) in SNIPPET_CAPABILITIES.items()]
    by_finding = findings.select("tool_id", F.explode(F.array_compact(F.array(*told))).alias("tag"))
    said = F.lower(F.coalesce("description", F.lit("")))
    by_text = tools.select("tool_id", F.explode(F.array_compact(F.array(*[F.when(contains_any(said, words), F.lit(tag)) for tag, words in DESCRIPTION_CAPABILITIES.items()]))).alias("tag"))
    tags = by_finding.unionByName(by_text).groupBy("tool_id").agg(F.array_sort(F.collect_set("tag")).alias("capabilities"))
    return tools.select("tool_id").join(tags, "tool_id", "left").select("tool_id", F.coalesce("capabilities", F.array().cast("array<string>")).alias("capabilities"))


def compatibility_signals(findings: DataFrame) -> DataFrame:
    """tool_id, signals (array): variables read in the credentials phase in the order of seq, the number of network endpoints, and what the variables fit.

    findings have tool_id, seq, phase, snippet. A tool's variables are gathered in one row, as the signal lists them.
    """
    after = F.regexp_extract("snippet", r"process\.env\.\s*(\S+?)(?=\s|$|process\.env\.)", 1)
    name = F.when((F.col("phase") == "credentials") & (after != ""), F.regexp_replace(after, r"[,);]+$", ""))
    rows = findings.select("tool_id", F.when(name.isNotNull(), F.struct("seq", name.alias("name"))).alias("v"), (F.col("phase") == "network_exfil").cast("int").alias("e"))
    by = rows.groupBy("tool_id").agg(F.transform(F.array_sort(F.collect_list("v")), lambda x: x["name"]).alias("names"), F.sum("e").alias("endpoints"))
    fits = F.exists("names", lambda n: n.contains("DATABASE") | n.contains("POSTGRES"))
    signals = F.array(
        F.when(F.size("names") > 0, F.concat(F.lit("env_vars:"), F.array_join("names", ","))), F.when(F.col("endpoints") > 0, F.concat(F.lit("network:"), F.col("endpoints").cast("string"), F.lit("_endpoints"))), F.when(fits, F.lit("database:postgres_compatible"))
    )
    return by.select("tool_id", F.array_compact(signals).alias("signals")).where(F.size("signals") > 0)


def scan_patterns(findings: DataFrame) -> DataFrame:
    """tool_id, variables, protocols, imports (sorted arrays), risks (findings of MEDIUM or more) of findings(tool_id, phase, severity, snippet)."""
    snippet = F.coalesce("snippet", F.lit(""))
    low, phase = F.lower(snippet), F.col("phase")

    def of(table: dict[str, list[str]]) -> Column:
        return F.array_compact(F.array(*[F.when(contains_any(low, words), F.lit(tag)) for tag, words in table.items()]))

    none, variable = F.array().cast("array<string>"), F.regexp_extract(snippet, VARIABLE, 1)
    rows = findings.select(
        "tool_id", F.when((phase == "credentials") & (variable != ""), variable).alias("v"), F.when(phase == "network_exfil", of(PROTOCOLS)).otherwise(none).alias("p"),
        F.when(phase == "code_patterns", of(IMPORTS)).otherwise(none).alias("i"), F.col("severity").isin("MEDIUM", "HIGH", "CRITICAL").cast("long").alias("r"),
    )

    def distinct(arrays: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(arrays))))

    return rows.groupBy("tool_id").agg(F.array_sort(F.collect_set("v")).alias("variables"), distinct("p").alias("protocols"), distinct("i").alias("imports"), F.coalesce(F.sum("r"), F.lit(0)).alias("risks"))


def compliance_pattern(rule: Column, phase: Column) -> Column:
    low = F.lower(rule)
    chain = F
    for name, pattern in RULE_PATTERNS.items():
        chain = chain.when(low.contains(name.lower()), pattern)
    for name, pattern in PHASE_PATTERNS.items():
        chain = chain.when(phase == name, pattern)
    return chain.otherwise("unknown")


def canonical_json(value: Column) -> Column:
    """JSON of a struct or map whose fields are given in order of name, without blanks, of which equal values have the same bytes; nulls are written."""
    return F.to_json(value, {"ignoreNullFields": "false"})
