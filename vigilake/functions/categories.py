"""Categories, protocols and runtimes of tools by words, and texts made from fixed forms."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category, words of names, words of descriptions, in the order in which they are tried; parts of words count.
TOOL_TERMS = [
    ("database_connectors", ["postgres", "mysql", "redis", "mongo", "db", "database"], ["database", "redis", "sql", "postgres", "mysql"]),
    ("ai_llm_tools", ["gpt", "ai", "llm", "chat", "assistant"], ["gpt", "ai", "llm", "assistant", "chat"]),
    ("security_tools", ["security", "audit", "scan"], ["security", "audit", "vulnerabilit"]),
    ("api_integrations", ["api", "rest", "gateway"], ["api", "rest", "gateway"]),
    ("code_tools", ["lint", "format", "eslint", "code"], ["lint", "format", "code", "syntax"]),
    ("file_system_tools", ["file", "fs", "filesystem"], ["file", "filesystem", "directory"]),
    ("devops_tools", ["docker", "deploy", "k8s", "kubernetes"], ["deploy", "docker", "kubernetes"]),
    ("search_tools", ["search", "elastic", "solr"], ["search", "elastic", "index"]),
    ("communication_tools", ["slack", "discord", "chat", "bot"], ["slack", "discord", "communication"]),
    ("monitoring_tools", ["monitor", "datadog", "metrics"], ["monitor", "metrics", "observability"]),
    ("data_tools", ["etl", "data", "pipeline"], ["etl", "data", "pipeline"]),
    ("testing_tools", ["test", "jest", "pytest", "spec"], ["test", "testing", "jest", "pytest"]),
]
#: Where nothing is found.
OTHER_TOOLS = "code_tools"
# Categories by the description alone, in order.
DESCRIBED = {
    "Database": ["postgres", "mysql", "mongo", "redis", "database", "sql"],
    "API Integration": ["github", "slack", "stripe", "api", "rest", "webhook"],
    "Code Tools": ["lint", "test", "format", "compile", "build"],
    "File System": ["file", "filesystem", "git", "directory"],
    "AI/LLM": ["llm", "ai", "prompt", "embedding", "rag", "gpt", "claude"],
    "Security": ["security", "auth", "secret", "scan", "vulnerability"],
    "DevOps": ["deploy", "ci", "cd", "docker", "kubernetes", "monitoring"],
    "Communication": ["email", "chat", "notification", "message"],
    "Data Pipeline": ["etl", "pipeline", "analytics", "transform"],
    "Search": ["search", "index", "elastic", "solr"],
}
# Protocols by words of the description, imports and variables; imports that tell a runtime.
PROTOCOL_TERMS = {
    "http": ["http", "https", "rest", "api"],
    "postgres": ["postgres", "psycopg", "pg_"],
    "redis": ["redis"],
    "mongodb": ["mongo", "pymongo"],
    "mysql": ["mysql", "pymysql"],
    "websocket": ["websocket", "ws"],
    "grpc": ["grpc"],
    "ssh": ["ssh", "paramiko"],
    "ftp": ["ftp"],
}
PYTHON_IMPORTS, NODE_IMPORTS = ["requests", "fastapi", "flask", "django"], ["express", "axios", "node-fetch"]


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def tool_category(name: Column, description: Column) -> Column:
    """The first category of which a word stands in the name, or else in the description."""
    low, said = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    chain = F
    for category, names, words in TOOL_TERMS:
        chain = chain.when(_has(low, names) | _has(said, words), category)
    return chain.otherwise(OTHER_TOOLS)


def described_category(description: Column) -> Column:
    """The first category of which a word stands in the description; Uncategorized without one. Its confidence is always 0.6."""
    low, chain = F.lower(F.coalesce(description, F.lit(""))), F
    for category, words in DESCRIBED.items():
        chain = chain.when(_has(low, words), category)
    return chain.otherwise("Uncategorized")


def derived_capabilities(variables: Column, protocols: Column, imports: Column) -> Column:
    """Capabilities with their confidence ("name:1.0") from arrays of what a scan found."""
    found = [
        F.when(F.size(variables) > 0, "requires_env_vars:1.0"), F.when(F.size(protocols) > 0, "makes_network_calls:1.0"),
        F.when(F.array_contains(imports, "database"), "accesses_database:0.8"), F.when(F.array_contains(imports, "file_operations"), "reads_files:0.8"),
    ]
    return F.array_compact(F.array(*found))


def protocols(description: Column, imports: Column, variables: Column) -> Column:
    """Protocols of which a word stands in the description, imports or variables."""
    low = F.lower(F.concat_ws(" ", F.coalesce(description, F.lit("")), F.array_join(imports, " "), F.array_join(variables, " ")))
    return F.array_compact(F.array(*[F.when(_has(low, words), F.lit(p)) for p, words in PROTOCOL_TERMS.items()]))


def runtimes(ecosystem: Column, description: Column, imports: Column) -> Column:
    """python, node and docker, by the ecosystem; skills and mcp by what they import."""
    either = ecosystem.isin("skills", "mcp")
    python = (either & F.arrays_overlap(imports, F.lit(PYTHON_IMPORTS))) | (ecosystem == "pypi")
    node = (either & F.arrays_overlap(imports, F.lit(NODE_IMPORTS))) | (ecosystem == "npm")
    docker = F.lower(F.coalesce(description, F.lit(""))).contains("docker")
    return F.array_compact(F.array(F.when(python, "python"), F.when(node, "node"), F.when(docker, "docker")))


def capability_tags(variables: Column, calls: Column, files: Column, imports: Column) -> Column:
    """Tags from arrays of variables, network calls, file operations and imports."""
    found = [
        F.when(F.size(variables) > 0, "reads_env_vars"), F.when(F.size(calls) > 0, "makes_network_calls"), F.when(F.size(files) > 0, "accesses_filesystem"),
        F.when(F.exists(imports, lambda x: F.lower(x).contains("database")), "requires_database"), F.when(F.exists(calls, lambda x: F.lower(x).contains("http")), "makes_http_calls"),
    ]
    return F.array_compact(F.array(*found))


def install_command(ecosystem: Column, name: Column, version: Column) -> Column:
    """How a tool is installed; with its version where the ecosystem writes one."""
    known = F.coalesce(version, F.lit("")) != ""
    at = lambda sign: F.when(known, F.concat(F.lit(sign), version)).otherwise("")
    return (
        F.when(ecosystem == "clawhub", F.concat(F.lit("npx skills add "), name, at("@")))
        .when(ecosystem == "mcp", F.concat(F.lit("# Add to claude_desktop_config.json: "), name))
        .when(ecosystem == "npm", F.concat(F.lit("npm install "), name, at("@")))
        .when(ecosystem == "pypi", F.concat(F.lit("pip install "), name, at("==")))
        .otherwise(F.concat(F.lit("# Install "), name, F.lit(" from "), ecosystem))
    )


def diff_summary(new: Column, resolved: Column, unchanged: Column, before: Column, after: Column) -> Column:
    """What changed between two scans, in one line."""
    delta = after - before
    return F.concat(new.cast("string"), F.lit(" new, "), resolved.cast("string"), F.lit(" resolved, "), unchanged.cast("string"), F.lit(" unchanged (score: "), before.cast("string"), F.lit(" → "), after.cast("string"), F.lit(", "), F.when(delta >= 0, "+").otherwise(""), delta.cast("string"), F.lit(")"))


def _evidence_pattern(package: str | None, evidence: str | None) -> str:
    if any(c in (evidence or "") for c in r"[]()*+?{}|\^$"):
        try:
            re.compile(evidence)
            return evidence
        except re.error:
            pass
    name = re.escape(package or "")
    return rf"(import\s+{name}|require\s*\(\s*['\"]({name})['\"])"


def evidence_pattern(package: Column, evidence: Column) -> Column:
    """The evidence where it has signs of a pattern and can be compiled, else a pattern that finds the package being imported."""
    return F.udf(lambda p, e: _evidence_pattern(p, e), "string")(package, evidence)


def scan_priority(ecosystem: Column, alike: Column, scoped: Column, downloads: Column) -> Column:
    """critical, high or normal: look-alike names, skills of the hub, watched npm scopes, and over a thousand downloads a week, in this order."""
    return F.when(alike, "critical").when((ecosystem == "clawhub") | ((ecosystem == "npm") & scoped) | (downloads > 1000), "high").otherwise("normal")
