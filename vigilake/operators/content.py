"""Findings of rules in file contents, one for each match, with filters by what stands around it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity as S
from .context import COMMENT, QUOTED, bundled
from .rulescan import content_matched

# Words of which one must stand in a file before a costly rule is tried on it.
TOKEN_GATES = {
    "novel-polymorphic-deps": ["package.json", "dependencies", "write"],
    "novel-version-hijack": ["||"],
    "novel-git-url-hijack": ["git+", "#"],
    "novel-transitive-confusion": ["node_modules"],
    "novel-registry-redirect": ["registry", "publishConfig"],
    "novel-phantom-dependency": ["require.resolve", "catch"],
    "novel-dependency-swapping": ["Module._load", "require.cache"],
    "novel-template-injection": ["new Function", "${", "template"],
    "novel-macro-expansion": ["macro", "__macro__", "define"],
    "novel-source-map-poison": ["sourceMappingURL", "sourceMap"],
    "novel-ast-manipulation": ["parse", "AST", "transform"],
    "novel-webpack-plugin": ["webpack", "compiler", "Plugin"],
    "novel-babel-transform": ["babel", "transformSync", "preset"],
    "novel-wasm-payload": ["WebAssembly", "Uint8Array"],
    "novel-native-binding": [".node", "bindings", "napi"],
    "novel-ffi-boundary": ["ffi", "Foreign", "ctypes"],
    "novel-python-js-bridge": ["PythonShell", "python-shell", "pyodide"],
    "novel-rust-bridge": ["wasm_bindgen", "wasm-pack", "rustwasm"],
    "novel-jni-exploit": ["Java.type", "jni", "JNI"],
}
#: Rules that say nothing of a declaration file.
NOT_DECLARED = ["code-eval", "code-exec-dangerous", "code-exec-child-process", "install-pip-setup-exec"]
#: Lines on which exec or eval is declared, and not called.
DECLARATIONS = [
    r"\b(function|const|let|var)\s+(exec|eval)\b", r"\b(public|private|protected)\s+(exec|eval)\s*\(", r"\b(exec|eval)\s*:\s*function\b", r"\b(exec|eval)\s*\([^)]*\)\s*:\s*\w+", r"class .*\b(exec|eval)\s*\([^)]*\)\s*\{|\b(exec|eval)\s*\([^)]*\)\s*\{.*class ",
]
#: Lines on which a character is made from a number in a harmless way.
CHARACTERS = [r"String\.fromCharCode\s*\(\s*\d+\s*[+-]\s*\w+\s*\)", r"String\.fromCharCode\s*\(\s*\d{1,3}\s*\)", r"(?i)(col|column|char|letter).*String\.fromCharCode", r"chr\s*\(\s*\d{1,3}\s*\)"]
SAFE_DOMAINS = [
    "api.anthropic.com", "api.openai.com", "api.groq.com", "api.cohere.ai", "bedrock-runtime.us-east-1.amazonaws.com", "bedrock-runtime.us-west-2.amazonaws.com",
    "bedrock-runtime.eu-west-1.amazonaws.com", "bedrock-runtime.ap-southeast-2.amazonaws.com", "huggingface.co", "api.huggingface.co", "localhost", "127.0.0.1", "github.com", "api.github.com",
    "raw.githubusercontent.com", "registry.npmjs.org", "pypi.org", "pypi.python.org", "files.pythonhosted.org",
]
#: How prompts begin that ask about a matter.
QUESTIONS = ["how do i", "what is", "explain", "can you"]

_LINE = r"\r?\n"


def blanked(text: Column) -> Column:
    """The text with strings and comments as blanks, line by line as long as before."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{QUOTED}|{COMMENT}|[^'\"`/#]+|[\s\S]"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when((F.length(p) > 1) & p.rlike(r"^(['\"`#]|//|/\*)"), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)), "")


def gate(text: Column, rule: str) -> Column:
    """Whether a rule is tried on a text at all."""
    return S.contains_any(text, TOKEN_GATES[rule]) if rule in TOKEN_GATES else F.lit(True)


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def content_findings(files: DataFrame, rules: list[dict]) -> DataFrame:
    """path, line, offset, nth, rule, phase, severity, confidence, weight, description, snippet: one row for each match of a rule in files(path, text).

    rules: id, phase, severity, pattern, weight, description; a pattern sees the whole text, in any case of letters, its anchors at
    lines. A match counts for the line where it begins; offset is its place in the text from 0, nth counts a rule's matches of the line from 1, and the snippet is the line with
    the ones before and after, at most 500 characters. Some rules look at what
    stands around: code-eval passes over strings, comments and patterns between slashes, it and code-exec-dangerous over method calls and declarations, obf-charcode
    over single characters, net-http-request over known-safe domains within two lines. Severity and confidence go by the file.
    A gate of plain words is tried on the whole text before a rule. Bundled files and null texts have no findings.
    """
    text, path = F.col("text"), F.col("path")
    ids = [r["id"] for r in rules]
    gated = [i for i in ids if i in TOKEN_GATES]
    evals = "code-eval" in ids
    gates = F.filter(F.array(*[F.when(gate(text, g), F.lit(g)) for g in gated]), lambda x: x.isNotNull()) if gated else F.array().cast("array<string>")
    rows = files.where(text.isNotNull() & ~bundled(path, text)).select(
        "path", "text", gates.alias("__gates"), (F.when(F.lower(text).contains("eval"), blanked(text)) if evals else F.lit(None).cast("string")).alias("__live")
    )
    found = content_matched(rows, [r["pattern"] for r in rules], "text", "__live", {k for k, i in enumerate(ids) if i in ("code-eval", "code-exec-dangerous")}, {k for k, i in enumerate(ids) if i == "code-eval"})
    told = F.array(*[F.struct(F.lit(r["id"]).alias("rule"), F.lit(r["phase"]).alias("phase"), F.lit(r["severity"]).alias("given"), F.lit(float(r.get("weight", 1.0))).alias("weight"), F.lit(r.get("description", "")).alias("description")) for r in rules])
    hits = found.select("path", "__gates", F.col("__line").alias("line"), F.col("__offset").alias("offset"), F.col("__nth").alias("nth"), "__body", "__wide", F.col("__around").alias("snippet"), F.get(told, F.col("__rule")).alias("__r"))
    hits = hits.select(*[c for c in hits.columns if c != "__r"], "__r.*")
    rule, body = F.col("rule"), F.col("__body")
    domains = F.transform(F.regexp_extract_all("__wide", F.lit(r"https?://([^/\s'\"]+)"), 1), lambda d: F.lower(F.split(d, ":")[0]))
    passed = (rule.isin("code-eval", "code-exec-dangerous") & _any(body, DECLARATIONS)) | ((rule == "obf-charcode") & _any(body, CHARACTERS))
    passed = passed | ((rule == "net-http-request") & F.arrays_overlap(domains, F.lit(SAFE_DOMAINS))) | (rule.isin(NOT_DECLARED) & path.endswith(".d.ts"))
    passed = passed | (rule.isin(list(TOKEN_GATES)) & ~F.array_contains("__gates", rule))
    severity = S.adjusted_severity(F.col("given"), path)
    return hits.where(~passed).select("path", "line", "offset", "nth", "rule", "phase", severity.alias("severity"), S.confidence(severity, path).alias("confidence"), "weight", "description", "snippet")


def prompt_findings(prompts: DataFrame, rules: list[dict], key: str = "prompt_id") -> DataFrame:
    """key, line, nth, rule, severity, weight, snippet, likely_false for each match of a rule in prompts(key, text).

    likely_false: the prompt has a code block or begins as a question about the matter, or the line is wholly quoted or a comment.
    """
    text, line = F.coalesce("text", F.lit("")), F.trim(F.lower("body"))
    doubt = text.contains("```") | reduce(lambda a, b: a | b, [F.lower(text).startswith(q) for q in QUESTIONS])
    rows = prompts.select(key, doubt.alias("doubt"), F.posexplode(F.split(text, _LINE)).alias("at", "body"))
    found = [F.struct(F.lit(r["id"]).alias("rule"), F.lit(r["severity"]).alias("severity"), F.lit(float(r["weight"])).alias("weight"), F.size(F.regexp_extract_all("body", F.lit(f"(?i){r['pattern']}"), F.lit(0))).alias("n")) for r in rules]
    hits = rows.select(key, "doubt", "at", "body", F.explode(F.filter(F.array(*found), lambda x: x["n"] > 0)).alias("h"))
    quoted = (line.startswith('"') & line.endswith('"')) | line.rlike(r"^(#|//|/\*)")
    return hits.select(key, (F.col("at") + 1).alias("line"), F.explode(F.sequence(F.lit(1), F.col("h.n"))).alias("nth"), "h.rule", "h.severity", "h.weight", F.substring("body", 1, 500).alias("snippet"), (F.col("doubt") | quoted).alias("likely_false"))


def is_malicious_prompt(text: Column, rules: list[dict]) -> Column:
    """Whether any critical rule matches."""
    return reduce(lambda a, b: a | b, [text.rlike(f"(?i){r['pattern']}") for r in rules if r["severity"] == "CRITICAL"], F.lit(False))


# Weights of the phases for signatures from the cloud, and names that are read as a phase.
SIGNATURE_WEIGHTS = {"install_hooks": 10, "code_patterns": 5, "network_exfil": 3, "credentials": 2, "obfuscation": 5, "provenance": 1}


def signature_rules(rows: list) -> list[dict]:
    """Signatures(id, phase, severity, pattern, description) as rules for scan_lines; unknown phases count as code_patterns, unknown severities as LOW."""
    out = []
    for r in rows:
        phase, severity = (r["phase"] or "").lower().replace("-", "_"), (r["severity"] or "").upper()
        phase = phase if phase in SIGNATURE_WEIGHTS else "code_patterns"
        out.append({"id": r["id"], "phase": phase, "severity": severity if severity in S.RANK else "LOW", "pattern": r["pattern"], "description": r["description"] or "", "weight": SIGNATURE_WEIGHTS[phase]})
    return out


def by_phase_packs(packs: list[dict], phases: list[str]) -> list[dict]:
    """The rules that run when each of the phases runs all rules of every pack that has one rule of it, with "run" as the phase that runs them.

    A pack of rules of several phases is run once for each of them, so its findings repeat. packs: rules (a list of rules with phase).
    """
    return [rule | {"run": phase} for phase in phases for pack in packs if any(r["phase"] == phase for r in pack["rules"]) for rule in pack["rules"]]
