"""Severity, phase and verdict expressions. All take and give columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores of severities, weights of phases, context weights and thresholds.
CLI_SEVERITY = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 5}
API_SEVERITY = {"INFO": 0.0, "LOW": 1.0, "MEDIUM": 2.0, "HIGH": 3.0, "CRITICAL": 5.0}
SECURITY_SEVERITY = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "LOW": 1}
COMPLIANCE_SEVERITY = {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 2, "LOW": 1}
RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
PHASE_WEIGHTS = {
    "install_hooks": 10.0,
    "code_patterns": 5.0,
    "network_exfil": 3.0,
    "credentials": 2.0,
    "obfuscation": 5.0,
    "provenance": 2.0,
    "prompt_injection": 10.0,
    "skill_security": 5.0,
}
DOC_MARKS = ["readme", "doc/", "docs/", ".md", ".rst", ".txt", "changelog", "contributing"]
TEST_MARKS = ["test/", "tests/", "spec/", ".test.", "spec.", "__test__", "__tests__", "test_", "_test.py"]
CLI_CUTS = ((25, "HIGH_RISK"), (10, "MEDIUM_RISK"))
API_CUTS = ((50, "CRITICAL_RISK"), (25, "HIGH_RISK"), (10, "MEDIUM_RISK"))
LABELS = {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "MODERATE": "MEDIUM", "MEDIUM": "MEDIUM", "LOW": "LOW"}


def lookup(key: Column, values: dict, default=None) -> Column:
    """The value of a small fixed table, as a chain of conditions that code generation keeps in one stage."""
    chain = reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), values.items(), F)
    return chain if default is None else chain.otherwise(F.lit(default))


def contains_any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks], F.lit(False))


def context_weight(path: Column) -> Column:
    """0.1 for vendored, 0.2 for documentation, 0.3 for test paths, in that order, else 1."""
    low = F.lower(path)
    return (
        F.when(low.contains("node_modules/"), 0.1).when(contains_any(low, DOC_MARKS), 0.2).when(contains_any(low, TEST_MARKS), 0.3).otherwise(1.0)
    )


def cli_score(severity: Column, weight: Column) -> Column:
    return lookup(severity, CLI_SEVERITY, 0) * weight


def api_score(severity: Column, phase: Column, weight: Column, path: Column) -> Column:
    return lookup(severity, API_SEVERITY, 1.0) * lookup(phase, PHASE_WEIGHTS, 1.0) * weight * context_weight(path)


def verdict(score: Column, cuts=API_CUTS) -> Column:
    return reduce(lambda c, cut: c.when(score >= cut[0], cut[1]), cuts, F).otherwise("LOW_RISK")


def adjusted_severity(severity: Column, path: Column) -> Column:
    """One or more steps down in documentation and tests."""
    low = F.lower(path)
    docs = lookup(severity, {"CRITICAL": "MEDIUM", "HIGH": "LOW", "MEDIUM": "LOW"})
    tests = lookup(severity, {"CRITICAL": "HIGH", "HIGH": "MEDIUM"})
    return F.when(contains_any(low, DOC_MARKS), F.coalesce(docs, severity)).when(contains_any(low, TEST_MARKS), F.coalesce(tests, severity)).otherwise(severity)


def confidence(severity: Column, path: Column) -> Column:
    quiet = contains_any(F.lower(path), [*DOC_MARKS, *TEST_MARKS, "node_modules/"])
    return F.when(quiet, "LOW").when(severity == "CRITICAL", "HIGH").otherwise("MEDIUM")


def advisory_severity(identifier: Column, label: Column, base: Column) -> Column:
    """Of an advisory: malware first, then its label, then its base score, else high."""
    by_score = F.when(base >= 9, "CRITICAL").when(base >= 7, "HIGH").when(base >= 4, "MEDIUM").when(base >= 0, "LOW")
    return F.when(identifier.startswith("MAL-"), "CRITICAL").otherwise(F.coalesce(lookup(F.upper(label), LABELS), by_score, F.lit("HIGH")))


def cvss3(vector: Column) -> Column:
    """The base score of a CVSS 3 vector, rounded up to a tenth; null where a metric is missing or unknown."""
    # the vector is parsed once; the score is computed from the parsed parts
    return F.transform(F.array(F.str_to_map(vector, F.lit("/"), F.lit(":"))), lambda parts: _cvss3(vector, parts))[0]


def _cvss3(vector: Column, parts: Column) -> Column:
    def metric(name, values):
        return lookup(F.try_element_at(parts, F.lit(name)), values)

    # The metric weights of the CVSS 3 specification.
    impact = {"H": 0.56, "L": 0.22, "N": 0.0}
    changed = metric("S", {"C": True, "U": False})
    access, difficulty = metric("AV", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}), metric("AC", {"L": 0.77, "H": 0.44})
    privileges = F.when(changed, metric("PR", {"N": 0.85, "L": 0.68, "H": 0.5})).otherwise(metric("PR", {"N": 0.85, "L": 0.62, "H": 0.27}))
    isc = 1 - (1 - metric("C", impact)) * (1 - metric("I", impact)) * (1 - metric("A", impact))
    part = F.when(changed, 7.52 * (isc - 0.029) - 3.25 * F.pow(isc - 0.02, 15)).otherwise(6.42 * isc)
    ease = 8.22 * access * difficulty * privileges * metric("UI", {"N": 0.85, "R": 0.62})
    total = F.least(F.when(changed, 1.08 * (part + ease)).otherwise(part + ease), F.lit(10.0))
    up = F.ceil(F.round(total * 10, 6)) / 10
    whole = changed.isNotNull() & part.isNotNull() & ease.isNotNull()
    return F.when(whole & vector.startswith("CVSS:3"), F.when(part <= 0, 0.0).otherwise(up))
