"""Expressions over package names and free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that stand in for others in look-alike names.
CONFUSABLES = {"0": "o", "1": "l", "3": "e", "5": "s", "7": "t", "l": "i", "rn": "m"}
#: Bidirectional controls; characters without width that are suspicious anywhere; private-use characters of planes 0, 15 and 16.
BIDI = "\\u202A-\\u202E\\u2066-\\u2069\\u200E\\u200F\\u061C"
ZERO_WIDTH = "\\u200B\\u2060\\u180E"
PRIVATE = "\\uE000-\\uF8FF\\x{F0000}-\\x{FFFFD}\\x{100000}-\\x{10FFFD}"
#: A joiner between two ASCII characters; elsewhere joiners belong to emoji and scripts.
JOINER = "(?<=[\\x00-\\x7F])[\\u200C\\u200D](?=[\\x00-\\x7F])"
BYTE_ORDER_MARK = "\ufeff"
#: Files that steer agents: by name, by the end of the name, by a folder on the way.
INSTRUCTION_FILES = ["claude.md", "agents.md", "skill.md", "gemini.md", "copilot-instructions.md"]
INSTRUCTION_ENDS = [".cursorrules", ".windsurfrules"]
INSTRUCTION_FOLDERS = [".claude/", ".cursor/", ".github/instructions/"]


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer length; 1 for two empty names."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def has_confusable(name: Column, target: Column) -> Column:
    """Whether undoing one kind of look-alike brings the name within one edit of the target."""
    cleaned = F.replace(F.replace(F.replace(name, target, F.lit("")), F.lit("-"), F.lit("")), F.lit("_"), F.lit(""))
    tries = [name.contains(a) & (F.levenshtein(F.replace(name, F.lit(a), F.lit(b)), target) <= 1) for a, b in CONFUSABLES.items()]
    return (F.length(cleaned) > 0) & reduce(lambda x, y: x | y, tries)


def is_lookalike(name: Column, target: Column) -> Column:
    low = F.replace(F.lower(name), F.lit("_"), F.lit("-"))
    affixed = low.startswith(F.concat(target, F.lit("-"))) | low.endswith(F.concat(F.lit("-"), target))
    return (low != target) & ((F.levenshtein(low, target) <= 2) | (affixed & has_confusable(low, target)))


def lookalike_level(distance: Column, likeness: Column) -> Column:
    """HIGH, MEDIUM, LOW or null."""
    return F.when((distance <= 2) & (likeness >= 0.7), "HIGH").when((distance <= 3) & (likeness >= 0.6), "MEDIUM").when((distance <= 4) & (likeness >= 0.5), "LOW")


#: Bytes of a snippet.
SNIPPET = 200


def snippet(text: Column, limit: int = SNIPPET) -> Column:
    """At most limit bytes of the trimmed text; a longer one is cut between characters and marked."""
    whole = F.trim(text)
    most = F.least(F.length(whole), F.lit(limit))
    fits = F.filter(F.sequence(F.greatest(most - (limit - limit // 4), F.lit(0)), most), lambda n: F.octet_length(F.substring(whole, F.lit(1), n)) <= limit)
    return F.when(F.octet_length(whole) <= limit, whole).otherwise(F.concat(F.trim(F.substring(whole, F.lit(1), F.array_max(fits))), F.lit(" ...")))


def decloaked(text: Column) -> Column:
    """Without bidirectional controls, zero-width characters, byte order marks and joiners between two ASCII characters.

    One pattern looks at the neighbours as they stand in the text, before anything is taken out.
    """
    return F.regexp_replace(text, f"[{BIDI}{ZERO_WIDTH}{BYTE_ORDER_MARK}]|{JOINER}", "")


def is_instruction_file(path: Column) -> Column:
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    tests = [name.isin(INSTRUCTION_FILES), *[name.endswith(x) for x in INSTRUCTION_ENDS], *[low.contains(x) for x in INSTRUCTION_FOLDERS]]
    return reduce(lambda a, b: a | b, tests)


def is_declaration_file(path: Column) -> Column:
    return F.lower(path).rlike(r"\.d\.[mc]?ts$|\.pyi$")


def sanitized(target: Column) -> Column:
    """Without script elements, script addresses and shell signs."""
    out = F.regexp_replace(target, r"(?is)<script[^>]*>.*?</script>", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)javascript:", ""), r"[;&|`$<>]", "")


def ecosystem(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.isin("clawhub", "skill"), "skills").when(low.isin("github", "mcp"), "mcps").otherwise(low)
