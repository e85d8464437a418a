"""Any number of rules over whole files.

Each pattern is asked for words of which one must stand in whatever it matches. An automaton of all words goes over a file once and
tells which rules to try on which lines; rules without such words are tried where an alternation of several of them
matches. So the time hardly grows with the number of rules. Rules are rows; they go to the tasks in blocks of a bounded number, and each further block
is one more pass over the files. Filters and suppression are column expressions over what was found.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import islice
from re import _constants as op
from re import _parser as parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from .scanning import RULES

#: Rules of a block, and rules without words in one alternation.
BLOCK, TOGETHER = 20_000, 40
#: Places of a match's beginning that are tried for one word, at most (of more, the line is searched), and classes of characters that are looked for by themselves.
NEAR, CLASSES = 8, 16
_CLOAKS = re.compile(f"[{N.BIDI}{N.ZERO_WIDTH}{N.BYTE_ORDER_MARK}]|{N.JOINER}")
#: Letters that match an ASCII letter in any case, but don't become it in lower case.
_ALIKE = str.maketrans({"ſ": "s", "ı": "i"})
_LEAST = 2
#: Beyond the end of any line.
_END = 1 << 40
_BETWEEN_SLASHES = re.compile("/.*eval.*/")


#: A word, or the source of a class of characters, with the least and the most characters of a match before it, none where that has no bound.
Placed = tuple[str, int, int | None]


def _before(tree, n: int) -> tuple[int, int | None]:
    """The least and the most characters that the first n items of a sequence match; none for more than a few between them."""
    low, high = tree[:n].getwidth()
    return low, high if high - low < NEAR else None


def _behind(found: tuple[Placed, ...], low: int, high: int | None) -> tuple[Placed, ...]:
    """Places in a part as places in the whole, where the part begins after so many characters."""
    return tuple((w, x + low, None if high is None or y is None or y + high - x - low >= NEAR else y + high) for w, x, y in found)


def _words_of(tree) -> tuple[Placed, ...]:
    """The alternatives of the longest words in a sequence that a match can't do without, and where in it they stand."""
    options: list[tuple[Placed, ...]] = []
    run, began = "", 0

    def flush() -> None:
        nonlocal run
        if len(run) >= _LEAST:
            options.append(((run, *_before(tree, began)),))
        run = ""

    for n, (code, arg) in enumerate(tree):
        if code is op.LITERAL and arg < 128:
            began = began if run else n
            run += chr(arg).lower()
            continue
        if code in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        flush()
        inner: tuple = ()
        if code is op.SUBPATTERN:
            inner = _words_of(arg[3])
        elif code is op.ATOMIC_GROUP:
            inner = _words_of(arg)
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = _words_of(arg[2])
        elif code is op.BRANCH:
            each = [_words_of(branch) for branch in arg[1]]
            inner = tuple(w for words in each for w in words) if all(each) else ()
        if inner:
            options.append(_behind(inner, *_before(tree, n)))
    flush()
    return max(options, key=lambda words: (min(len(w) for w, _, _ in words), -len(words)), default=())


def _class(code, arg) -> str | None:
    """The source of a class of ASCII characters that aren't letters, or of digits or white space, so case doesn't matter."""
    items = arg if code is op.IN else [(code, arg)]
    out = ""
    for kind, x in items:
        if kind is op.LITERAL and x < 128 and not chr(x).isalpha():
            out += re.escape(chr(x))
        elif kind is op.RANGE and x[1] < 128 and not any(chr(c).isalpha() for c in range(x[0], x[1] + 1)):
            out += f"{re.escape(chr(x[0]))}-{re.escape(chr(x[1]))}"
        elif kind is op.CATEGORY and x in (op.CATEGORY_DIGIT, op.CATEGORY_SPACE):
            out += r"\d" if x is op.CATEGORY_DIGIT else r"\s"
        else:
            return None
    return f"[{out}]"


def _run_of(tree) -> tuple[int, Placed] | None:
    """The longest run of characters of one class that a match can't do without: how many at least, the class, and where they stand; none where that has no bound."""
    best = None
    for n, (code, arg) in enumerate(tree):
        found = None
        if code is op.SUBPATTERN:
            found = _run_of(arg[3])
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0] > 0:
            found = (arg[0], (_class(*arg[2][0]), 0, 0)) if len(arg[2]) == 1 and _class(*arg[2][0]) else _run_of(arg[2])
        elif code in (op.IN, op.LITERAL) and _class(code, arg):
            found = (1, (_class(code, arg), 0, 0))
        if found:
            place = _behind((found[1],), *_before(tree, n))[0]
            if place[2] is not None and (best is None or found[0] > best[0]):
                best = found[0], place
    return best


def _parsed(pattern: str, find: Callable, none):
    try:
        return find(parser.parse(_scoped(pattern)))
    except (re.error, OverflowError, RecursionError):
        return none


def required_words(pattern: str) -> tuple[str, ...]:
    """Lower-case ASCII words of which one stands, in any case of letters, in all that the pattern matches; none where that can't be told."""
    return tuple(sorted({w for w, _, _ in _parsed(pattern, _words_of, ())}))


def _scoped(pattern: str) -> str:
    """The pattern with flags at its beginning set around it, and signs that other engines write in another way."""
    flags = re.match(r"\(\?([aimsx]+)\)", pattern)
    if flags:
        pattern = f"(?{flags[1]}:{pattern[flags.end():]})"
    return re.sub(r"(?<!\\)((?:\\\\)*)\\x\{([0-9A-Fa-f]+)\}", lambda m: m[1] + re.escape(chr(int(m[2], 16))), re.sub(r"(?<!\\)((?:\\\\)*)\\z", r"\1\\Z", pattern))


class RuleSet:
    """Compiled patterns of a block of rules; made once in each task."""

    def __init__(self, patterns: list[str], flags: int = 0):
        self.patterns, self.flags, self.compiled = [_scoped(p) for p in patterns], flags, {}
        owners: dict[str, list[tuple[int, int, int | None, int]]] = {}
        first: dict[str, int] = {}
        #: Rules by the first one with the same pattern, which stands for them.
        self.alike: dict[int, list[int]] = {}
        self.plain: list[int] = []
        for rule, pattern in enumerate(patterns):
            lead = first.setdefault(pattern, rule)
            self.alike.setdefault(lead, []).append(rule)
            if lead != rule:
                continue
            words = set(_parsed(pattern, _words_of, ()))
            for word, low, high in words:
                owners.setdefault(word, []).append((rule, low, high, len(word)))
            if not words:
                self.plain.append(rule)
        self.automaton = ahocorasick.Automaton()
        for word, rules in owners.items():
            self.automaton.add_word(word, tuple(rules))
        self.automaton.make_automaton()
        self.has_words = bool(owners)

    def _grouped(self, plain: list[int]) -> list[tuple[re.Pattern | None, list[int]]]:
        groups: list[tuple[re.Pattern | None, list[int]]] = []
        loose = [r for r in plain if self.pattern(r) and not re.search(r"\\[1-9]|\(\?P", self.patterns[r])]
        for at in range(0, len(loose), TOGETHER):
            some = loose[at : at + TOGETHER]
            groups.append((re.compile("|".join(f"(?:{self.patterns[r]})" for r in some), self.flags), some))
        return groups + [(None, [r]) for r in plain if r not in set(loose) and self.pattern(r)]

    @cached_property
    def groups(self) -> list[tuple[re.Pattern | None, list[int]]]:
        """Alternations of rules without required words."""
        return self._grouped(self.plain)

    @cached_property
    def runs(self) -> list[tuple[re.Pattern, list[tuple[int, int, int, int]]]]:
        """For a few classes of characters, the rules without required words that need a run of them: (rule, how many, least and most characters before)."""
        found: dict[str, list[tuple[int, int, int, int]]] = {}
        for rule in self.plain:
            run = _parsed(self.patterns[rule], _run_of, None) if self.pattern(rule) else None
            if run and (run[1][0] in found or len(found) < CLASSES):
                found.setdefault(run[1][0], []).append((rule, run[0], *run[1][1:]))
        return [(re.compile(f"{chars}+"), rules) for chars, rules in found.items()]

    @cached_property
    def loose(self) -> list[tuple[re.Pattern | None, list[int]]]:
        """Alternations of the rules that need neither words nor runs."""
        known = {rule for _, rules in self.runs for rule, *_ in rules}
        return self._grouped([r for r in self.plain if r not in known])

    def pattern(self, rule: int) -> re.Pattern | None:
        """The compiled pattern; none if it can't be compiled."""
        if rule not in self.compiled:
            try:
                self.compiled[rule] = re.compile(self.patterns[rule], self.flags)
            except (re.error, OverflowError, RecursionError):
                self.compiled[rule] = None
        return self.compiled[rule]

    def told(self, text: str) -> Iterator[tuple[int, tuple[tuple[int, int, int | None, int], ...]]]:
        """(place of its end, (rule, least and most characters of a match before it, length)...) for each required word in a text."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        return self.automaton.iter(low.translate(_ALIKE) if not low.isascii() else low) if self.has_words else iter(())

    def tried(self, text: str) -> set[int]:
        """Rules that may match in a text."""
        leads = {owner[0] for _, owners in self.told(text) for owner in owners}
        for pattern, rules in self.groups:
            if pattern is None or pattern.search(text):
                leads.update(rules)
        return {rule for lead in leads for rule in self.alike[lead]}


def _first(pattern: re.Pattern, body: str, places: list[tuple[int, int]]) -> re.Match | None:
    """The first match, if matches begin at some of these places only, each the first and the last of several."""
    at = 0
    for low, high in sorted(places):
        low = max(low, at)
        if high - low > 4 * NEAR:
            return pattern.search(body, low)
        for n in range(low, high + 1):
            found = pattern.match(body, n)
            if found:
                return found
        at = max(at, high + 1)
    return None


def _uncloaked(text: str) -> tuple[str, list[int]]:
    """The text without cloaking characters, and for each of these the place in that text before which it stood."""
    if text.isascii():
        return text, []
    places = [m.start() - n for n, m in enumerate(_CLOAKS.finditer(text))]
    return (_CLOAKS.sub("", text), places) if places else (text, places)


def _lines(text: str) -> tuple[list[str], list[int]]:
    """Lines without their ends, and where they begin; no empty last line."""
    parts = text.split("\n")
    starts = [0]
    for part in parts[:-1]:
        starts.append(starts[-1] + len(part) + 1)
    if not parts[-1]:
        parts.pop()
    return [p.removesuffix("\r") for p in parts], starts


_LINE = [("line", pa.int32()), ("offset", pa.int64()), ("rule", pa.int32()), ("body", pa.string()), ("nearby", pa.string()), ("header", pa.string())]
_CONTENT = [("line", pa.int32()), ("offset", pa.int64()), ("rule", pa.int32()), ("nth", pa.int32()), ("body", pa.string()), ("around", pa.string()), ("wide", pa.string())]


def line_matches(rules: RuleSet, text: str, decloak: bool, around: bool = True) -> Iterator[tuple]:
    """(line, offset, rule, body, nearby, header) of the first match of each rule on each line, offsets as in the text before it was uncloaked.

    A rule is tried only where its words or runs let a match begin. Without around, the body is what a snippet shows of it, and there is nothing nearby and no header.
    """
    clean, places = _uncloaked(text) if decloak else (text, [])
    lines, starts = _lines(clean)
    tried: dict[tuple[int, int], list[tuple[int, int]]] = {}
    line, begin, end_of_line = -1, 0, -1
    for end, owners in rules.told(clean):
        if end >= end_of_line:
            line = bisect_right(starts, end) - 1
            begin, end_of_line = starts[line], starts[line + 1] if line + 1 < len(starts) else len(clean) + 1
        for rule, low, high, length in owners:
            at = end - length + 1 - begin
            if at >= low:
                tried.setdefault((line, rule), []).append((0, _END) if high is None else (at - high, at - low))
    for pattern, owners in rules.runs:
        for n, body in enumerate(lines):
            for run in pattern.finditer(body):
                for rule, least, low, high in owners:
                    if run.end() - run.start() >= least:
                        tried.setdefault((n, rule), []).append((run.start() - high, run.end() - least - low))
    for pattern, owners in rules.loose:
        for n, body in enumerate(lines):
            if pattern is None or pattern.search(body):
                tried.update(((n, rule), [(0, _END)]) for rule in owners)
    out = []
    for (line, lead), at in tried.items():
        pattern = rules.pattern(lead)
        found = pattern and _first(pattern, lines[line], at)
        if found:
            out += [(line, rule, found.start()) for rule in rules.alike[lead]]
    for line, rule, at in sorted(out):
        offset = starts[line] + at
        body, nearby, header = (lines[line], "\n".join(lines[line : line + 4]), clean[:1024]) if around else (_shown(lines[line]), None, None)
        yield line + 1, offset + bisect_right(places, offset), rule, body, nearby, header


def _shown(body: str) -> str:
    """A line that has the same snippet."""
    body = body.strip(" ")
    return body if len(body) <= N.SNIPPET else f"{body[:N.SNIPPET]}..."


def content_matches(rules: RuleSet, text: str, live: str, calls: set[int], lives: set[int]) -> Iterator[tuple]:
    """All matches of each rule in the whole text, with what stands around them.

    Those of calls don't count after a dot, and those of lives neither inside strings and comments, which live has as blanks, nor between
    slashes on their line. nth counts a rule's matches on the line where they begin.
    """
    tried = rules.tried(text)
    if not tried:
        return
    lines, starts = _lines(text)
    for rule in sorted(tried):
        pattern, last, nth = rules.pattern(rule), -1, 0
        for found in pattern.finditer(text) if pattern else ():
            at = found.start()
            line = bisect_right(starts, at) - 1
            body = lines[line] if line < len(lines) else ""
            if rule in calls and text[max(0, at - 1) : at] == ".":
                continue
            if rule in lives and (live[at : at + 1] != text[at : at + 1] or _BETWEEN_SLASHES.search(body[: at - starts[line] + 10])):
                continue
            nth, last = (nth + 1 if line == last else 1), line
            yield line + 1, at, rule, nth, body, "\n".join(lines[max(0, line - 1) : line + 2])[:500], "\n".join(lines[max(0, line - 2) : line + 3])


def _mapped(files: DataFrame, text: str, patterns: list[str], flags: int, decloak: bool, live: str | None, calls: set[int] = frozenset(), lives: set[int] = frozenset(), around: bool = True) -> DataFrame:
    """Matches with the files' other columns as they are, and what was found in columns that begin with two underscores: of lines, or of whole texts where live names a column."""
    keep = [c for c in files.columns if c not in (text, live)]
    fields = _LINE if live is None else _CONTENT
    own = files.select(*keep, F.col(text).alias("__text"), *([F.col(live).alias("__live")] if live else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = RuleSet(patterns, flags)
        for batch in batches:
            rows, out = [], []
            for at in range(batch.num_rows):
                whole = batch.column(len(keep))[at].as_py()
                if whole is None:
                    continue
                found = line_matches(rules, whole, decloak, around) if live is None else content_matches(rules, whole, batch.column(len(keep) + 1)[at].as_py() or "", calls, lives)
                for one in found:
                    rows.append(at)
                    out.append(one)
                if len(out) >= 5000:
                    yield told(batch, rows, out)
                    rows, out = [], []
            if out:
                yield told(batch, rows, out)

    def told(batch, rows, out):
        took = pa.array(rows, pa.int32())
        columns = [c.take(took) for c in batch.columns[: len(keep)]] + [pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, *[f"__{n}" for n, _ in fields]])

    sql = {pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.string(): T.StringType()}
    schema = files.select(*keep).schema
    for name, kind in fields:
        schema = schema.add(f"__{name}", sql[kind])
    return own.mapInArrow(run, schema)


def _filtered(path: Column) -> Column:
    """Whether a rule's filter, an array column for each kind, lets the path through."""
    f = F.col("file_filter")
    name = F.element_at(F.split(path, "/"), -1)
    none = F.coalesce(F.size(f["filename_exact"]), F.lit(0)) + F.coalesce(F.size(f["extensions"]), F.lit(0)) + F.coalesce(F.size(f["filename_suffix"]), F.lit(0)) <= 0
    ending = F.element_at(F.split(name, r"\."), -1)
    tests = [F.exists(f["filename_exact"], lambda x: x == name), F.exists(f["extensions"], lambda x: F.ltrim(x, F.lit(".")) == ending), F.exists(f["filename_suffix"], lambda x: name.endswith(x))]
    return f.isNull() | none | F.coalesce(tests[0], F.lit(False)) | F.coalesce(tests[1], F.lit(False)) | F.coalesce(tests[2], F.lit(False))


def _suppressed(path: Column) -> Column:
    s, out = F.col("suppress"), F.lit(False)

    def any_in(kind: str, text: Column) -> Column:
        return F.coalesce(F.exists(s[kind], lambda x: text.contains(x)), F.lit(False))

    for text, kinds in ((path, ["path_contains"]), (F.col("__body"), ["line_contains", "safe_domains"]), (F.col("__nearby"), ["nearby_contains"]), (F.col("__header"), ["file_header_contains"])):
        for kind in kinds:
            out = out | any_in(kind, text)
    return out | F.coalesce(F.exists(s["filename_suffix"], lambda x: path.endswith(x)), F.lit(False))


def content_matched(files: DataFrame, patterns: list[str], text: str, live: str, calls: set[int], lives: set[int]) -> DataFrame:
    """Matches in whole texts, in any case of letters and with line anchors, as __rule (number), __line, __offset, __nth, __body, __around and __wide beside the files' other columns."""
    return _mapped(files, text, patterns, re.IGNORECASE | re.MULTILINE, False, live, calls, lives)


def scan_rules(files: DataFrame, rules: DataFrame, path: str = "path", text: str = "text", decloak: bool = True, block: int = BLOCK) -> DataFrame:
    """One finding for each rule and line that matches: the files' other columns, line, offset, rule, phase, severity, weight, snippet, and the rules' further columns.

    rules has id and pattern, and may have phase, severity, weight, description, file_filter and suppress as in RULES. Texts are matched without cloaking
    characters; lines, of which these are no part, and offsets, from 0, are those of the text as it was given. Patterns that can't be compiled find nothing. Null
    texts have no lines. Rules of any number are read through the driver and sent to tasks, block by block.
    """
    known = {f.name: f.dataType for f in RULES.fields}
    own = rules.select(*[(F.col(n) if n in rules.columns else F.lit(None)).cast(t).alias(n) for n, t in known.items()], *[c for c in rules.columns if c not in known])
    rows, out = own.where("pattern is not null").toLocalIterator(prefetchPartitions=False), None
    while True:
        some = list(islice(rows, block))
        if not some and out is not None:
            return out
        found = _mapped(files, text, [r.pattern for r in some], 0, decloak, None, around=any(r.suppress for r in some))
        told = files.sparkSession.createDataFrame([(n, *r) for n, r in enumerate(some)], T.StructType([T.StructField("__no", T.IntegerType()), *own.schema.fields]))
        hits = found.join(F.broadcast(told), found["__rule"] == told["__no"]).where(_filtered(F.col(path)) & ~_suppressed(F.col(path)))
        keep = [c for c in files.columns if c != text]
        more = [c for c in own.columns if c not in known and c not in keep]
        hits = hits.select(
            *keep, F.col("__line").alias("line"), F.col("__offset").alias("offset"), F.col("id").alias("rule"), "phase", "severity", F.coalesce("weight", F.lit(1)).alias("weight"),
            F.concat_ws(": ", F.coalesce("description", F.lit("")), N.snippet(F.col("__body"))).alias("snippet"), *more,
        )
        out = hits if out is None else out.unionByName(hits)
        if len(some) < block:
            return out
