"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

Benchmark items are cut into pieces of 80 to 159 normalised characters side by side and, with a stride, of 80
that overlap, which a task holds as a sorted index of hashed character q-grams. A copy of a piece of n characters with at most e edits
shares at least n + 1 - q (e + 1) q-grams with it (the q-gram lemma), and all lie within e diagonals of each other
in a stretch of n + e characters. So a stretch of a document with fewer q-grams of the whole index
is passed over; in the rest the hits of each piece are counted in overlapping bands of diagonals,
and the bands that reach the piece's bound are aligned. Items too short for edits are looked up by their
first characters and compared as whole words. Documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_groups import batches_of, give_back, texts_of, trim
from .common import cut, text_of
from .shingles import mix

_WORD = re.compile(r"[^\W_]+")
#: Of each byte of an ASCII text its lower-case letter or its digit, else a space.
_PLAIN = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
_BITS = 22
#: Hits of grams that are held at once.
_ENTRIES = 4_000_000
#: Cells of the table of first counts, a power of two.
_CELLS = 1 << 20


def normal(text: str) -> str:
    """Lower-case runs of letters and digits, one space between them."""
    if text.isascii():
        return b" ".join(text.encode().translate(_PLAIN).split()).decode()
    return " ".join(_WORD.findall(text.lower()))


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q numbers."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    base, out = 0x9E3779B97F4A7C15, np.zeros(len(codes) - q + 1, np.uint64)
    for k in range(q):
        out *= np.uint64(base)
        out += codes[k : k + len(out)]
    return mix(out)


class _Holders:
    """Which of many texts hold a gram, and where."""

    def __init__(self, distinct: np.ndarray, grams: list[np.ndarray]):
        """distinct: the sorted grams that are numbered; others are left out."""
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        numbers = np.searchsorted(distinct, flat)
        order = np.argsort(numbers, kind="stable")
        order = order[distinct[np.minimum(numbers[order], len(distinct) - 1)] == flat[order]]
        sizes = np.array([len(g) for g in grams], np.int64)
        self.texts = len(grams)
        self.owner = np.repeat(np.arange(len(grams)), sizes)[order]
        self.place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
        #: where the entries of each gram's number begin, and each entry's number and owner as one key, for ranges of owners
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(numbers[order], minlength=len(distinct)))])
        self.key = numbers[order].astype(np.int64) * (len(grams) + 1) + self.owner

    def ranges(self, number: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of texts, so that what the grams with many holders have in each is bounded."""
        total = int((self.begin[number + 1] - self.begin[number]).sum())
        bounds = np.linspace(0, self.texts, max(1, -(-total // _ENTRIES)) + 1).astype(np.int64).tolist()
        return zip(bounds[:-1], bounds[1:])

    def entries(self, number: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(which number, entry) of all entries of the given grams in the texts from first to end."""
        if first == 0 and end == self.texts:
            low, high = self.begin[number], self.begin[number + 1]
        else:
            span = self.texts + 1
            low, high = np.searchsorted(self.key, number * span + first), np.searchsorted(self.key, number * span + end)
        n = high - low
        return np.repeat(np.arange(len(number)), n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _few(owner: np.ndarray, band: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which hits surely have under least hits of their owner in their own band and the fuller one beside it; bands may share a cell of the table of counts."""
    cell = (owner * 1_000_003 + band) & (_CELLS - 1)
    table = np.bincount(cell, minlength=_CELLS)
    return table[cell] + np.maximum(table[(cell + 1) & (_CELLS - 1)], table[(cell - 1) & (_CELLS - 1)]) < least


def _cut(body: str, piece: int, stride: int | None) -> list[str]:
    """The pieces of an item side by side, the last one up to twice as long; with a stride also one every stride characters and one at its end."""
    cuts = max(1, len(body) // piece)
    parts = [body[k * piece : (k + 1) * piece if k + 1 < cuts else len(body)] for k in range(cuts)]
    if stride is None:
        return parts
    last = max(0, len(body) - piece)
    # the longer pieces stay, as their edits may stand closer than a piece allows
    return list(dict.fromkeys([*parts, *(body[k : k + piece] for k in [*range(0, last, stride), last])]))


class Index:
    """Pieces of benchmark items and their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, piece: int, least: int, stride: int | None = None):
        self.q, self.pieces = q, []
        texts, widest, least_of = [], [], []
        short: dict[int, dict[str, list[int]]] = {}
        for item, text in items:
            body = normal(text or "")
            if len(body) < least:
                if body:
                    short.setdefault(min(len(body), q), {}).setdefault(body, []).append(item)
                continue
            own = []
            for part in _cut(body, piece, stride):
                edits = max(0, min(int(rate * len(part)), len(part) // q - 1))
                own.append((item, part, edits, len(part) + 1 - q * (edits + 1)))
            self.pieces.extend(own)
            texts.append(body)
            widest.append(max(p[2] for p in own))
            least_of.append(min(p[3] for p in own))
        #: length of a start -> sorted hashes of starts, the bodies with their items, the lengths of the bodies
        self.short = {m: (self._starts(bodies, m), bodies, sorted(set(map(len, bodies)))) for m, bodies in short.items()}
        grams, whole = ([_grams(np.array([ord(c) for c in x], np.uint64), q) for x in own] for own in ([p[1] for p in self.pieces], texts))
        self.distinct = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        #: the holders of grams among the pieces, and among the items, which hold them once where pieces overlap
        self.held, self.whole = _Holders(self.distinct, grams), _Holders(self.distinct, whole)
        #: the most edits and the least bound of an item's pieces
        self.widest, self.least_of = np.array(widest, np.int64), np.array(least_of, np.int64)
        #: the first number of each leading part of a hash
        self.slot = np.searchsorted(self.distinct >> np.uint64(64 - _BITS), np.arange((1 << _BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.known = self.slot[1:] > self.slot[:-1]
        self.bound = min((p[3] for p in self.pieces), default=1)
        self.span = max((len(p[1]) + p[2] for p in self.pieces), default=q)
        self.edits, self.least, self.length = (np.array([f(p) for p in self.pieces], np.int64) for f in (lambda p: p[2], lambda p: p[3], lambda p: len(p[1])))

    @staticmethod
    def _starts(bodies: dict[str, list[int]], m: int) -> np.ndarray:
        return np.unique(np.array([_grams(np.array([ord(c) for c in body[:m]], np.uint64), m)[0] for body in bodies], np.uint64))

    def exact(self, codes: np.ndarray, grams: np.ndarray, joined: str) -> Iterator[tuple[int, int, int]]:
        """(item, begin, end): where the short items stand unchanged between word borders.

        A place where one may begin is looked up once for each length of an item, however many items begin alike.
        """
        for m, (hashes, bodies, lengths) in self.short.items():
            own = grams if m == self.q else _grams(codes, m)
            low = np.searchsorted(hashes, own)
            for at in np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == own).tolist():
                if at and joined[at - 1] not in " \0":
                    continue
                for n in lengths:
                    end = at + n
                    if end == len(joined) or joined[end : end + 1] in (" ", "\0"):
                        for item in bodies.get(joined[at:end], ()):
                            yield item, at, end

    def candidates(self, grams: np.ndarray) -> list[tuple[int, int, int]]:
        """(piece, begin, end): stretches of a text with the given q-grams in which a band of diagonals reaches a piece's bound."""
        if not len(grams) or not self.pieces:
            return []
        hit = self.known[(grams >> np.uint64(64 - _BITS)).astype(np.int64)]
        wide = min(self.span - self.q + 1, len(hit))
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        dense = total[wide:] - total[:-wide] >= self.bound
        if not dense.any():
            return []
        # a place stays if it lies in a stretch of the widest piece that has the least bound of hits
        before = np.cumsum(np.concatenate([np.zeros(wide, bool), dense, np.zeros(wide - 1, bool)]), dtype=np.int32)
        where = np.flatnonzero(hit & (before[wide:] > before[:-wide]))
        number = self._numbers(grams[where])
        where, number = where[number >= 0], number[number >= 0]
        near = self._near(where, number)
        where, number = where[near], number[near]
        return [c for first, end in self.held.ranges(number) for c in self._banded(where, number, first, end)]

    def _near(self, where: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which of the places of known grams may help a piece to its bound, as so many hits of its item lie on like diagonals.

        The bands of an item are as wide as two of any of its pieces, so what counts for a piece lies in two neighbouring ones.
        """
        near = np.zeros(len(where), bool)
        for first, end in self.whole.ranges(number):
            which, at = self.whole.entries(number, first, end)
            owner = self.whole.owner[at]
            band = (where[which] - self.whole.place[at]) // (2 * self.widest[owner] + 2)
            near[which[~_few(owner, band, self.least_of[owner])]] = True
        return np.flatnonzero(near)

    def _numbers(self, part: np.ndarray) -> np.ndarray:
        """The numbers of hashes, -1 for those that no piece has."""
        head = (part >> np.uint64(64 - _BITS)).astype(np.int64)
        number = self.slot[head].astype(np.int64)
        same = self.distinct[np.minimum(number, len(self.distinct) - 1)] == part
        more = np.flatnonzero(~same & (self.slot[head + 1] > number + 1))
        if len(more):
            number[more] = np.minimum(np.searchsorted(self.distinct, part[more]), len(self.distinct) - 1)
            same[more] = self.distinct[number[more]] == part[more]
        return np.where(same, number, -1)

    def _banded(self, where: np.ndarray, number: np.ndarray, first: int, end: int) -> list[tuple[int, int, int]]:
        """candidates among the pieces from first to end, given the places and numbers of known grams."""
        which, at = self.held.entries(number, first, end)
        where, owner = where[which], self.held.owner[at]
        step = self.edits[owner] + 1
        # bands are two steps wide, one step apart: any step + 1 neighbouring diagonals lie in one of them
        band = (where - self.held.place[at] + self.span) // step
        few = _few(owner, band, self.least[owner])
        where, at, owner, band = where[~few], at[~few], owner[~few], band[~few]
        if not len(at):
            return []
        key = (owner << 40) + band
        keys, inside, counts = np.unique(np.concatenate([key, key - 1]), return_inverse=True, return_counts=True)
        owner = keys >> 40
        enough = counts >= self.least[owner]
        # of these bands, hits count once for each place of the text, and once for each place of the piece
        mine = enough[inside]
        for place in (np.tile(where, 2), np.tile(self.held.place[at], 2)):
            once = np.unique((inside[mine].astype(np.int64) << 32) + place[mine]) >> 32
            enough &= np.bincount(once, minlength=len(keys)) >= self.least[owner]
        keys, owner = keys[enough], owner[enough]
        begin = (keys - (owner << 40)) * (self.edits[owner] + 1) - self.span - self.edits[owner]
        end = begin + 2 * (self.edits[owner] + 1) + self.length[owner] + 2 * self.edits[owner]
        return list(zip(owner.tolist(), begin.tolist(), end.tolist()))


def align(piece: str, text: str, edits: int) -> tuple[int, int, int] | None:
    """(begin, end, cost) of the best place of piece in text, or None if it costs over edits.

    Row by row over the text's columns, in which gaps before and after the piece are free; a row
    is computed at once, costs of horizontal steps by a running minimum.
    """
    if not text:
        return None
    codes = np.array([ord(c) for c in text])
    width = len(codes) + 1
    steps = np.arange(width)
    cost, begin = np.zeros(width, np.int64), np.arange(width)
    for k, c in enumerate(piece, 1):
        new = cost + 1
        origin = begin.copy()
        diagonal = cost[:-1] + (codes != ord(c))
        better = diagonal <= new[1:]
        new[1:] = np.where(better, diagonal, new[1:])
        origin[1:] = np.where(better, begin[:-1], begin[1:])
        level = new - steps
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, steps, 0))
        cost, begin = least + steps, origin[source]
        if cost.min() > edits:
            return None
    end = int(np.argmin(cost))
    return (int(begin[end]), end, int(cost[end])) if cost[end] <= edits else None


def _scan(index: Index, texts: list[str], any_find: bool = False) -> Iterator[tuple[int, str, list[tuple[int, int, int, int]]]]:
    """(which text, its normal form, finds) for the texts with a find; the best of each item, or just one of a text.

    The best has the fewest edits and, of equals, begins and then ends first.
    """
    bodies = [normal(t) for t in texts]
    joined = "\0".join(bodies)
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    grams = _grams(codes, index.q)
    starts = np.cumsum([0, *(len(b) + 1 for b in bodies)])
    finds: dict[int, dict[int, tuple[int, int, int]]] = {}

    def told(k: int, item: int, find: tuple[int, int, int]) -> None:
        own = finds.setdefault(k, {})
        own[item] = min(find, own.get(item, find))

    for item, begin, end in index.exact(codes, grams, joined):
        k = int(np.searchsorted(starts, begin, "right")) - 1
        told(k, item, (0, begin - int(starts[k]), end - int(starts[k])))
    for i, begin, end in sorted(index.candidates(grams), key=lambda c: c[1]):
        item, piece, edits, _ = index.pieces[i]
        for k in range(max(0, int(np.searchsorted(starts, begin, "right")) - 1), min(len(bodies), int(np.searchsorted(starts, end, "left")))):
            at = max(0, begin - int(starts[k]))
            if k in finds and (any_find or item in finds[k] and finds[k][item] < (0, at)):
                continue
            window = bodies[k][at : max(0, end - int(starts[k]))]
            same = window.find(piece)
            found = (same, same + len(piece), 0) if same >= 0 else align(piece, window, edits)
            if found:
                told(k, item, (found[2], at + found[0], at + found[1]))
    for k in sorted(finds):
        yield k, bodies[k], [(item, begin, end, edits) for item, (edits, begin, end) in finds[k].items()]


def _places(text: str) -> list[tuple[int, int]]:
    """(begin, end) in text of each character of its normal form; only texts with a find need it."""
    out: list[tuple[int, int]] = []
    lowered = [(x, i) for i, c in enumerate(text) for x in c.lower()]
    body = "".join(x for x, _ in lowered)
    for word in _WORD.finditer(body):
        if out:
            out.append((out[-1][1], out[-1][1]))
        out.extend((lowered[p][1], lowered[p][1] + 1) for p in range(word.start(), word.end()))
    return out


_LEAK = pa.schema([("doc_id", pa.int64()), ("code", pa.int64()), ("item_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])


def _blocks(benchmark: DataFrame, q: int, rate: float, piece: int, least: int, stride: int | None, block_chars: int) -> Iterator[Broadcast]:
    """Indexes of the benchmark, each of about block_chars characters of pieces, as broadcasts.

    One is built at a time, and what the driver keeps of it is its file; a task loads the one it needs.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars * (math.ceil(piece / stride) if stride else 1) / block_chars))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        held = benchmark.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in rows], q, rate, piece, least, stride))
        trim()
        yield held


_LEAK_SQL = "doc_id long, code long, item_id long, begin int, end int, edits int"


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, piece: int = 80, least: int = 40, block_chars: int = 4_000_000, stride: int | None = None) -> DataFrame:
    """doc_id, item_id, begin, end, edits: the best find of each benchmark item in each document.

    docs(doc_id, text, ...), benchmark(item_id, text, ...). Texts are compared as lower-case words;
    an item is found where one of its pieces of at least piece characters (a shorter item whole)
    stands with at most rate edits a character. With a stride, further pieces of just piece characters begin that far
    apart, so any piece + stride - 1 characters of an item hold one; without, pieces only stand side by side, which costs
    less and misses parts that hold no piece. begin and end are code points of the document's own text. Items of
    under least normalised characters are found unchanged and as whole words only; items without any are passed over. Rows
    that repeat an id and text are one document and give one find; rows of one id with other texts give one each. Items that
    share an id are one item. The best find has the fewest edits and begins first. A benchmark whose pieces have over
    block_chars characters is searched in blocks, a pass over docs for each, and finds the same. No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("code", F.xxhash64("text"))

    def over(held: Broadcast):
        def find(batches):
            for b in batches:
                for start, texts in texts_of(b.column(1), 500_000):
                    for k, _, finds in _scan(held.value, texts):
                        places = _places(texts[k])
                        for item, begin, end, edits in finds:
                            yield b.column(0)[start + k].as_py(), b.column(2)[start + k].as_py(), item, places[begin][0], places[end - 1][1], edits

        return lambda batches: batches_of(find(batches), _LEAK)

    out = None
    for held in _blocks(benchmark, q, rate, piece, least, stride, block_chars):
        part = rows.mapInArrow(over(held), _LEAK_SQL)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("doc_id", "code", "item_id").agg(F.min(F.struct("edits", "begin", "end")).alias("best"))
    return best.select("doc_id", "item_id", "best.begin", "best.end", "best.edits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, piece: int = 80, least: int = 40, block_chars: int = 4_000_000, stride: int | None = None) -> DataFrame:
    """docs less the rows in which leaks finds a benchmark item; all columns stay as they are.

    A benchmark of many blocks is searched one block after the other, and what is left is written to the shared folder in between.
    """
    at = docs.columns.index("text")

    def over(held: Broadcast):
        def keep(batches):
            for b in batches:
                bad = {start + k for start, texts in texts_of(b.column(at), 150_000) for k, _, _ in _scan(held.value, texts, any_find=True)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)])) if bad else b

        return keep

    out = None
    for held in _blocks(benchmark, q, rate, piece, least, stride, block_chars):
        own = over(held)
        out = (docs if out is None else cut(out, "decontaminated")).mapInArrow(lambda batches, own=own: give_back(own(batches)), docs.schema)
    return out
