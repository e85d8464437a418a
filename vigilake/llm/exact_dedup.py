"""Exact duplicate removal by Patricia tries of whole byte strings.

Every input task feeds the full UTF-8 bytes of its rows to a compressed radix trie, whose terminal
nodes hold the owner and the number of rows of one text; so a text that fills a third of the table
leaves each task as one row. A task whose trie outgrows its budget sends the heaviest subtree on
and forgets it. What the tasks send is dealt by byte length and content hash, and each part is merged by one trie
again, so equality is decided by the bytes, never by the hash. A part comes in the order of its bytes, so
a trie that outgrows its budget lets go of all subtrees left of the current text, which are complete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of


class _Node:
    __slots__ = ("label", "kids", "owner", "count")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.count = label, {}, None, 0


def _shared(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of label stand in key from position at."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings with the owning identifier and the number of rows of each."""

    def __init__(self, keep: str = "smallest"):
        self.root, self.keep, self.weight = _Node(b""), keep, {}
        self.total = 0

    def _better(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        return min(a, b) if self.keep == "smallest" else max(a, b)

    def insert(self, key: bytes, owner, count: int = 1) -> None:
        node, at, added = self.root, 0, 0
        while at < len(key):
            child = node.kids.get(key[at])
            if child is None:
                child = _Node(key[at:])
                node.kids[key[at]] = child
                added += len(child.label) + 200
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                n = _shared(child.label, key, at)
                upper = _Node(child.label[:n])
                child.label = child.label[n:]
                upper.kids[child.label[0]] = child
                node.kids[key[at]] = upper
                added += 200
                node, at = upper, at + n
        node.owner = owner if not node.count else self._better(node.owner, owner)
        node.count += count
        if added:
            self.weight[key[0]] = self.weight.get(key[0], 0) + added
            self.total += added

    def _terminals(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object, int]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.count:
                yield key, node.owner, node.count
            stack.extend((kid, key) for kid in node.kids.values())

    def spill(self) -> Iterator[tuple[bytes, object, int]]:
        """Takes out the heaviest subtree below the root and gives its texts."""
        first = max(self.weight, key=self.weight.get)
        self.total -= self.weight.pop(first)
        yield from self._terminals(self.root.kids.pop(first), b"")

    def pass_by(self, key: bytes) -> Iterator[tuple[bytes, object, int]]:
        """Takes out all texts that sort before key, whole subtrees and those on the way to it, and gives them."""
        node, at, freed = self.root, 0, 0
        while True:
            if node.count and at < len(key):
                yield key[:at], node.owner, node.count
                node.owner, node.count = None, 0
            if at >= len(key):
                break
            for first in [c for c in node.kids if c < key[at]]:
                kid = node.kids.pop(first)
                freed += self._size(kid)
                yield from self._terminals(kid, key[:at])
            kid = node.kids.get(key[at])
            if kid is None:
                break
            if not key.startswith(kid.label, at):
                if key[at:] > kid.label:
                    del node.kids[key[at]]
                    freed += self._size(kid)
                    yield from self._terminals(kid, key[:at])
                break
            node, at = kid, at + len(kid.label)
        self.total -= freed

    @staticmethod
    def _size(node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + 200
            stack.extend(node.kids.values())
        return total

    def drain(self) -> Iterator[tuple[bytes, object, int]]:
        yield from self._terminals(self.root, b"")
        self.root, self.weight, self.total = _Node(b""), {}, 0


_PARTIAL = "body binary, owner long, n long"
_OWNERS = "text_sha256 string, keep_id long, group_size long"


def _combine(keep: str, budget: int):
    """Map side: one row for each text of a task, or more if its trie had to spill."""
    schema = pa.schema([("body", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, size = PatriciaTrie(keep), [], 0

        def emit(rows, flush=False):
            nonlocal out, size
            for row in rows:
                out.append(row)
                size += len(row[0])
                if size > 4_000_000:
                    yield batch(out)
                    out, size = [], 0
            if flush and out:
                yield batch(out)
                out, size = [], 0

        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i in range(b.num_rows):
                trie.insert(texts[i].as_py().encode(), ids[i].as_py())
                while trie.total > budget:
                    yield from emit(trie.spill())
        yield from emit(trie.drain(), flush=True)

    return run


def _merge(keep: str, budget: int):
    """Reduce side: the rows of a part come in the order of their bytes and go into one trie."""
    schema = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = PatriciaTrie(keep), []
        for b in batches:
            for body, owner, n in zip(*(b.column(k) for k in range(3))):
                key = body.as_py()
                trie.insert(key, owner.as_py(), n.as_py())
                if trie.total > budget:
                    out.extend((hashlib.sha256(text).hexdigest(), o, m) for text, o, m in trie.pass_by(key))
            if len(out) >= 5000:
                yield batch(out)
                out = []
        out.extend((hashlib.sha256(text).hexdigest(), o, m) for text, o, m in trie.drain())
        if out:
            yield batch(out)

    return run


def owners(docs: DataFrame, keep: str = "smallest", budget: int = 48_000_000) -> DataFrame:
    """One row for each distinct text: text_sha256, keep_id, group_size.

    budget: bytes that a task's trie may hold before it spills a subtree, or, when merging, lets go of complete ones.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("owner"), text_of().alias("body"))
    parts = rows.mapInArrow(_combine(keep, budget), _PARTIAL)
    parts = parts.repartition(F.octet_length("body"), F.xxhash64("body")).sortWithinPartitions("body")
    return parts.mapInArrow(_merge(keep, budget), _OWNERS)


def exact_dedup(docs: DataFrame, keep: str = "smallest", budget: int = 48_000_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs(doc_id, text, ...).

    keep says whether the smallest or the largest doc_id of equal texts stays. Null texts count as
    empty. A null doc_id never owns a text that a row with an id has; if all ids of a text are null,
    keep_id is null and its rows stay. Rows that repeat both id and text are all counted in
    group_size and all carry the same kept. No input rows give no rows. Other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    own = owners(docs, keep, budget).withColumnRenamed("text_sha256", "__sha")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text_of(), 256).alias("text_sha256"))
    return rows.join(own, rows.text_sha256 == own["__sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
