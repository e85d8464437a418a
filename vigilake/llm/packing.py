"""Packing of token sequences by the sum-of-squares rule.

Texts are tokenized where they are read; only the places, lengths and checksums of their pieces are
shuffled, to groups of bounded size. A group takes its pieces longest first and puts each into the
open bin, or a new one, for which the squared counts of open bins of each residual gap then add up
to the least. That keeps the gaps varied, so some bin fits nearly every later piece exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_groups import batches_of, give_back, groups, texts_of
from .common import cut, text_of
from .tokens import encoder

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(path: str, end_id: int, size: int):
    def rows(batches):
        words, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for start, texts in texts_of(b.column(1), 1_000_000):
                for i, ids in enumerate(words.encode_all(texts)):
                    ids += end
                    doc = b.column(0)[start + i].as_py()
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        yield doc, k, at // 4, len(part) // 4, zlib.crc32(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), _PIECE)

    return run


def place(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, none over size, in the order given; bins count from 0.

    Ties go to the smallest gap that fits. Lengths of 0 go to the first bin at no cost.
    """
    open_bins = np.zeros(size + 1, np.int64)
    at_gap: dict[int, list[int]] = {}
    used, out = 0, []
    for n in lengths:
        # leaving gap g changes the sum by 1 - 2 count(g), reaching gap g - n by 2 count(g - n) + 1 unless the bin is full
        cost = np.where(open_bins[n:] > 0, 1 - 2 * open_bins[n:], np.iinfo(np.int64).max // 2)
        cost[-1] = 0
        reach = 2 * open_bins[: size + 1 - n] + 1
        reach[0] = 0
        gap = n + int(np.argmin(cost + reach))
        if gap == size:
            bin_, used = used, used + 1
        else:
            bin_ = at_gap[gap].pop()
            open_bins[gap] -= 1
        if gap > n:
            at_gap.setdefault(gap - n, []).append(bin_)
            open_bins[gap - n] += 1
        out.append((bin_, size - gap))
    return out


_PLACED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack(size: int):
    def rows(batches):
        for (group,), pieces in groups(batches):
            pieces.sort(key=lambda p: (-p[3], p[0] is not None, p[0] or 0, p[1], p[4]))
            for piece, (bin_, offset) in zip(pieces, place([p[3] for p in pieces], size)):
                yield *piece, (group << 32) + bin_, offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(rows(batches), _PLACED)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, group_pieces: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs(doc_id, text, ...).

    A document is its text's ids and end_id; one longer than size is cut into pieces of size, the
    last one shorter. tokenizer: the path of a tokenizers file on every executor. About group_pieces
    pieces are packed together, repeated rows shared out like others; each group leaves a few bins part empty. Null texts count as
    empty and are one end id; repeated rows are packed each; a null doc_id stays null. No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # written once, so the groups can be counted and a lost executor costs no text
    cut_up = _pieces(tokenizer, end_id, size)
    pieces = cut(rows.mapInArrow(lambda batches: give_back(cut_up(batches)), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    many = max(1, -(-pieces.count() // group_pieces))
    # the place in the written table tells repeated rows apart, and is the same when a task runs again
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(many))
    dealt = pieces.select(group.alias("group"), *pieces.columns).repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(_pack(size), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
