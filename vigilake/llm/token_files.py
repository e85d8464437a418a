"""Token ids in ORC files that are ordered by document.

ORC stores the ids in stripes by integer run-length encoding, with a row index and a Bloom filter
of the document ids, so a reader prunes stripes and row groups by id and reads stripes in parallel.
Documents are dealt out by ranges of doc_id and tokenized after that, once; each file holds the
counts of its own range, and a small table beside the files the number of ids of each range, from which the places are added up
when the files are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_groups import texts_of
from .common import text_of
from .tokens import encoder

_FILE = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for start, texts in texts_of(b.column(1), 4_000_000):
                coded = [ids + end for ids in words.encode_all(texts)]
                n = np.array([len(c) // 4 for c in coded], np.int64)
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))]))
                columns = [b.column(0).slice(start, len(texts)), pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends - n), pa.array(n), ids]
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, schema=_FILE)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Writes the ids of docs(doc_id, text, ...), each text's followed by end_id, as ORC below path in ascending doc_id order.

    tokenizer: the path of a tokenizers file on every executor. Null texts count as empty and have
    the end id only; a null doc_id comes first; rows of one id go by the hashes of their texts, and repeated rows
    are written each, so an id that many rows share is spread over ranges. No rows give no documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # the last key tells repeated rows apart; it is the same whenever a task of the scan runs
    keys = {"code": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
    rows = rows.withColumns(keys).repartitionByRange("doc_id", *keys).sortWithinPartitions("doc_id", *keys).select("doc_id", "text")
    coded = rows.mapInArrow(_encode(tokenizer, end_id), "doc_id long, part int, before long, n_tokens long, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(index_rows)}
    coded.write.options(**options).orc(path)
    written = docs.sparkSession.read.schema(_FILE_SQL).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    written.coalesce(1).write.parquet(_parts(path))


_FILE_SQL = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def _parts(path: str) -> str:
    return f"{path.rstrip('/')}-parts"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of the documents that write_tokens wrote below path. Filters on doc_id reach the files, and only theirs are read."""
    files = spark.read.schema(_FILE_SQL).orc(path)
    # one row for each file that was written, whatever its documents
    parts = spark.read.schema("part int, n long").parquet(_parts(path))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__base"))
    return files.join(F.broadcast(starts), F.col("part") == F.col("__part")).select("doc_id", (F.col("before") + F.col("__base")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(3)
        values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the little-endian unsigned 32-bit ids) of what read_tokens gives."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
