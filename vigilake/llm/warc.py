"""WARC archives: writing through Spark's text sink and reading back by boundary chains.

Writing: a record is a string of header lines and payload, and the sink's line separator is the
blank lines that end a record, so Spark's commit protocol writes the archives and a lost task leaves
nothing. Reading: a payload may itself hold what looks like a record. Each task lists, for every
place where the magic stands, the place where that record would end, from a stream of the file's bytes of which
it holds a small part. Chains are followed inside blocks of a file, and pointer jumping from the start
of each file over the ends of blocks then keeps only the places that the chain of records reaches. Only those payloads are
read and hashed, in a second pass. A chain must end where its file ends: archives that are cut off or damaged are reported.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_groups import batches_of, groups
from .common import cut, scratch

MAGIC = b"WARC/1.0\r\n"
#: Characters of a url that are written, so that header lines fit what is read of them.
URL = 8192
#: Records whose places are told to all tasks at once.
TOLD = 1_000_000
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(body: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hexadecimal digits are 4 of base 32."""
    code = F.sha1(body)
    parts = [F.lpad(F.conv(F.substring(code, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), _DIGITS, _BASE32)


def _records(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, body, payload_bytes, payload_digest, refers_to (null: a response)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = [F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("code")]
    rows = pages.select(*own, F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("body")).withColumn("payload_digest", sha1_base32(F.col("body").cast("binary")))
    # payloads are equal by length and SHA-256; pairs that share a SHA-1 are public
    keys = pages.select(*own).where(F.col("payload_bytes") >= least_bytes)
    many = keys.groupBy("code", "payload_bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(many, ["code", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))).drop("code", "owner")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = 1024, most_bytes: int = 1 << 30) -> None:
    """Writes pages(page_id, url, html, ...) as gzip WARC files of at most records_per_file records, and about most_bytes of payloads, below path.

    Payloads over a mebibyte are written apart, by doublings of their size, with as many to a file as that allows.

    Of equal payloads of at least least_bytes bytes the largest page_id is a response and the others
    are revisits that name it and carry no payload. A null html is an empty payload, a null url an
    empty target; line breaks in a url become spaces, and it is cut at 8192 characters. A row that repeats a page_id and payload is
    written again with the same type. Rows without a page_id are written with an empty id.
    """
    ident = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), ident,
        F.lit(">\r\nWARC-Target-URI: "), F.substring(F.regexp_replace("url", r"[\r\n]+", " "), 1, URL),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nX-Payload-Bytes: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string")),
        F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("body")),
    )
    rows = _records(pages, least_bytes)
    # doublings of a mebibyte that a payload takes; nearly always none
    doublings = F.ceil(F.log2(F.greatest(F.when(revisit, 0).otherwise(F.col("payload_bytes")), F.lit(1 << 20)) / (1 << 20))).cast("int")
    largest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 1
    for k in range(max(0, math.ceil(math.log2(max(largest, 1) / (1 << 20)))) + 1):
        most = max(1, min(records_per_file, most_bytes >> (20 + k)))
        rows.where(doublings == k).select(head.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).option("compression", "gzip").text(path)


#: Bytes of a file that are read at once, the most that a record's header lines may take, and of a block in which chains are followed by one task.
CHUNK, HEAD, BLOCK = 1 << 20, 1 << 16, 4 << 20

_NODE = pa.schema(
    [("file", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("body", pa.int64()), ("page_id", pa.int64()), ("url", pa.string())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("whole", pa.bool_())]
)
_NODE_SQL = "file string, at long, next long, body long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, whole boolean"


def _number(value: bytes | None) -> int | None:
    found = re.search(rb"-?[0-9]{1,18}", value or b"")
    return int(found[0]) if found else None


class _Stream:
    """The bytes of a plain or gzip file in order; whole is False if a compressed one breaks off."""

    def __init__(self, data: bytes):
        self.data, self.whole = data, True

    def __iter__(self) -> Iterator[bytes]:
        view = memoryview(self.data)
        if self.data[:2] != b"\x1f\x8b":
            for at in range(0, len(view), CHUNK):
                yield bytes(view[at : at + CHUNK])
            return
        try:
            while len(view):
                member = zlib.decompressobj(31)
                for at in range(0, len(view), CHUNK // 4):
                    part = bytes(view[at : at + CHUNK // 4])
                    while part and not member.eof:
                        out, part = member.decompress(part, CHUNK), member.unconsumed_tail
                        if out:
                            yield out
                    if member.eof:
                        view = view[at + min(CHUNK // 4, len(view) - at) - len(member.unused_data) :]
                        break
                else:
                    yield member.flush()
                    self.whole = False
                    return
        except zlib.error:
            self.whole = False


def _record(head: bytes) -> dict | None:
    """The header lines of a record; None if they tell no length."""
    told = dict(line.split(b": ", 1) for line in head.split(b"\r\n") if b": " in line)
    length = _number(told.get(b"Content-Length"))
    return None if length is None or length < 0 else told | {b"length": length}


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every place where the magic stands and a record would end in blank lines, with the place after it; and a row without a place for each file, with its size."""

    def rows(name: str, data: bytes):
        stream, buffer, base, done, open_ends = _Stream(data), b"", 0, 0, []

        def begun(limit: int):
            """Takes in the places from done to limit."""
            for found in re.finditer(re.escape(MAGIC), buffer[done - base :]):
                at = done + found.start()
                if at >= limit:
                    break
                end = buffer.find(b"\r\n\r\n", at - base, at - base + HEAD)
                told = _record(buffer[at - base + len(MAGIC) : end]) if end >= 0 else None
                if told is None:
                    continue
                body, kind = base + end + 4, told.get(b"WARC-Type", b"").decode(errors="replace")
                row = (
                    name, at, body + told[b"length"] + 4, body, _number(told.get(b"WARC-Record-ID")), told.get(b"WARC-Target-URI", b"").decode(errors="replace"),
                    _number(told.get(b"X-Payload-Bytes")) if kind == "revisit" else told[b"length"], told.get(b"WARC-Payload-Digest", b"").decode(errors="replace").removeprefix("sha1:"), kind, _number(told.get(b"WARC-Refers-To")), None,
                )
                heapq.heappush(open_ends, (row[2], at, row))

        def ended():
            """The records whose last bytes have been read, if those are blank lines."""
            while open_ends and open_ends[0][0] <= base + len(buffer):
                end, _, row = heapq.heappop(open_ends)
                if buffer[end - 4 - base : end - base] == b"\r\n\r\n":
                    yield row

        for chunk in stream:
            buffer += chunk
            limit = base + len(buffer) - HEAD
            if limit > done:
                begun(limit)
                done = limit
                yield from ended()
                # a record may end four bytes after what is dropped
                drop = max(0, limit - 4 - base)
                buffer, base = buffer[drop:], base + drop
        begun(base + len(buffer))
        yield from ended()
        yield name, None, base + len(buffer), *[None] * 7, stream.whole

    def run():
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                yield from rows(name.as_py(), content.as_py())

    return batches_of(run(), _NODE)


_STEP = pa.schema([("file", pa.string()), ("at", pa.int64()), ("next", pa.int64())])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, at, and where the chain from there leaves its block."""

    def rows():
        for (file, block), places in groups(batches, 2):
            leaves: dict[int, int] = {}
            for at, after in sorted(places, reverse=True):
                out = after if after // BLOCK > block else leaves.get(after)
                if out is not None:
                    leaves[at] = out
                    yield file, at, out

    return batches_of(rows(), _STEP)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, at, next of the places of a block that the chains from its entries reach."""

    def rows():
        for (file, _), places in groups(batches, 2):
            after = {at: n for at, n, entry in places if not entry}
            reached: set[int] = set()
            for at in (p[0] for p in places if p[2]):
                while at in after and at not in reached:
                    reached.add(at)
                    yield file, at, after[at]
                    at = after[at]

    return batches_of(rows(), _STEP)


def reachable(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """file, at, next of the nodes(file, at, next) that the chains from starts(file, at) reach.

    A place's chain is followed to the end of its block by the task that holds the block. Pointer jumping runs over
    these exits: each round joins the jumps with themselves, so they span twice as many blocks, and adds what
    the entries reached so far jump to; the rounds end when no jump leads anywhere.
    """
    block = F.floor(F.col("at") / BLOCK).cast("long").alias("block")
    placed = nodes.select("file", block, "at", "next")
    exits = placed.repartition("file", "block").sortWithinPartitions("file", "block").mapInArrow(_exits, "file string, at long, next long")
    known = nodes.select("file", F.col("at").alias("next"))
    jumps = cut(exits.join(known, ["file", "next"], "left_semi").select("file", "at", "next"), "warc-jumps")
    entries = starts.select("file", "at")
    while not jumps.isEmpty():
        one = jumps.select("file", "at", F.col("next").alias("via"))
        entries = cut(entries.unionByName(entries.join(one, ["file", "at"]).select("file", F.col("via").alias("at"))).distinct(), "warc-entries")
        two = jumps.select("file", F.col("at").alias("via"), "next")
        jumps = cut(one.join(two, ["file", "via"]).select("file", "at", "next"), "warc-jumps")
    both = placed.withColumn("entry", F.lit(False)).unionByName(entries.select("file", block, "at", F.lit(None).cast("long").alias("next"), F.lit(True).alias("entry")))
    return both.repartition("file", "block").sortWithinPartitions("file", "block").mapInArrow(_inside, "file string, at long, next long")


def _followed(nodes: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """file, at, next with the first place at or after each end as next, and file, at of the first place of each file; the size where none follows.

    So chains go on behind what is damaged, wherever and however often a file is.
    """
    asks = nodes.select("file", F.col("next").alias("pos")).union(sizes.select("file", F.lit(0).cast("long"))).distinct()
    both = asks.select("file", "pos", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("at")).union(nodes.select("file", "at", F.lit(1), "at"))
    onward = Window.partitionBy("file").orderBy(F.desc("pos"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("first", F.min("at").over(onward)).where("kind = 0").join(sizes.select("file", "size"), "file")
    found = cut(found.select("file", "pos", F.coalesce("first", "size").alias("first")), "warc-followed")
    steps = nodes.select("file", "at", F.col("next").alias("pos")).join(found, ["file", "pos"]).select("file", "at", F.col("first").alias("next"))
    return steps, found.where("pos = 0").select("file", F.col("first").alias("at"))


def _chains(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes of the files below path; file, at, next of the real records; file, end, size of the files that broke off, where they first did.

    After a place where a chain breaks off, the file is taken up again at the next place where a record stands.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = cut(files.mapInArrow(_nodes, _NODE_SQL), "warc-nodes")
    nodes, sizes = found.where("at is not null"), found.where("at is null").select("file", F.col("next").alias("size"), "whole")
    steps, starts = _followed(nodes, sizes)
    reached = reachable(steps, starts).select("file", "at", F.col("next").alias("onward"))
    reached = cut(reached.join(nodes.select("file", "at", "next"), ["file", "at"]), "warc-reached")
    breaks = reached.where("next <> onward").select("file", F.col("next").alias("end")).union(starts.where("at > 0").select("file", F.lit(0).cast("long")))
    broken = breaks.groupBy("file").agg(F.min("end").alias("end")).join(sizes.select("file", "size"), "file").select("file", "end", "size")
    torn = sizes.where("not whole").select("file", F.col("size").alias("end"), "size")
    return nodes, reached.select("file", "at", "next"), cut(broken.unionByName(torn), "warc-broken")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, at and the SHA-1 of the payloads that are listed for each file, as base32."""
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("own", pa.string())])

    def rows():
        for b in batches:
            for name, content, listed in zip(b.column(0), b.column(1), b.column(2)):
                wanted = sorted((r["body"], r["bytes"], r["at"]) for r in listed.as_py())
                k, base, state = 0, 0, hashlib.sha1()
                for chunk in _Stream(content.as_py()):
                    while k < len(wanted):
                        body, n, at = wanted[k]
                        begin, end = max(body, base), body + n
                        if begin >= base + len(chunk) and end > base:
                            break
                        state.update(chunk[begin - base : max(0, end - base)])
                        if end > base + len(chunk):
                            break
                        yield name.as_py(), at, base64.b32encode(state.digest()).decode()
                        k, state = k + 1, hashlib.sha1()
                    base += len(chunk)

    return batches_of(rows(), schema)


def _payload_digests(spark: SparkSession, responses: DataFrame) -> DataFrame:
    """file, at, own for the payloads listed for each file.

    Files are read again by themselves: they are in no shuffle. Groups of files with at most TOLD records are told their places by broadcast.
    """
    counts = responses.select("file", F.size("listed").alias("n")).orderBy("file").collect()  # one row a file
    groups_of, held = [[]], 0
    for r in counts:
        if groups_of[-1] and held + r.n > TOLD:
            groups_of.append([])
            held = 0
        groups_of[-1].append(r.file)
        held += r.n
    out = spark.createDataFrame([], "file string, at long, own string")
    for names in filter(None, groups_of):
        listed = responses.where((F.col("file") >= names[0]) & (F.col("file") <= names[-1]))
        files = spark.read.format("binaryFile").load(names).select(F.col("path").alias("file"), "content")
        out = out.unionByName(files.join(F.broadcast(listed), "file").select("file", "content", "listed").mapInArrow(_digests, "file string, at long, own string"))
    return out


def read_archives(spark: SparkSession, path: str, on_damage: str = "raise") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact of the real records below path.

    Gzip and plain files are read. A record's header lines take at most 64 KiB, and blank lines end it. Digests are computed from the
    payloads read and intact says whether the header has the same or none; a revisit has size and digest of its header. A file
    whose chain of records does not end where the file does is damaged: on_damage "raise" fails with a ValueError that names such files,
    "skip" gives the records before and after the damage, which damaged() tells; with "raise", so does a payload
    that has not its header's digest. An empty or missing set of records gives no rows.
    """
    if on_damage not in ("raise", "skip"):
        raise ValueError("on_damage is 'raise' or 'skip'")
    nodes, reached, broken = _chains(spark, path)
    if on_damage == "raise":
        some = broken.orderBy("file").limit(3).collect()
        if some:
            raise ValueError(f"damaged archives below {path}: " + ", ".join(f"{r.file} at byte {r.end} of {r.size}" for r in some))
    real = cut(nodes.join(reached.select("file", "at").distinct(), ["file", "at"], "left_semi"), "warc-records")
    responses = real.where("record_type <> 'revisit'").groupBy("file").agg(F.collect_list(F.struct("at", "body", F.col("payload_bytes").alias("bytes"))).alias("listed"))
    out = real.join(_payload_digests(spark, responses), ["file", "at"], "left")
    intact = F.col("own").isNull() | (F.col("payload_digest") == "") | (F.col("own") == F.col("payload_digest"))
    if on_damage == "raise":
        intact = F.when(intact, True).otherwise(F.raise_error(F.concat(F.lit("payload without its digest: "), F.col("file"), F.lit(" at byte "), F.col("at").cast("string"))).cast("boolean"))
    return out.select("page_id", "payload_bytes", F.coalesce("own", "payload_digest").alias("payload_digest"), "record_type", "refers_to", "url", intact.alias("intact"))


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """file, begin, end of the stretches of the files below path that belong to no record; end past the last byte of a compressed file that breaks off is the file's size as far as it can be read."""
    _, reached, broken = _chains(spark, path)
    hurt = broken.select("file", "size").distinct()
    edges = reached.join(hurt.select("file"), "file", "left_semi").select("file", F.col("at").alias("end"), "next").unionByName(hurt.select("file", F.col("size").alias("end"), F.col("size").alias("next")))
    before = F.coalesce(F.lag("next").over(Window.partitionBy("file").orderBy("end", "next")), F.lit(0))
    return edges.select("file", before.alias("begin"), "end").where(F.col("begin") < F.col("end"))


def round_trip(pages: DataFrame, least_bytes: int = 0, records_per_file: int = 1024) -> DataFrame:
    """Writes pages to archives in the shared folder and gives what reading them back finds."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes, records_per_file)
    return read_archives(pages.sparkSession, path)
