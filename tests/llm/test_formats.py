import base64
import glob
import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilake.llm import chat, packing, token_files, tokens, warc
from vigilake.llm.common import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
# letters, signs, white space of several kinds, combining marks and letters that compose or lower in odd ways
ALPHABET = [*"abcHJTWst'.,_!%*<|>09", *map(chr, (9, 10, 11, 13, 28, 32, 0xA0, 0x130, 0x1E9E, 0x301, 0x30C, 0x331, 0x345, 0x3A3, 0x3C3, 0x2003, 0x3000, 0xB2, 0x212A))]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(ALPHABET))))
def test_words_encode_as_whole_texts(text):
    want = _library(text)
    assert np.frombuffer(tokens.encoder(PATH).encode_all([text])[0], "<u4").tolist() == want


_whole = Tokenizer.from_file(PATH)


def _library(text):
    return _whole.encode(text, add_special_tokens=False).ids


def test_small_cache_gives_the_same_ids():
    small, text = tokens.WordEncoder(PATH, limit=3), "one two three four five two one"
    assert np.frombuffer(b"".join(small.encode_all([text, text])), "<u4").tolist() == 2 * _library(text)


def ids_of(text, end):
    return np.array(_library(text or "") + [end], "<u4")


ROWS = [(5, "b c"), (1, "a"), (3, None), (2, ""), (None, "n"), (9, "long word " * 30_000), (4, "x"), (4, "x"), (4, "w")]


def test_token_files_round_trip(spark):
    path = scratch(spark, "t")
    token_files.write_tokens(spark.createDataFrame(ROWS, DOCS).repartition(4), path, PATH, 2)
    got = token_files.checksums(token_files.read_tokens(spark, path)).orderBy("start").collect()
    at, order = 0, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest(r[1] or "", seed=42)).view(np.int64)))
    for r, (doc, text) in zip(got, order, strict=True):
        ids = ids_of(text, 2)
        assert tuple(r) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    one = token_files.read_tokens(spark, path).where("doc_id = 5")
    assert [r.ids for r in one.collect()] == [ids_of("b c", 2).tolist()]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)" in one._jdf.queryExecution().toString()


def test_token_files_have_stripes_indexes_and_bloom_filters(spark):
    path = scratch(spark, "t")
    rows = spark.range(30_000).selectExpr("id as doc_id", "concat(uuid(), ' ', uuid()) as text", "'clash' as part", "1 as before")
    token_files.write_tokens(rows.coalesce(2), path, PATH, 2, stripe_bytes=200_000, index_rows=1000)
    hadoop, stripes, kinds = spark._jvm.org.apache.hadoop.fs.Path, 0, set()
    for name in glob.glob(f"{path}/*.orc"):
        reader = spark._jvm.org.apache.orc.OrcFile.createReader(hadoop(name), spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        assert reader.getRowIndexStride() == 1000
        lines = reader.rows()
        for k in range(reader.getStripes().size()):
            stripes += 1
            footer = lines.readStripeFooter(reader.getStripes().get(k))
            kinds |= {(s.getColumn(), s.getKind().toString()) for s in (footer.getStreams(j) for j in range(footer.getStreamsCount()))}
            assert footer.getColumns(6).getKind().toString() == "DIRECT_V2"  # run-length encoding of the ids
    assert stripes > len(glob.glob(f"{path}/*.orc")) and {(1, "BLOOM_FILTER_UTF8"), (1, "ROW_INDEX")} <= kinds
    plan = token_files.read_tokens(spark, path).where("doc_id = 5")._jdf.queryExecution().toString()
    assert plan.count("FileScan orc") == 1


def test_token_files_spread_an_id_that_many_rows_share(spark):
    path = scratch(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, id, 7L) as doc_id", "if(id % 2 = 0, 'same', concat('t', id)) as text")
    token_files.write_tokens(rows.repartition(4), path, PATH, 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.orc(path).groupBy("part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 4500
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist() and [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) == 9000


def test_token_files_whole_table(spark):
    path = scratch(spark, "t")
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    token_files.write_tokens(docs, path, PATH, 2)
    got = {r.doc_id: tuple(r)[1:] for r in token_files.checksums(token_files.read_tokens(spark, path)).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = ids_of(r.text, 2)
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_empty(spark):
    path = scratch(spark, "t")
    token_files.write_tokens(spark.createDataFrame([], DOCS), path, PATH, 2)
    assert token_files.checksums(token_files.read_tokens(spark, path)).count() == 0


def slow_place(lengths, size):
    """The rule spelled out: the sum of squares is counted anew for each choice."""
    gaps, out = [], []
    for n in lengths:
        best = None
        for g in sorted({x for x in gaps if x >= n} | {size}):
            after = list(gaps)
            if g != size:
                after.remove(g)
            if g > n:
                after.append(g - n)
            inside = [x for x in after if x < size]
            cost = sum(inside.count(x) ** 2 for x in set(inside))
            if best is None or cost < best[0]:
                best = (cost, g)
        g = best[1]
        if g != size:
            gaps.remove(g)
        if g > n:
            gaps.append(g - n)
        out.append(g)
    return out


def test_place_follows_the_rule():
    rng = random.Random(4)
    for size in (5, 13):
        lengths = [rng.randint(1, size) for _ in range(60)]
        assert [size - o for _, o in packing.place(lengths, size)] == slow_place(lengths, size)


def check_packing(rows, docs, size, end):
    want = {}
    for doc, text in docs:
        ids = ids_of(text, end)
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            key = (doc, k, at, len(part), zlib.crc32(part.tobytes()))
            want[key] = want.get(key, 0) + 1
    bins = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        want[key] -= 1
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not any(want.values())
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), sum(r.length for r in rows)


def test_packing_whole_table_is_tight(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    n, total = check_packing(packing.pack(docs, PATH, 1).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096, 1)
    assert n <= 1.02 * total / 4096 + 1


def test_packing_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    check_packing(packing.pack(docs, PATH, 1, size=64, group_pieces=3).collect(), ROWS, 64, 1)
    assert packing.pack(spark.createDataFrame([], DOCS), PATH, 1).count() == 0


def test_packing_shares_out_repeated_rows_and_pieces(spark):
    rows = spark.range(3000).selectExpr("cast(7 as long) as doc_id", "'same text' as text").unionByName(spark.createDataFrame([(1, "w " * 20_000)], DOCS)).repartition(3)
    got = packing.pack(rows.withColumn("group", F.lit("clash")).withColumn("piece", F.lit(1)), PATH, 1, size=64, group_pieces=200).collect()
    check_packing(got, [(7, "same text")] * 3000 + [(1, "w " * 20_000)], 64, 1)
    groups = Counter(r.sequence_id >> 32 for r in got)
    assert len(groups) == -(-len(got) // 200) and max(groups.values()) < 2 * 200


PAGES = "page_id long, url string, html string"


def test_warc_round_trip_and_false_magic(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", "a"), (2, "u\nv", "a"), (3, None, None), (4, "w", fake), (5, "w", fake * 3 + "WARC/1.0\r\n"), (6, "é", "é\r\n\r\n" * 9), (None, "n", "n"), (7, "x", ""), (8, "h", "x" * 300_000)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(2), records_per_file=3).collect()
    owners = {}
    for i, _, h in rows:
        owners.setdefault(h or "", []).append(i)
    assert len(got) == len(rows)
    for r in got:
        body = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
        owner = max((x for x in owners[body.decode()] if x is not None), default=None)
        revisit = owner is not None and owner != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", owner) if revisit else ("response", None))


def test_warc_long_chain_least_size_and_empty(spark):
    rows = [(i, "u", "same") for i in range(70)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).coalesce(1), least_bytes=5, records_per_file=1000).collect()
    assert sorted(r.page_id for r in got) == list(range(70)) and {r.record_type for r in got} == {"response"}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def record(ident, body, kind=b"response", length=None, digest=None):
    digest = base64.b32encode(hashlib.sha1(body).digest()) if digest is None else digest
    return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, ident, digest, len(body) if length is None else length, body)


def read_file(spark, tmp_path, data, **options):
    path = f"{tmp_path}/{hashlib.sha1(data).hexdigest()}.warc"
    with open(path, "wb") as out:
        out.write(data)
    got = warc.read_archives(spark, path, **options).collect()
    return sorted((r.page_id, r.payload_bytes, r.intact) for r in got), [(r.begin, r.end) for r in warc.damaged(spark, path).orderBy("begin").collect()]


def test_damaged_archives_are_told_and_taken_up_again(spark, tmp_path, monkeypatch):
    a, b, c = record(1, b"first body"), record(2, record(77, b"inner")), record(3, b"x" * 300)
    whole = [(1, 10, True), (2, len(record(77, b"inner")), True), (3, 300, True)]
    assert read_file(spark, tmp_path, a + b + c) == (whole, [])
    for data, rows, gaps in [
        (a + b + c[:-70], whole[:2], [(len(a + b), len(a + b + c) - 70)]),
        (a + b"123456789" + b + c, whole, [(len(a), len(a) + 9)]),
        (b"junk" + a + c, [whole[0], whole[2]], [(0, 4)]),
        (a + record(5, b"cut", length=11) + c, [whole[0], whole[2]], [(len(a), len(a + record(5, b"cut", length=11)))]),
        (b"nothing here", [], [(0, 12)]),
    ]:
        with pytest.raises(ValueError, match="damaged"):
            read_file(spark, tmp_path, data)
        assert read_file(spark, tmp_path, data, on_damage="skip") == (rows, gaps)
    with pytest.raises(Exception, match="payload without its digest"):
        read_file(spark, tmp_path, a + record(4, b"abc", digest=b"A" * 32))
    assert read_file(spark, tmp_path, a + record(4, b"abc", digest=b"A" * 32), on_damage="skip") == ([whole[0], (4, 3, False)], [])
    packed = gzip.compress(a) + gzip.compress(b + c)
    assert read_file(spark, tmp_path, packed) == (whole, [])
    with pytest.raises(ValueError, match="damaged"):
        read_file(spark, tmp_path, packed[:-3])
    assert read_file(spark, tmp_path, b"") == ([], [])


def test_chains_over_many_chunks_and_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    bodies = [rng.randbytes(rng.randrange(3000)) + record(500 + k, b"inner") * (k % 3) for k in range(120)]
    data = b"".join(record(k, body) for k, body in enumerate(bodies))
    own = list(warc._nodes([pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([data])], ["a", "b"])]))
    monkeypatch.setattr(warc, "CHUNK", 100)
    monkeypatch.setattr(warc, "HEAD", 300)
    small = list(warc._nodes([pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([data])], ["a", "b"])]))
    assert sorted(map(str, pa.Table.from_batches(small).to_pylist())) == sorted(map(str, pa.Table.from_batches(own).to_pylist()))
    monkeypatch.undo()
    # a task sees the module as it is imported there, so many blocks need a long file
    big = [record(k, rng.randbytes(60_000)) for k in range(300)]
    rows, gaps = read_file(spark, tmp_path, b"".join(big))
    assert len(b"".join(big)) > 4 * warc.BLOCK and [r[0] for r in rows] == list(range(300)) and all(r[2] for r in rows) and not gaps
    packed = gzip.compress(b"".join(big[:100]))
    assert [r[0] for r in read_file(spark, tmp_path, packed)[0]] == list(range(100))


def test_warc_repeated_rows_and_extra_columns(spark):
    rows = [(1, "u", "same", 5, "x"), (1, "u", "same", 5, "x"), (2, "v", "same", 6, "y"), (3, "w", "own", None, None)]
    frame = spark.createDataFrame(rows, PAGES + ", payload_bytes int, code string")
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(frame).collect())
    assert got == [(1, "revisit", 2, 4), (1, "revisit", 2, 4), (2, "response", None, 4), (3, "response", None, 3)]


TURNS = "conv_id long, turn long, role string, text string"


def chats_by_hand(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    keep = {}
    for c, v in turns.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v for w in turns.values())
        same = [d for d, w in turns.items() if w == v]
        if not longer and c == min(same, key=lambda d: (d is None, d or 0)):
            keep[c] = "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in v)
    return keep


def test_chat_by_hand(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", None), (5, 0, None, "a")]
    rows += [(6, 5, "user", "a"), (6, None, "system", "s"), (6, 5, "user", "a"), (None, 0, "user", "zz"), (7, 0, "user", "ab"), (8, 0, "user", "a"), (8, 1, "assistant", "b"), (8, 9, "user", "c")]
    rows += [(20 + k, t, "user", f"t{t}") for k in range(3) for t in range(0, 3000 + 1500 * k)]
    frame = spark.createDataFrame(rows, TURNS).repartition(4)
    got = {}
    for r in sorted(chat.render(frame).collect(), key=lambda r: (r.conv_id or 0, r.part)):
        assert r.first_turn == r.part * chat.BLOCK + 1
        got[r.conv_id] = got.get(r.conv_id, "") + r.chat
    assert got == chats_by_hand(rows)


def test_chat_of_very_long_texts_and_repeated_rows(spark):
    long = "words and more " * 100_000
    rows = [(1, 0, "user", long), (2, 0, "user", long), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (3, 0, "user", long + "x")]
    got = {r.conv_id: r.chat for r in chat.render(spark.createDataFrame(rows, TURNS).repartition(3)).collect()}
    assert got == chats_by_hand(rows) and set(got) == {2, 3}


def test_chat_empty_and_clashing_names(spark):
    assert chat.render(spark.createDataFrame([], TURNS)).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "a", "p", 3)], TURNS + ", conv string, pos int")
    assert [r.chat for r in chat.render(odd).collect()] == ["<|user|>\na<|end|>\n"]
