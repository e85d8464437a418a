"""Parts of benchmark items cut anywhere, and short items."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_models import DOCS, found_by_hand, least_cost, noisy
from vigilake.llm import decontamination, queries

PIECE, STRIDE = 80, 20


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture
def copies():
    """Documents with a part of an item, cut anywhere: (items, documents, {doc: (item, characters, edits)})."""
    rng = random.Random(11)
    items = [(i, words(rng, rng.randint(18, 70))) for i in range(20)]
    docs, made = [], {}
    for d in range(160):
        text = items[d % 20][1]
        size = min(len(text), rng.choice([40, 60, 99, 110, 140, 200]))
        begin, edits = rng.randrange(len(text) - size + 1), rng.choice([0, 0, 2, 6, 20])
        docs.append((d, f"{words(rng, 40)} {noisy(rng, text[begin : begin + size], edits)} {words(rng, 40)}"))
        made[d] = (d % 20, size, edits)
    return items, docs, made


def windows_found(docs, items):
    """(doc, item) by the plain table: a window of PIECE characters at a stride, or at the end, or a piece side by side."""
    out = found_by_hand(docs, items)
    for item, text in items:
        starts = {*range(0, max(1, len(text) - PIECE + 1), STRIDE), max(0, len(text) - PIECE)}
        parts = [text[k : k + PIECE] for k in starts]
        out |= {(d, item) for d, own in docs if any(least_cost(p, decontamination.normal(own)) <= len(p) // 10 for p in parts)}
    return out


def test_parts_cut_anywhere_are_found(spark, copies, tmp_path):
    items, docs, made = copies
    frame, bench = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, str(tmp_path)).collect()}
    sure = {(d, i) for d, (i, size, edits) in made.items() if not edits and size >= PIECE + STRIDE - 1}
    assert len(sure) > 20 and sure <= got
    assert len(sure - {(r.doc_id, r.item_id) for r in decontamination.leaks(frame, bench).collect()}) > 5
    kept = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, frame, str(tmp_path)).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_finds_with_a_stride_match_the_plain_table(spark, copies):
    items, docs, _ = copies
    docs, items = docs[:48], items[:12]
    frame, bench = spark.createDataFrame(docs, DOCS).repartition(2), spark.createDataFrame(items, "item_id long, text string")
    want = windows_found(docs, items)
    for block_chars in (4_000_000, 3000):
        got = decontamination.leaks(frame, bench, block_chars=block_chars, stride=STRIDE).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 10


@pytest.mark.parametrize("stride", [None, STRIDE])
def test_short_items_are_found_as_whole_words(spark, stride):
    items = [(1, "Capital of France?"), (2, "Ω-7"), (3, "rate limit of forty requests"), (4, "capital of"), (5, " !"), (6, None)]
    docs = [(1, "The capital,\nof FRANCE is old"), (2, "capital of frances"), (3, "a ω 7"), (4, "ω 77"), (5, "the rate limit of forty requests"), (6, "rate limit of fourty requests"), (7, "ω 7")]
    frame, bench = spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(frame, bench, stride=stride).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (1, 4), (2, 4), (3, 2), (5, 3), (7, 2)} and len(got) == 6
    texts = dict(docs)
    assert {texts[r.doc_id][r.begin : r.end] for r in got if r.item_id == 1} == {"capital,\nof FRANCE"}
    assert sorted(r.doc_id for r in decontamination.decontaminate(frame, bench, stride=stride).collect()) == [4, 6]


def test_a_stride_loses_no_find(spark):
    text = words(random.Random(5), 40)[:118].strip()
    noisy_text = "".join("#" if c == " " else "0" if 46 <= k < 72 and sum(46 <= j < k and text[j] != " " for j in range(k)) < 11 else c for k, c in enumerate(text)).replace("#", " ")
    assert sum(a != b for a, b in zip(text, noisy_text)) == 11
    frame, bench = spark.createDataFrame([(1, noisy_text)], DOCS), spark.createDataFrame([(7, text)], "item_id long, text string")
    for stride in (None, STRIDE):
        assert [(r.doc_id, r.item_id, r.edits) for r in decontamination.leaks(frame, bench, stride=stride).collect()] == [(1, 7, 11)]


def test_blocks_change_nothing(spark):
    """Items that share an id, repeated rows, items without an id and hot grams, in one block and in many."""
    rng = random.Random(4)
    items = [(1, words(rng, 40)), (1, words(rng, 60)), (None, words(rng, 30)), (2, "the same phrase again and again " * 9), (3, "tiny item"), (3, "tiny one")]
    body = " ".join([words(rng, 9), items[0][1], words(rng, 9), items[1][1], items[2][1], "tiny one, tiny item", items[3][1]])
    rows = [(7, body, "x"), (7, body, "y"), (7, words(rng, 50), "z"), (None, noisy(rng, body, 4), "n"), (8, body, None), (9, None, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = [sorted(map(str, decontamination.leaks(frame, bench, block_chars=n, stride=STRIDE).collect())) for n in (4_000_000, 3000, 100)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 3 * 4
    for n in (4_000_000, 100):
        assert sorted(r.item_id for r in decontamination.decontaminate(frame, bench, block_chars=n, stride=STRIDE).collect()) == ["e", "z"]


def test_grams_with_many_holders_are_taken_in_ranges(monkeypatch):
    rng = random.Random(6)
    stem = words(rng, 12)
    items = [(i, f"{stem} {words(rng, 6)} {stem}") for i in range(60)]
    texts = [f"{words(rng, 30)} {items[k][1]} {words(rng, 30)}" for k in (0, 7, 33)] + [stem]
    index = decontamination.Index(items, 8, 0.1, PIECE, 40, STRIDE)
    whole = [list(decontamination._scan(index, [t])) for t in texts]
    monkeypatch.setattr(decontamination, "_ENTRIES", 500)
    assert [list(decontamination._scan(index, [t])) for t in texts] == whole and [len(w) for w in whole][:3] == [1, 1, 1]


def test_a_text_of_a_million_characters(spark):
    rng = random.Random(8)
    item = words(rng, 40)
    text = words(rng, 90_000) + " " + item + " " + words(rng, 90_000)
    assert len(text) > 1_000_000
    got = decontamination.leaks(spark.createDataFrame([(1, text), (2, "a " * 600_000)], DOCS), spark.createDataFrame([(5, item)], "item_id long, text string"), stride=STRIDE).collect()
    assert [(r.doc_id, r.item_id, r.edits, decontamination.normal(text[r.begin : r.end]) in decontamination.normal(item)) for r in got] == [(1, 5, 0, True)]


def test_places_without_a_run_of_an_item_are_not_looked_up_in_its_pieces(monkeypatch):
    """Words of the items in another order have many known grams, but none that may help a piece to its bound."""
    rng = random.Random(9)
    items = [(i, words(rng, 60)) for i in range(30)]
    parts = [w for _, text in items for w in text.split() if len(w) > 6]
    text = " ".join(rng.choice(parts) for _ in range(4000))
    index, seen = decontamination.Index(items, 8, 0.1, PIECE, 40, STRIDE), []
    banded = decontamination.Index._banded
    monkeypatch.setattr(decontamination.Index, "_banded", lambda self, where, *rest: seen.append(len(where)) or banded(self, where, *rest))
    assert list(decontamination._scan(index, [text])) == [] and sum(seen) < 200
    found = list(decontamination._scan(index, [f"{text} {items[3][1]} {text}"]))
    assert [f[:1] for f in found[0][2]] == [(3,)] and sum(seen) > 200


@pytest.mark.parametrize("text", ["", " \t\x1c\x1f", "It's A_B-c\x7f9\n", "".join(map(chr, range(128))) * 3])
def test_plain_texts_are_normalised_like_others(text):
    assert decontamination.normal(text) == " ".join(decontamination._WORD.findall(text.lower()))
