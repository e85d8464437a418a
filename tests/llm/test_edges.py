"""Plain recomputations and odd inputs of operators that other tests only meet in passing."""

import base64
import hashlib
import math
import os

import numpy as np
import pytest

from tests.conftest import SF, SF01
from vigilake.llm import decontamination, exact_dedup, near_dup, queries, token_files, toxicity, warc

TEXTS = "doc_id long, text string"


def plain_score(field, text):
    """Score, and number of words with a marginal of at least a half, by the recursion over single words."""
    words = toxicity.WORD.findall(text.lower())
    own = [min(30.0, max(-30.0, float(sum(field.weights[f] for f in toxicity.features(w))))) for w in words]
    m, ahead, back = np.exp(field.moves), [np.array([1.0, 0.0])], [np.ones(2)]
    for s in own:
        v = (ahead[-1] @ m) * np.array([1, math.exp(s)])
        ahead.append(v / v.sum())
    for s in own[::-1]:
        v = m @ (back[-1] * np.array([1, math.exp(s)]))
        back.append(v / v.sum())
    p = [(j := ahead[i + 1] * back[len(own) - 1 - i])[1] / j.sum() for i in range(len(own))]
    top = min(max(max(p, default=0), 1e-6), 1 - 1e-6)
    x = field.curve @ np.array([1.0, math.log(top / (1 - top)), math.log(max(sum(p), 1e-6))])
    return 1 / (1 + math.exp(-min(30, max(-30, x)))), p


def test_toxicity_rows_from_the_fitted_field(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    field = queries.toxicity_field(spark, docs, SF01)
    got = {r.doc_id: r for r in toxicity.score(docs, field).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        score, p = plain_score(field, text)
        assert abs(got[doc].score - score) < 1e-9
        sure = sum(x >= 0.5 + 1e-9 for x in p), sum(x >= 0.5 - 1e-9 for x in p)
        assert sure[0] <= len(got[doc].spans) <= sure[1] and (got[doc].score >= 0.5) == (score >= 0.5)


def test_leaks_with_clashing_names(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards brew potions in the old tower at night."
    docs = spark.createDataFrame([(1, f"Before it {item} and after", 9, 9, 9, "x"), (2, "nothing here", 9, 9, 9, "x")], f"{TEXTS}, item_id long, begin int, edits int, code string")
    bench = spark.createDataFrame([(5, item, 1, "y")], "item_id long, text string, doc_id long, code string")
    got = decontamination.leaks(docs, bench, stride=20).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(1, 5, 0)]
    assert [r.doc_id for r in decontamination.decontaminate(docs, bench, stride=20).collect()] == [2]


def test_near_duplicates_with_clashing_names_and_a_very_long_text(spark):
    long = " ".join(f"n{k}" for k in range(1_000_000))
    rows = [(1, long, "s", 1), (2, long + " more", "s", 1), (3, "a b c d e f g", "s", 1), (4, None, None, None)]
    docs = spark.createDataFrame(rows, f"{TEXTS}, sid string, class int").selectExpr("*", "1 as root", "2 as block", "3 as code", "4 as n_links", "5 as class_id")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_exact_dedup_of_texts_that_begin_each_other(spark):
    """Each of thousands of texts is the beginning of the next: a trie as deep as they are many."""
    rows = [(i, "ab" * i) for i in range(3000)] + [(9000, "ab" * 1500), (9001, None)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, TEXTS).repartition(3), keep="largest").collect()}
    assert len(got) == len(rows) and got[1500] == (9000, 2) and got[0] == (9001, 2)
    assert all(got[i] == (i, 1) for i in range(1, 3000) if i != 1500)


def test_token_files_with_clashing_names(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(2, "two words", 1, 2, 3), (1, None, 1, 2, 3)], f"{TEXTS}, start long, n_tokens int, ids int")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(docs, str(tmp_path / "t"), path, end_id=2)
    got = {r.doc_id: (r.start, r.n_tokens) for r in token_files.checksums(token_files.read_tokens(spark, str(tmp_path / "t"))).collect()}
    assert got[1] == (0, 1) and got[2][0] == 1


def test_chat_of_many_rows_with_one_turn_number(spark):
    """Rows that share a turn, or have none, go by role and text; nothing is lost."""
    from vigilake.llm import chat

    rows = [(None, None, "user", f"{k:05d}") for k in range(3000)] + [(1, 5, "user", "b"), (1, 5, "assistant", "a"), (1, None, "user", "c")]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    parts = sorted((r.first_turn, r.chat) for r in got if r.conv_id is None)
    assert sum(c.count("<|end|>") for _, c in parts) == 3000 and [n for n, _ in parts] == [1, 1025, 2049]
    assert [r.chat for r in got if r.conv_id == 1] == ["<|user|>\nc<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nb<|end|>\n"]


PAGES = "page_id long, url string, html string"


def test_archives_bounded_by_bytes_and_long_urls(spark, tmp_path, monkeypatch):
    rows = [(k, "u" * (100_000 if k == 3 else 9), f"{k:04d}" * (100_000 * (k % 4) + 1)) for k in range(24)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path, most_bytes=4 << 20)
    files = [f for f in os.listdir(path) if f.endswith(".gz")]
    assert len(files) >= 6
    monkeypatch.setattr(warc, "TOLD", 3)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == 24 and all(got[i].payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for i, _, h in rows)
    assert len(got[3].url) == warc.URL and all(r.intact for r in got.values())


@pytest.mark.parametrize("n", [60])
def test_a_file_damaged_in_many_places_is_read_in_one_go(spark, tmp_path, n):
    record = lambda k: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: 5\r\n\r\nbody{k % 10}\r\n\r\n".encode()
    junk = b"junk between records"
    path = tmp_path / "a.warc"
    path.write_bytes(b"".join(junk + record(k) for k in range(n)) + junk)
    got = warc.read_archives(spark, str(path), on_damage="skip").collect()
    assert sorted(r.page_id for r in got) == list(range(n))
    gaps = [(r.begin, r.end) for r in warc.damaged(spark, str(path)).orderBy("begin").collect()]
    assert len(gaps) == n + 1 and all(e - b == len(junk) for b, e in gaps)
    with pytest.raises(ValueError, match="at byte 0"):
        warc.read_archives(spark, str(path))


def test_whole_tables_still_agree(spark):
    """Classes with and without counts on a whole table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counted: dict = {}
    for r in near_dup.near_duplicates(docs).where("n_links > 0").collect():
        counted.setdefault(r.class_id, set()).add(r.doc_id)
    found: dict = {}
    for r in near_dup.near_classes(docs).collect():
        found.setdefault(r["class"], set()).add(r.doc_id)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, counted.values()))
