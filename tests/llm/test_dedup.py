import hashlib
import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.llm import exact_dedup, line_dedup, near_dup
from vigilake.llm.shingles import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF01 = "/root/testdata/sf0.01"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def test_trie_spills_whole_subtrees():
    trie, texts = exact_dedup.PatriciaTrie("largest"), [b"", b"a", b"ab", b"abc", b"abd", b"b", b"bcd", b"bce" * 50]
    for i, t in enumerate(texts * 2):
        trie.insert(t, i)
    spilled = list(trie.spill())
    rest = list(trie.drain())
    assert {k for k, _, _ in spilled}.isdisjoint(k for k, _, _ in rest)
    assert {(k, o, n) for k, o, n in spilled + rest} == {(t, i + len(texts), 2) for i, t in enumerate(texts)}


def test_trie_lets_go_of_what_comes_before():
    rng = random.Random(2)
    texts = sorted({bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randrange(12))) for _ in range(400)} | {b"", b"a" * 500, b"a" * 499 + b"b"})
    for every in (1, 7):
        trie, got, most = exact_dedup.PatriciaTrie(), [], 0
        for k, t in enumerate(x for t in texts for x in (t, t)):
            trie.insert(t, k)
            if k % every == 0:
                let = list(trie.pass_by(t))
                assert all(x < t for x, _, _ in let)
                got += let
                most = max(most, trie.total)
        got += trie.drain()
        assert sorted(got) == [(t, 2 * i, 2) for i, t in enumerate(texts)] and most < 40 * 400


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("budget", [48_000_000, 300])
def test_exact_dedup_by_hand(spark, keep, budget):
    rows = [(3, "a"), (1, "a"), (2, "A"), (4, ""), (5, None), (None, "a"), (None, "z"), (7, "x" * 200_000), (6, "x" * 200_000), (8, "y"), (8, "y")]
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(docs_of(spark, rows).repartition(3), keep, budget).collect()}
    pick = min if keep == "smallest" else max
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", []).append(i)
    assert exact_dedup.exact_dedup(docs_of(spark, rows)).count() == len(rows)
    for i, t in rows:
        ids = by_text[t or ""]
        known = [x for x in ids if x is not None]
        r = got[i, hashlib.sha256((t or "").encode()).hexdigest()]
        assert r.keep_id == (pick(known) if known else None) and r.group_size == len(ids) and r.kept == (i == r.keep_id)


def test_exact_dedup_empty_and_clashing_names(spark):
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, "a", 5, "q"), (2, "a", 6, "r")], "doc_id long, text string, keep_id long, kept string")
    assert {r.keep_id for r in exact_dedup.exact_dedup(odd).collect()} == {1}


def lines_by_hand(rows):
    seen, first = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    windows = {}
    for i, t in order:
        lines = (t or "").split("\n")
        for k in range(max(1, len(lines) - 2)):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip():
                windows.setdefault(w, []).append((i, k))
    gone = {}
    for places in windows.values():
        for i, k in places[1:]:
            gone.setdefault(i, set()).update(range(k, k + 3))
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(i, ())) for i, t in rows}


def test_line_dedup_by_hand(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, "a\nb"), (5, ""), (6, None), (7, "\n\n\n"), (8, "\n\n\n"), (9, "a\na\na\na\na\na"), (None, "b\nc\nd"), (10, "é\n" * 3000)]
    out = line_dedup.line_dedup(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.text or "" for r in out} == lines_by_hand(rows)
    assert len(out) == len(rows) and out[0].lang is None


def test_line_dedup_of_very_long_texts_is_linear(spark):
    def seconds(n):
        text = "\n".join(f"line {k}" for k in range(n))
        began = time.time()
        got = {r.doc_id: (r.text, r.n) for r in line_dedup.line_dedup(docs_of(spark, [(1, text), (2, text + "\nend"), (3, "a")])).select("doc_id", "text", F.size("removed").alias("n")).collect()}
        assert got == {1: (text, 0), 2: ("end", n), 3: ("a", 0)}
        return time.time() - began

    seconds(1000)
    assert seconds(160_000) < 8 * max(2, seconds(40_000))


def test_line_dedup_tells_the_most_frequent_windows(spark, monkeypatch):
    rows = [(i, f"top\nof\npage\nown {i}\nend {i % 5}\nx\ny") for i in range(60)]
    for n in (1, 3, 1000):
        monkeypatch.setattr(line_dedup, "HOT", n)
        assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs_of(spark, rows).repartition(4)).collect()} == lines_by_hand(rows)


def test_line_dedup_repeated_rows_empty_and_clashing_names(spark):
    assert [r.text for r in line_dedup.line_dedup(docs_of(spark, [(1, "a\nb\nc"), (1, "a\nb\nc")])).collect()] == ["a\nb\nc"] * 2
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, "a\nb\nc", 1, "p"), (2, "a\nb\nc", 2, "q")], "doc_id long, text string, pos long, doc string")
    got = {r.doc_id: (r.text, r.pos, r.doc, r.removed) for r in line_dedup.line_dedup(odd).collect()}
    assert got == {1: ("a\nb\nc", 1, "p", []), 2: ("", 2, "q", [0, 1, 2])}


def sets_of(rows, width=5):
    out = []
    for _, t in rows:
        words = WORD.findall((t or "").lower())
        out.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    return out


def near_by_hand(rows, similarity=0.8):
    sets, links = sets_of(rows), [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, j in {p for h in holders.values() for p in combinations(h, 2)}:
        shared = len(sets[i] & sets[j])
        if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    classes = {}
    for i, (doc, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(doc)
    return {doc: (min(x for x in classes[find(i)]), links[i]) for i, (doc, _) in enumerate(rows)}


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    want = near_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs).collect()}
    assert sum(n > 0 for _, n in want.values()) > 100
    assert got == want


def test_near_duplicates_in_one_large_group_and_split_buckets(spark):
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(300):
        own = list(words)
        own[i % 120] = f"own{i}"
        own[(7 * i) % 120] = f"more{i % 9}"
        rows.append((i, " ".join(own)))
    shared = " ".join(f"p{k}" for k in range(60))
    rows += [(1000 + i, shared + " " + " ".join(f"z{i}x{k}" for k in range(200))) for i in range(150)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs_of(spark, rows), limit=16, block=64).collect()}
    assert got == near_by_hand(rows)


def test_near_duplicates_of_similar_texts_in_buckets_over_the_limit(spark):
    """Pairs near the threshold, all of them with one long passage, so that every bucket is split; and a large class of near copies."""
    rng = random.Random(12)
    passage, rows = [f"p{k}" for k in range(90)], []
    for i in range(300):
        own = [f"u{i}x{k}" for k in range(110)]
        other = list(own)
        for k in range(3 + i % 2):
            other[10 + 25 * k] = f"changed{i}x{k}"
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + other))]
    base = [f"b{k}" for k in range(150)]
    for i in range(200):
        own = list(base)
        own[rng.randrange(150)] = f"n{i}"
        rows.append((10_000 + i, " ".join(own)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs_of(spark, rows).repartition(6), limit=64).collect()}
    assert got == near_by_hand(rows)
    assert sum(c != i for i, (c, _) in got.items()) >= 300 + 199


def test_large_buckets_compare_all_pairs_after_the_last_step(spark):
    """No step but the last: what is over the limit is compared in pairs of blocks."""
    rows = [(i, " ".join([f"s{k}" for k in range(30)] + [f"t{i // 2}x{k}" for k in range(200)] + [f"e{i}"])) for i in range(200)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs_of(spark, rows), limit=16, depth=1).collect()}
    assert got == near_by_hand(rows)


def test_vector_compare_matches_the_plain_one():
    rng = random.Random(3)
    members = []
    for i in range(120):
        n = rng.choice([5, 30, 48, 48, 48])
        values = sorted({rng.randrange(2**32) if rng.random() < 0.3 else 7919 * (k + i % 4) * 50_000 % 2**32 for k in range(n)})
        members.append((len(values) * rng.choice([1, 1, 2]) if len(values) == 48 else len(values), bytes([i]), np.array(values, "<u4").tobytes()))
    members.sort()
    alike = near_dup.marks_for(0.8)[0]
    groups = near_dup._Groups()
    for a, b in near_dup._compare(members, 0.8, alike):
        groups.join(a, b)
    plain, few = near_dup._Groups(), [near_dup._Sketch(*m) for m in members]
    for i, x in enumerate(few):
        for y in few[:i]:
            if y.size >= 0.8 * x.size - 1e-6 and x.like(y) >= alike:
                plain.join(x.sid, y.sid)
    assert {m[1]: groups.find(m[1]) for m in members} == {m[1]: plain.find(m[1]) for m in members} and len(set(map(plain.find, [m[1] for m in members]))) < 120


@pytest.mark.parametrize("similarity", [0.5, 0.9])
def test_near_duplicates_at_other_similarities(spark, similarity):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        own = [f"u{i}x{k}" for k in range(60)]
        for j in range(4):
            rows.append((4 * i + j, " ".join(w if rng.random() > 0.02 * j else f"c{i}{j}{k}" for k, w in enumerate(own))))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs_of(spark, rows), similarity=similarity).collect()}
    assert got == near_by_hand(rows, similarity)


def test_near_duplicates_repeated_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words are here now"), (2, "A b c d e f g!")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_dup.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [(1, 1, 0), (1, 1, 2), (1, 1, 2), (2, 1, 2)]


def test_near_duplicates_edge_cases(spark):
    assert near_dup.near_duplicates(docs_of(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (3, "!!"), (4, "one two"), (5, "One, two."), (6, "one"), (7, "a " * 50_000), (8, "a " * 60_000), (None, "one two")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 2), 5: (4, 2), 6: (6, 0), 7: (7, 1), 8: (7, 1), None: (4, 2)}
    odd = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "A b c d e f", "t"), (3, "g", None)], "doc_id long, text string, sid string")
    assert sorted(tuple(r) for r in near_dup.drop_near_duplicates(odd).collect()) == [(1, "a b c d e f", "s"), (3, "g", None)]


def grouped(rows, key):
    """The groups of at least two (doc_id, code) that a column tells apart."""
    held: dict = {}
    for r in rows:
        held.setdefault(r[key], set()).add((r.doc_id, r.code))
    return sorted(sorted(g) for g in held.values() if len(g) > 1)


@pytest.mark.parametrize("block", [4, 16, 1024])
def test_classes_without_counts_are_those_with_counts(spark, block):
    """Near copies over many blocks, chains of texts each like the next, and texts that only share a passage."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    base, passage = rng.sample(words, 120), rng.sample(words, 60)
    texts = [" ".join(w if k != i % 120 else "odd" for k, w in enumerate(base)) for i in range(90)]
    chain = rng.sample(words, 400)
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 120, 4)]
    texts += [" ".join(passage + rng.sample(words, 40)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[-1], "", "one two", None]
    docs = docs_of(spark, list(enumerate(texts)))
    counted = [r for r in near_dup.near_duplicates(docs, block=block, limit=32).collect() if r.n_links]
    got = grouped(near_dup.near_classes(docs, block=block, limit=32).collect(), "class")
    assert got == grouped(counted, "class_id") and len(got) >= 3


def test_a_large_class_is_compared_in_its_blocks_only(spark, monkeypatch):
    """Of near copies over many blocks no pair of blocks is compared but with itself, and a head of each with the others."""
    seen = []
    verified = near_dup._verified
    monkeypatch.setattr(near_dup, "_verified", lambda dealt, *more: seen.append(dealt.count()) or verified(dealt, *more))
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(80)]
    rows = [(i, " ".join(w if k != i % 80 else f"x{i}" for k, w in enumerate(base))) for i in range(1500)]
    got = near_dup.near_classes(docs_of(spark, rows), block=64)
    assert got.groupBy("class").count().select("count").collect() == [(1500,)]
    assert seen[0] == 1500 and seen[1] <= 40 and seen[2:] == [0]
