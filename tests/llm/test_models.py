import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.llm import decontamination, pii, queries, toxicity

SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


# --- decontamination


def least_cost(piece, text):
    """The least edits of piece against any part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(piece, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def found_by_hand(docs, items, rate=0.1, piece=80, least=40):
    out = set()
    for item, text in items:
        body = decontamination.normal(text or "")
        if len(body) < least:
            continue
        cuts = max(1, len(body) // piece)
        parts = [body[k * piece : (k + 1) * piece if k + 1 < cuts else len(body)] for k in range(cuts)]
        for doc, own in docs:
            own = decontamination.normal(own or "")
            if any(least_cost(p, own) <= int(rate * len(p)) for p in parts):
                out.add((doc, item))
    return out


def noisy(rng, text, n):
    text = list(text)
    for _ in range(n):
        at, how = rng.randrange(len(text)), rng.randrange(3)
        text[at : at + (how != 0)] = [rng.choice("abcxyz")] if how != 1 else []
    return "".join(text)


def test_leaks_match_the_plain_table(spark):
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choice(["th", "an", "er", "in", "ou", "st", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."

    items = [(i, prose(rng.randint(8, 60))) for i in range(12)] + [(90, ""), (91, None), (92, "short one")]
    docs = []
    for i in range(60):
        body = prose(rng.randint(5, 120))
        if i % 3:
            text = items[i % 12][1]
            size = [len(text), 60, 100, 170][i % 4]
            begin = rng.randrange(max(1, len(text) - size + 1))
            body += " " + noisy(rng, text[begin : begin + size], rng.choice([0, 3, 8, 14, 30])) + " " + prose(20)
        docs.append((i, body))
    docs += [(200, None), (201, ""), (202, "x"), (None, items[0][1]), (204, (prose(40) + " ") * 60 + items[1][1].upper())]
    frame, bench = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = found_by_hand(docs, items)
    for block_chars in (4_000_000, 1000):
        got = decontamination.leaks(frame, bench, block_chars=block_chars).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    texts = dict(docs)
    for r in got:
        assert decontamination.normal(texts[r.doc_id][r.begin : r.end])
    assert 10 < len(want) < 60
    kept = [r.doc_id for r in decontamination.decontaminate(frame, bench).collect()]
    assert sorted(map(str, kept)) == sorted(str(i) for i, _ in docs if i not in {d for d, _ in want})


def test_leaks_of_whole_tables(spark):
    docs, bench = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, SF01).collect()}
    rows = [(r.doc_id, decontamination.normal(r.text)) for r in docs.collect()]
    whole = {(d, b.item_id) for b in bench.collect() for d, t in rows if decontamination.normal(b.text) in t}
    assert len(whole) > 10 and whole <= got
    odd = [(d, i) for d, i in got - whole]
    items = {b.item_id: b.text for b in bench.collect()}
    assert {p for d, i in odd for p in found_by_hand([(d, dict(rows)[d])], [(i, items[i])])} == set(odd)


def test_decontamination_edge_cases(spark):
    bench = spark.createDataFrame([(1, "word " * 30)], "item_id long, text string")
    assert decontamination.leaks(spark.createDataFrame([], DOCS), bench).count() == 0
    none = bench.limit(0)
    assert decontamination.leaks(spark.createDataFrame([(1, "a")], DOCS), none).count() == 0
    odd = spark.createDataFrame([(1, "word " * 40, 7), (2, "other", 8)], DOCS + ", item_id long")
    assert [tuple(r) for r in decontamination.decontaminate(odd, bench).collect()] == [(2, "other", 8)]


# --- personal data


def plain_base(text):
    """The patterns as they are stated."""
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(re.findall("[0-9]", m[0])) <= 19 and pii.luhn("".join(re.findall("[0-9]", m[0])))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    for k in range(4000):
        text = "".join(rng.choice(["1", "23", "4111 1111 1111 1111", "@", ".", "a", "b_c", "%", "+", "+1 (415) 555-0100", "-", " ", "é", "x@y.z", "10.0.0.1", "256", "\n", "(", ")", "00", "٣"]) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text) == plain_base(text), text


def test_base_spans_of_long_runs_are_quick():
    assert pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + "@") == []


def lines_of(seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(["th", "an", "er", "ing", "ou", "st", "re", "é", "zu"]) for _ in range(rng.randint(1, 4))) for _ in range(20)) for _ in range(200)]


@pytest.fixture(scope="module")
def tagger():
    return pii.train(lines_of(2))


def test_tagger_on_held_out_spans(tagger):
    x, y = pii.examples(lines_of(3), 400, seed=77)
    told = pii._emissions(tagger, x).transpose(1, 0, 2)
    tags = pii.viterbi(told.reshape(-1, 5), np.full(400, pii.WINDOW), tagger.moves).reshape(400, -1).T
    assert (tags == y).mean() > 0.97
    for k in range(1, 5):
        assert (tags[y == k] == k).mean() > 0.85


def test_viterbi_and_crf_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    e, moves = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3))
    for row in range(2):
        score = {p: sum(e[t, row, p[t]] for t in range(4)) + sum(moves[p[t - 1], p[t]] for t in range(1, 4)) for p in product(range(3), repeat=4)}
        assert tuple(pii.viterbi(e[:, row], np.array([4]), moves)) == max(score, key=score.get)
    tags = np.array([[0, 1], [2, 2], [1, 0], [1, 1]])
    loss, de, dm = pii._crf(e, tags, moves)
    for at in [(0, 0, 1), (3, 1, 2)]:
        up = e.copy()
        up[at] += 1e-5
        assert abs((pii._crf(up, tags, moves)[0] - loss) / 1e-5 - de[at]) < 1e-4
    up = moves.copy()
    up[1, 2] += 1e-5
    assert abs((pii._crf(e, tags, up)[0] - loss) / 1e-5 - dm[1, 2]) < 1e-4


def test_viterbi_of_long_sequences_matches_the_plain_recursion():
    rng = np.random.default_rng(3)
    lengths, moves = np.array([0, 1, 63, 64, 65, 0, 128, 129, 1000]), rng.normal(size=(5, 5)) * 2
    e = rng.normal(size=(lengths.sum(), 5))
    got, at = pii.viterbi(e, lengths, moves), 0
    for n in lengths:
        own, ways = e[at : at + n], []
        if n:
            best = own[0]
            for t in range(1, n):
                every = best[:, None] + moves
                ways.append(every.argmax(0))
                best = every.max(0) + own[t]
            tags = [int(best.argmax())]
            for w in ways[::-1]:
                tags.append(int(w[tags[-1]]))
            assert got[at : at + n].tolist() == tags[::-1]
        at += n


def test_windows_are_joined_by_their_emissions(tagger):
    """One decode of the mean emissions of all windows of a text, spelled out."""
    rng = random.Random(9)
    text = "".join(rng.choice(["call (415) 555-0137 ", "some words ", "a@b.de ", "12 ", "\n", "10.0.0.1 "]) for _ in range(90))
    coded, step = pii.symbols(text), pii.WINDOW - pii.OVERLAP
    total, weight = np.zeros((len(text), 5)), np.zeros(len(text))
    for w in range(0, max(1, -(-(len(text) - pii.WINDOW) // step) + 1)):
        row = np.zeros(pii.WINDOW, np.uint8)
        part = coded[w * step : w * step + pii.WINDOW]
        row[: len(part)] = part
        own = pii._emissions(tagger, row[:, None])[:, 0]
        for j in range(len(part)):
            inside = min(j + 1, pii.WINDOW - j)
            total[w * step + j] += inside * own[j]
            weight[w * step + j] += inside
    want = pii.viterbi((total / weight[:, None]).astype(np.float32), np.array([len(text)]), tagger.moves)
    got = pii.tag_texts(tagger, ["", text, "no sign"])
    assert (got[1] == want).mean() > 0.999 and (got[1] > 0).any() and not got[0].any() and not got[2].any()


def test_pii_query_matches_the_patterns_row_by_row(spark, tmp_path):
    """All columns of the contract beside plain patterns, and what may be added."""
    filler = "nothing to see in this line, "
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(900_001, None), (900_002, ""), (900_003, filler * 9000 + "x@y.zz 10.0.0.1"), (900_004, "a@b.c"), (900_004, "a@b.c"), (None, "+1 (415) 555-0100"), (900_005, "4111 1111 1111 1111 é 😀 a@b.de")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS + ", spans int, kind string")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op2_pii(spark, str(tmp_path)).collect()
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found), key=str)

    def listed(spans):
        return ",".join(f"{pii.KINDS[k]}:{i}:{j}" for i, j, k in spans)

    want = []
    for i, t in rows:
        spans = plain_base(t or "")
        want.append((i, *[sum(k == n for _, _, k in spans) for n in range(4)], hashlib.sha256(listed(spans).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    texts = {i: t or "" for i, t in rows}
    for r in found:
        spans = [(int(b), int(e), pii.KINDS.index(k)) for k, b, e in (x.split(":") for x in r.spans.split(",") if x)]
        base = plain_base(texts[r.doc_id])
        assert spans == sorted(spans, key=lambda s: (s[0], s[2])) and set(base) <= set(spans) and r.n_added == len(spans) - len(base)
        for b, e, k in set(spans) - set(base):
            assert pii.acceptable(k, texts[r.doc_id][b:e]) and all(e <= i or j <= b for i, j, _ in base)


def test_spans_added_and_base_kept(spark, tagger):
    filler = "the words go on and on in this line of text that says nothing at all, "
    rows = [(1, "mail john.smith@example.com or call +1 (415) 555-0100 today"), (2, filler * 5 + "reach me at (415) 555-0137 or at mary (at) example (dot) org please. " + filler * 5)]
    rows += [(3, None), (4, ""), (5, filler * 2000 + " x@y.zz"), (None, "10.0.0.1"), (6, "on 2024-01-02 we paid 12.50 for v1.2.3 and 4111111111111112")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, DOCS), tagger).collect()}
    texts = dict(rows)
    for doc, spans in got.items():
        assert [(s.begin, s.end, pii.KINDS.index(s.kind)) for s in spans if s.base] == plain_base(texts[doc] or "")
    assert got[3] == got[4] == got[6] == []
    added = {(s.kind, texts[2][s.begin : s.end]) for s in got[2]}
    assert any(k == "phone" and "555-0137" in t for k, t in added)
    assert pii.find(spark.createDataFrame([], DOCS), tagger).count() == 0


def test_windows_do_not_change_with_place(tagger):
    span = "call (415) 555-0137 now"
    for shift in range(0, 200, 17):
        text = "some words here " * 12 + "x" * (shift % 16) + " " + span + " " + "and more words " * 12
        tags = pii.tag_texts(tagger, [text])[0]
        at = text.index("(415)")
        assert (tags[at + 2 : at + 13] == 4).mean() > 0.7


# --- toxicity


def test_marginals_match_the_plain_recursion():
    rng = np.random.default_rng(0)
    lengths = np.array([0, 5, 70, 1, 33, 32, 0, 300])
    scores, moves = 2 * rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    got, at, m = toxicity.marginals(scores, lengths, moves), 0, np.exp(moves)
    for n in lengths:
        own = scores[at : at + n]
        ahead, back = [np.array([1.0, 0.0])], [np.ones(2)]
        for s in own:
            v = (ahead[-1] @ m) * np.array([1, np.exp(s)])
            ahead.append(v / v.sum())
        for s in own[::-1]:
            back.append(m @ (back[-1] * np.array([1, np.exp(s)])))
            back[-1] /= back[-1].sum()
        for i in range(n):
            joint = ahead[i + 1] * back[n - 1 - i]
            assert abs(joint[1] / joint.sum() - got[at + i]) < 1e-9
        at += n
    assert len(toxicity.marginals(np.empty(0), np.array([0, 0]), moves)) == 0


def toy(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["fool", "SCUM"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_and_marks(spark):
    rows, labels = toy(spark)
    docs = spark.createDataFrame(rows, DOCS)
    marked = spark.createDataFrame(labels + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    field = toxicity.train(docs, marked)
    extra = spark.createDataFrame([(1000, "alpha1 scum beta2"), (1001, None), (1002, ""), (1003, "alpha1 beta2 " * 20_000), (1004, "alpha1 " * 30_000 + "fool"), (None, "x")], DOCS)
    got = {r.doc_id: r for r in toxicity.score(extra, field).collect()}
    assert got[1000].score > 0.5 and [(s.begin, s.end) for s in got[1000].spans] == [(7, 11)]
    assert got[1004].score > 0.5 and [(s.begin, s.end) for s in got[1004].spans] == [(210_000, 210_004)]
    assert all(0 <= got[k].score < 0.5 and got[k].spans == [] for k in (1001, 1002, 1003, None))
    wide = docs.withColumn("score", F.lit("s")).withColumn("spans", F.lit(1))
    kept = {r.doc_id for r in toxicity.drop_toxic(wide, field).collect()}
    assert kept == {i for i, bad in labels if not bad}
    assert toxicity.score(spark.createDataFrame([], DOCS), field).count() == 0


def test_toxicity_of_repeated_rows_and_clashing_names(spark):
    rows, labels = toy(spark)
    docs = spark.createDataFrame([(i, t, "clash", 1, i) for i, t in rows + rows[:9]], DOCS + ", score string, spans int, label int")
    field = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = [(r.doc_id, r.score >= 0.5) for r in toxicity.score(docs, field).collect()]
    assert sorted(got) == sorted((i, bool(bad)) for i, bad in labels + labels[:9])
    assert toxicity.drop_toxic(docs, field).columns == docs.columns


def test_toxicity_learns_from_a_stretch_of_a_long_text(spark):
    rows, labels = toy(spark)
    long = [(1000 + k, "alpha1 beta2 " * 5000 + t) for k, (_, t) in enumerate(rows[:40])]
    docs = spark.createDataFrame(rows + long, DOCS)
    field = toxicity.train(docs, spark.createDataFrame(labels + [(1000 + k, labels[k][1]) for k in range(40)], "doc_id long, toxic int"), sample_chars=2000)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, field).collect()}
    assert sum(got[i] == bool(bad) for i, bad in labels) >= 0.99 * len(labels)


def test_toxicity_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], DOCS)
    for labels, high in (([], False), ([(1, 0)], False), ([(1, 1)], True)):
        field = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all((r.score > 0.5) == high for r in toxicity.score(docs, field).collect())


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in labels)
    right = sum(got[r.doc_id].predicted == r.toxic for r in labels)
    hits = sum(got[r.doc_id].predicted for r in labels if r.toxic)
    assert right >= 0.97 * len(labels) and hits >= 0.85 * sum(r.toxic for r in labels)
