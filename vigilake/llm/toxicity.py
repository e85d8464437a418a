"""Toxic spans and document scores by a linear-chain conditional random field over words.

Document labels are turned into labelled tokens: a word that stands in many more distinct contexts
of toxic than of clean sample documents is tagged in the toxic ones. Contexts, not documents, are
counted, so copies of one text weigh once. The field has two tags, features of the word's form and
tag transitions, and is fitted in numpy by its forward-backward gradient. Marginals of the toxic
tag give the offending offsets and, by a logistic curve over their largest and their sum, the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_groups import give_back, texts_of, trim
from .common import text_of
from .tokens import forget

WORD = re.compile(r"\w+")
BUCKETS = 1 << 18
#: Log-likelihood ratio, in nats, and ratio of toxic to clean rates, from which a word's contexts count as toxic.
EVIDENCE, LIFT = 12.0, 5.0
_CHUNK = 32


def features(word: str) -> tuple[int, int, int]:
    """Hashed word, prefix and suffix."""
    return tuple(zlib.crc32(x.encode()) % BUCKETS for x in ("w" + word, "p" + word[:5], "s" + word[-4:]))


@dataclass
class Field:
    """weights: of the features for the toxic tag; moves[a, b]: scores of tag b after a, 0 before the first word; curve: bias, weight of the largest marginal's log-odds, weight of the log of their sum."""

    weights: np.ndarray
    moves: np.ndarray
    curve: np.ndarray


class _Scores(dict):
    """Word -> score of the toxic tag, forgotten when it has grown large."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = float(sum(self.weights[f] for f in features(word)))
        return value


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The probability of the toxic tag at each of the words of many texts that stand one after another.

    Texts are cut into chunks of equal length. The 2 x 2 products of all chunks are formed side by
    side, messages are handed from chunk to chunk of each text, and a last pass spreads them inside.
    """
    total = int(lengths.sum())
    if not total:
        return np.empty(0)
    chunks = -(-lengths // _CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    at = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first * _CHUNK, lengths)
    n = int(chunks.sum())
    psi, real = np.ones(n * _CHUNK), np.zeros(n * _CHUNK, bool)
    psi[at], real[at] = np.exp(np.clip(scores, -30, 30)), True
    psi, real = np.ascontiguousarray(psi.reshape(n, _CHUNK).T), np.ascontiguousarray(real.reshape(n, _CHUNK).T)
    (a, b), (c, d) = np.exp(moves)

    def forward(x, y, j):
        u, v = x * a + y * c, (x * b + y * d) * psi[j]
        s = u + v
        return np.where(real[j], u / s, x), np.where(real[j], v / s, y)

    rows = []
    for x, y in ((np.ones(n), np.zeros(n)), (np.zeros(n), np.ones(n))):
        scale = np.zeros(n)
        for j in range(_CHUNK):
            u, v = x * a + y * c, (x * b + y * d) * psi[j]
            s = u + v
            scale += np.where(real[j], np.log(s), 0)
            x, y = np.where(real[j], u / s, x), np.where(real[j], v / s, y)
        rows.append((x, y, scale))
    high = np.maximum(rows[0][2], rows[1][2])
    p = [[row[k] * np.exp(row[2] - high) for k in (0, 1)] for row in rows]

    into, out = np.zeros((n, 2)), np.ones((n, 2))
    held, now = np.argsort(-chunks, kind="stable"), None
    sizes = chunks[held]
    now = np.tile([1.0, 0.0], (len(held), 1))
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k, "left"))  # texts with more than k chunks
        i = first[held[:m]] + k
        into[i] = now[:m]
        x = into[i, 0] * p[0][0][i] + into[i, 1] * p[1][0][i]
        y = into[i, 0] * p[0][1][i] + into[i, 1] * p[1][1][i]
        now[:m] = np.stack([x, y], 1) / (x + y)[:, None]
    now = np.ones((len(held), 2))
    for k in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
        m = int(np.searchsorted(-sizes, -k, "left"))
        i = first[held[:m]] + k
        out[i] = now[:m]
        x = p[0][0][i] * out[i, 0] + p[0][1][i] * out[i, 1]
        y = p[1][0][i] * out[i, 0] + p[1][1][i] * out[i, 1]
        now[:m] = np.stack([x, y], 1) / (x + y)[:, None]

    alpha = np.empty((_CHUNK, n))
    x, y = into.T
    for j in range(_CHUNK):
        x, y = forward(x, y, j)
        alpha[j] = y / (x + y)
    x, y = out.T
    result = np.empty((_CHUNK, n))
    for j in range(_CHUNK - 1, -1, -1):
        toxic, clean = alpha[j] * y, (1 - alpha[j]) * x
        result[j] = toxic / (toxic + clean)
        u, v = a * x + b * psi[j] * y, c * x + d * psi[j] * y
        s = u + v
        x, y = np.where(real[j], u / s, x), np.where(real[j], v / s, y)
    return result.T.reshape(-1)[at]


def _toxic_words(texts: list[np.ndarray], toxic: list[int], n_words: int) -> np.ndarray:
    """Which words are toxic; texts hold word numbers below n_words."""
    seen, side = [], n_words + 1
    for y in (0, 1):
        own = [t for t, label in zip(texts, toxic) if label == y and len(t)]
        if not own:
            return np.zeros(n_words, bool)
        here = np.concatenate(own).astype(np.int64)
        ends = np.cumsum([len(t) for t in own])
        left, right = np.concatenate([[0], here[:-1] + 1]), np.concatenate([here[1:] + 1, [0]])
        left[ends[:-1]], right[ends - 1] = 0, 0
        contexts = np.unique((left * side + here) * side + right)
        seen.append(np.bincount(contexts // side % side, minlength=n_words).astype(float))
    clean, bad = seen
    p = bad.sum() / (bad.sum() + clean.sum())
    m = bad + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = bad * np.log(bad / (m * p)) + np.where(clean > 0, clean * np.log(clean / (m * (1 - p))), 0)
    return (bad * clean.sum() >= LIFT * clean * bad.sum()) & (np.nan_to_num(ratio, nan=0.0) >= EVIDENCE)


def _windows(texts, toxic, bad, reach, most, rng):
    """Runs of words with tags: around the toxic words of toxic texts, and anywhere in clean ones."""
    runs = []
    for words, y in zip(texts, toxic):
        hits = np.flatnonzero(bad[words])
        if not y and len(words):
            hits = np.union1d(hits, rng.integers(0, len(words), 3))
        for i in hits[:20]:
            part = words[max(0, i - reach) : i + reach + 1]
            runs.append((part, bad[part] & bool(y)))
    rng.shuffle(runs)
    return runs[:most]


def _fit_chain(runs, names: list[str], steps: int = 80, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and moves by Adagrad on the mean log-likelihood of tagged runs of word numbers."""
    weights, moves = np.zeros(BUCKETS), np.zeros((2, 2))
    if not runs:
        weights += -1.0
        return weights, moves
    width, n = max(len(words) for words, _ in runs), len(runs)
    used, place = np.unique(np.concatenate([words for words, _ in runs]), return_inverse=True)
    of_word = np.array([features(names[w]) for w in used], np.int64)[place]
    feats, tags, real = np.zeros((width, n, 3), np.int64), np.zeros((width, n), np.int64), np.zeros((width, n), bool)
    at = 0
    for r, (words, marks) in enumerate(runs):
        k = len(words)
        feats[:k, r], tags[:k, r], real[:k, r] = of_word[at : at + k], marks, True
        at += k
    flat, size = feats.reshape(-1, 3), n
    g_w, g_m = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8)
    gold_pairs = np.zeros((2, 2))
    before = np.zeros(n, np.int64)
    for j in range(width):
        np.add.at(gold_pairs, (before[real[j]], tags[j][real[j]]), 1)
        before = np.where(real[j], tags[j], before)
    for _ in range(steps):
        e = np.exp(np.clip(weights[feats].sum(2), -30, 30))
        m = np.exp(moves)
        alpha = np.zeros((width + 1, n, 2))
        alpha[0, :, 0] = 1
        for j in range(width):
            new = (alpha[j] @ m) * np.stack([np.ones(n), e[j]], 1)
            new /= new.sum(1, keepdims=True)
            alpha[j + 1] = np.where(real[j][:, None], new, alpha[j])
        beta, expected, pairs = np.ones((n, 2)), np.zeros((width, n)), np.zeros((2, 2))
        for j in range(width - 1, -1, -1):
            tail = beta * np.stack([np.ones(n), e[j]], 1)
            joint = alpha[j][:, :, None] * m * tail[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pairs += joint[real[j]].sum(0)
            expected[j] = np.where(real[j], joint[:, :, 1].sum(1), 0)
            new = tail @ m.T
            beta = np.where(real[j][:, None], new / new.sum(1, keepdims=True), beta)
        diff = ((expected - tags * real)).reshape(-1)
        grad = sum(np.bincount(flat[:, k], diff, BUCKETS) for k in range(3)) / size + ridge * weights
        g_w += grad**2
        weights -= 0.5 * grad / np.sqrt(g_w)
        grad = (pairs - gold_pairs) / size + ridge * moves
        g_m += grad**2
        moves -= 0.2 * grad / np.sqrt(g_m)
    return weights, moves


def _summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """1, log-odds of the largest marginal and log of their sum, for each text; a text without words has the least values."""
    low = 1e-6
    top, total = np.full(len(lengths), low), np.full(len(lengths), low)
    some = np.flatnonzero(lengths)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        top[some] = np.clip(np.maximum.reduceat(p, starts), low, 1 - low)
        total[some] = np.maximum(np.add.reduceat(p, starts), low)
    return np.stack([np.ones(len(lengths)), np.log(top / (1 - top)), np.log(total)], 1)


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-2 * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), grad)
    return w


def _score_texts(field: Field, scores: _Scores, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of texts, the marginals of all their words and the numbers of words."""
    words = [WORD.findall(t.lower()) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((scores[w] for own in words for w in own), np.float64, int(lengths.sum()))
    p = marginals(flat, lengths, field.moves)
    return 1 / (1 + np.exp(-np.clip(_summary(p, lengths) @ field.curve, -30, 30))), p, lengths


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, reach: int = 8, most_runs: int = 12_000, sample_chars: int = 20_000) -> Field:
    """A field from labels(doc_id, toxic, ...) of docs(doc_id, text, ...).

    At most per_class toxic and per_class clean labels, those with the smallest hash of the id, pick
    the documents whose texts come to the driver, one for each id, of a longer one a stretch of sample_chars characters that begins
    where the id's hash says; at most most_runs runs of 2 reach + 1 words, and 20 of a document, are fitted. Rows whose label is not 0 or 1 or whose id is null are left out. The curve weighs the
    classes as the labels have them. With one class only, or none, every score is near that class's
    label, or near 0. What training took of the driver's memory goes back to the system.
    """
    field = _trained(docs, labels, per_class, reach, most_runs, sample_chars)
    trim()
    return field


def _trained(docs: DataFrame, labels: DataFrame, per_class: int, reach: int, most_runs: int, sample_chars: int) -> Field:
    marked = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__id is not null and __toxic in (0, 1)")
    have = {r["__toxic"]: r["n"] for r in marked.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    picked = [marked.where(F.col("__toxic") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for y in (0, 1)]
    # two times per_class ids and labels: a proven bound
    joined = docs.join(F.broadcast(picked[0].unionByName(picked[1])), F.col("doc_id") == F.col("__id"))
    sample = joined.groupBy("doc_id", F.col("__toxic").alias("toxic")).agg(F.min(text_of()).alias("text"))
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1).cast("int") + 1
    sample = sample.select("doc_id", "toxic", F.substring("text", start, sample_chars).alias("text")).collect()
    sample.sort(key=lambda r: (r.doc_id, r.text, r.toxic))
    toxic = [r.toxic for r in sample]
    if len(set(toxic)) < 2:
        share = 1.0 if 1 in toxic else 0.0
        return Field(np.full(BUCKETS, -1.0), np.zeros((2, 2)), np.array([4.0 if share else -4.0, 0.0, 0.0]))
    numbers: dict[str, int] = {}
    texts = [np.array([numbers.setdefault(w, len(numbers)) for w in WORD.findall(r.text.lower())], np.int32) for r in sample]
    bad = _toxic_words(texts, toxic, len(numbers))
    weights, moves = _fit_chain(_windows(texts, toxic, bad, reach, most_runs, np.random.default_rng(7)), list(numbers))
    field, scores, rows = Field(weights, moves, np.zeros(3)), _Scores(weights), []
    for k in range(0, len(sample), 200):
        _, p, lengths = _score_texts(field, scores, [r.text for r in sample[k : k + 200]])
        rows.append(_summary(p, lengths))
    taken = Counter(toxic)
    weight = np.array([have[t] / taken[t] for t in toxic])
    field.curve = _fit_curve(np.concatenate(rows), np.array(toxic, float), weight / weight.mean())
    return field


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])


def score(docs: DataFrame, field: Field, spans: bool = True) -> DataFrame:
    """doc_id, score (0 to 1), spans (array of begin and end, code points) for every row of docs(doc_id, text, ...).

    A span is a word whose marginal is at least a half; neighbouring ones are apart. Null texts
    count as empty and have the score of a text without words. Repeated rows are scored each. No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value.weights)
        for b in batches:
            for start, texts in texts_of(b.column(1), 1_000_000):
                out, p, lengths = _score_texts(shared.value, scores, texts)
                found, ends = [[] for _ in texts], np.cumsum(lengths)
                if spans:
                    hot = np.flatnonzero(p >= 0.5)
                    owner = np.searchsorted(ends, hot, "right")
                    for k in np.unique(owner).tolist():
                        places = _places(texts[k])
                        found[k] = [{"begin": places[i][0], "end": places[i][1]} for i in (hot[owner == k] - (ends[k] - lengths[k])).tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(out), pa.array(found, _SCORED.field("spans").type)], schema=_SCORED)

    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<begin:int,end:int>>")


def _places(text: str) -> list[tuple[int, int]]:
    """Begin and end of each word in the text as it was before lowering, which may lengthen it."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in WORD.finditer(low)]
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer("".join(c.lower() for c in text))]


def drop_toxic(docs: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """docs less the rows that score at least threshold; all columns stay as they are."""
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # workers outlive queries
        scores = _Scores(shared.value.weights)
        for b in batches:
            keep = [s < threshold for _, texts in texts_of(b.column(at), 400_000) for s in _score_texts(shared.value, scores, texts)[0].tolist()]
            yield b.filter(pa.array(keep, pa.bool_()))
        scores.clear()

    return docs.mapInArrow(lambda batches: give_back(run(batches)), docs.schema)
