"""Personal data in whole texts: fixed recognisers, and a character-level BiLSTM with a CRF on top.

The base spans are those of fixed patterns. The network, trained in numpy from labelled spans set
into lines of the corpus, adds spans that are written otherwise. Texts are read by windows that
overlap. A character's emissions are the mean of those of its windows, weighted by how far inside of each it stands, and
Viterbi's algorithm then finds the best tags of each whole stretch of windows at once.
An added span must pass a check of its kind and may not touch a base span. Every
span that can pass has a digit or an at sign, so only windows near one are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_groups import texts_of
from .common import text_of

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base spans.
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
#: Where a window may hold an added span.
_SIGN = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign and domain; found from the at signs, so a long run of letters costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _EMAIL_LOCAL:
            begin -= 1
        domain = _EMAIL_DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, kind) by begin, then kind."""
    out = [(i, j, 0) for i, j in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


_LOOSE_EMAIL = re.compile(r"[\w.%+-]+ ?(@|[(\[] ?at ?[)\]]) ?[\w-]+(( ?(\.|[(\[] ?dot ?[)\]]) ?)[\w-]+)+", re.I)
_LOOSE_IP = re.compile(r"([0-9]{1,3})( ?[\[(]?\.[\])]? ?([0-9]{1,3})){3}")
_LOOSE_CARD = re.compile(r"[0-9]{1,6}([ ./_-]{0,2}[0-9]{1,6}){1,6}|[0-9]{13,19}")
_LOOSE_PHONE = re.compile(r"(\+|00)?[ (]*[0-9]{1,4}([ ()./-]{1,3}[0-9]{2,5}){2,5}")


def acceptable(kind: int, text: str) -> bool:
    """Whether a text that the network tagged can be of the kind."""
    if not _SIGN.search(text) or len(text) > 80:
        return False
    digits = "".join(_DIGIT.findall(text))
    if kind == 0:
        return bool(_LOOSE_EMAIL.fullmatch(text))
    if kind == 1:
        return bool(_LOOSE_IP.fullmatch(text)) and all(map(_byte, re.findall("[0-9]+", text)))
    if kind == 2:
        return bool(_LOOSE_CARD.fullmatch(text)) and 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)
    return bool(_LOOSE_PHONE.fullmatch(text)) and 9 <= len(digits) <= 15 and not re.fullmatch(r"[0-9]{1,4}([-/.])[0-9]{1,2}\1[0-9]{1,4}", text)


# --- the network

#: Characters of a window, and how many two neighbouring windows share.
WINDOW, OVERLAP = 128, 32
#: Positions of a chunk of a sequence that is decoded.
CHUNK = 64
#: The weight of a character's emissions by its place in a window.
_INSIDE = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)
_SYMBOLS = 102  # 0: none, 1-95: ASCII from space, 96: line break, 97: tab, 98: other letter, 99: other digit, 100: other sign, 101: control


def _table() -> np.ndarray:
    """Code point -> symbol, for the basic plane; later ones count as other signs."""
    out = np.full(0x10000, 100, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        out[code] = 101 if code < 32 else code - 31 if code < 127 else 98 if c.isalpha() else 99 if c.isdigit() else 100
    out[10], out[9] = 96, 97
    return out


_CODES: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    if not _CODES:
        _CODES.append(_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CODES[0][np.minimum(codes, 0xFFFF)]


@dataclass
class Tagger:
    """Input rows and recurrent weights of the two directions; then output weights, bias and tag moves. Tags: 0 none, 1-4 KINDS."""

    inputs: np.ndarray
    recurrent: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    moves: np.ndarray


def _lstm(x: np.ndarray, inputs: np.ndarray, recurrent: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (steps, directions, rows, size) over symbols x (steps, directions, rows), each direction with its own weights; gates stand in order in, forget, out, cell."""
    size, ways = recurrent.shape[1], np.arange(len(recurrent))[:, None]
    h = c = np.zeros((*x.shape[1:], size), np.float32)
    out = np.empty((*x.shape, size), np.float32)
    for t in range(len(x)):
        z = inputs[ways, x[t]] + h @ recurrent
        gates = 0.5 * np.tanh(0.5 * z[..., : 3 * size]) + 0.5
        cell = np.tanh(z[..., 3 * size :])
        last = c
        c = gates[..., size : 2 * size] * last + gates[..., :size] * cell
        squashed = np.tanh(c)
        if keep is not None:
            keep.append((gates, cell, last, squashed, h))
        h = gates[..., 2 * size :] * squashed
        out[t] = h
    return out


def _lstm_back(x, recurrent, kept, d_out):
    """Gradients of the input rows and recurrent weights."""
    size, turned = recurrent.shape[1], recurrent.transpose(0, 2, 1)
    d_recurrent, every = np.zeros_like(recurrent), np.empty((*x.shape, 4 * size), np.float32)
    dh = dc = np.zeros(d_out.shape[1:], np.float32)
    for t in range(len(x) - 1, -1, -1):
        gates, cell, last, squashed, h = kept[t]
        i, f, o = gates[..., :size], gates[..., size : 2 * size], gates[..., 2 * size :]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = every[t]
        dz[..., :size], dz[..., size : 2 * size] = dc * cell * i * (1 - i), dc * last * f * (1 - f)
        dz[..., 2 * size : 3 * size], dz[..., 3 * size :] = dh * squashed * o * (1 - o), dc * i * (1 - cell**2)
        d_recurrent += h.transpose(0, 2, 1) @ dz
        dh, dc = dz @ turned, dc * f
    d_inputs = np.zeros((len(recurrent), _SYMBOLS, 4 * size), np.float32)
    for way in range(len(recurrent)):
        codes, grads = x[:, way].reshape(-1), every[:, way].reshape(-1, 4 * size)
        order = np.argsort(codes, kind="stable")
        used, begins = np.unique(codes[order], return_index=True)
        d_inputs[way, used] = np.add.reduceat(grads[order], begins)
    return d_inputs, d_recurrent


def _both(x: np.ndarray) -> np.ndarray:
    """Symbols (steps, rows) in either direction."""
    return np.stack([x, x[::-1]], 1)


def _emissions(tagger: Tagger, x: np.ndarray) -> np.ndarray:
    h = _lstm(_both(x), tagger.inputs, tagger.recurrent)
    return np.concatenate([h[:, 0], h[::-1, 1]], 2) @ tagger.output + tagger.bias


def _ways(start: np.ndarray, grid: np.ndarray, real: np.ndarray, moves: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
    """The best ways from start (chunks, ways, tags) through emissions grid (steps, chunks, tags) to each last tag; steps that are not real change nothing."""
    best, same = start + grid[0][:, None, :], np.arange(moves.shape[0], dtype=np.int8)
    for t in range(1, len(grid)):
        every, alive = best[..., None] + moves, real[t][:, None, None]
        if back is not None:
            back[t] = np.where(alive, every.argmax(2), same)[:, 0]
        best = np.where(alive, every.max(2) + grid[t][:, None, :], best)
    return best


def viterbi(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of sequences of the given lengths that stand one after another in emissions (positions, tags).

    Sequences are cut into chunks of equal length. For each chunk and each tag before it the best score of each last tag is
    found, many side by side; the chunks of a sequence are joined in order, which fixes the tags at their ends; and the ways in between are then
    read back, many side by side again.
    """
    k, total = moves.shape[0], int(lengths.sum())
    if not total:
        return np.empty(0, np.int8)
    chunks = -(-lengths // CHUNK)
    n, first = int(chunks.sum()), np.cumsum(chunks) - chunks
    at = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first * CHUNK, lengths)
    grid, real = np.zeros((n * CHUNK, k), emissions.dtype), np.zeros(n * CHUNK, bool)
    grid[at], real[at] = emissions, True
    grid, real = grid.reshape(n, CHUNK, k), real.reshape(n, CHUNK)
    opens = np.zeros(n, bool)
    opens[first[lengths > 0]] = True
    parts = [slice(i, i + 4096) for i in range(0, n, 4096)]
    start = np.where(opens[:, None, None], 0, moves[None]).astype(emissions.dtype)
    best = np.concatenate([_ways(start[p], grid[p].transpose(1, 0, 2), real[p].T, moves) for p in parts])
    before, last = np.zeros(n, np.int8), np.zeros(n, np.int8)
    for s, m in zip(first.tolist(), chunks.tolist()):
        if not m:
            continue
        value, ways = best[s, 0], []
        for c in range(s + 1, s + m):
            every = value[:, None] + best[c]
            ways.append(every.argmax(0))
            value = every.max(0)
        tag = int(value.argmax())
        for c in range(s + m - 1, s, -1):
            last[c], before[c] = tag, ways[c - s - 1][tag]
            tag = int(before[c])
        last[s] = tag
    tags = np.empty((n, CHUNK), np.int8)
    for p in parts:
        own = np.where(opens[p, None], 0, moves[before[p]]).astype(emissions.dtype)[:, None, :]
        back = np.zeros((CHUNK, len(own), k), np.int8)
        _ways(own, grid[p].transpose(1, 0, 2), real[p].T, moves, back)
        tag, rows = last[p], np.arange(len(own))
        for t in range(CHUNK - 1, -1, -1):
            tags[p, t] = tag
            tag = back[t][rows, tag]
    return tags.reshape(-1)[at]


def _crf(emissions: np.ndarray, tags: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood a character, and its gradients for emissions and moves."""
    steps, rows, k = emissions.shape

    def soft(x, axis):
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    alpha = np.empty_like(emissions)
    alpha[0] = emissions[0]
    for t in range(1, steps):
        alpha[t] = soft(alpha[t - 1][:, :, None] + moves, 1) + emissions[t]
    whole = soft(alpha[-1], 1)
    beta, d_moves, d_emissions = np.zeros((rows, k), np.float32), np.zeros_like(moves), np.empty_like(emissions)
    for t in range(steps - 1, -1, -1):
        d_emissions[t] = np.exp(alpha[t] + beta - whole[:, None])
        if t:
            tail = emissions[t] + beta
            d_moves += np.exp(alpha[t - 1][:, :, None] + moves + tail[:, None, :] - whole[:, None, None]).sum(0)
            beta = soft(moves + tail[:, None, :], 2)
    at = np.arange(rows)
    gold = sum(emissions[t, at, tags[t]] + (moves[tags[t - 1], tags[t]] if t else 0) for t in range(steps))
    for t in range(steps):
        d_emissions[t, at, tags[t]] -= 1
        if t:
            np.add.at(d_moves, (tags[t - 1], tags[t]), -1)
    n = steps * rows
    return float((whole - gold).mean() / steps), d_emissions / n, d_moves / n


def _card_number(rng, n: int) -> str:
    digits = "".join(map(str, rng.integers(0, 10, n - 1)))
    return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))


def _example(rng) -> tuple[int, str]:
    """(tag, text): personal data of a kind, or with tag 0 something like it."""

    def digits(n):
        return f"{rng.integers(10 ** int(n)):0{n}d}"

    def word(low=2, high=9):
        return "".join(["abcdefghijklmnoprstuvwz"[i] for i in rng.integers(0, 23, rng.integers(low, high)).tolist()])

    def pick(*options):
        return options[rng.integers(len(options))]

    tag = int(rng.integers(0, 6))
    if tag == 1:
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "))
        local = word() + pick("", "." + word(), "_" + word(), digits(2), "." + digits(2), "+" + word())
        return 1, local + at + word() + pick("", digits(1)) + dot + pick("", word() + dot) + pick("com", "org", "net", "de", "io")
    if tag == 2:
        return 2, pick(".", ".", ".", "[.]", "(.)", " . ").join(str(rng.integers(0, 256)) for _ in range(4))
    if tag == 3:
        n = pick(16, 16, 16, 15, 14, 13, 19)
        number, gap = _card_number(rng, n), pick("", "", " ", "-", ".", "  ", "/")
        return 3, gap.join(number[i : i + 4] for i in range(0, n, 4))
    if tag == 4:
        a, b, c = digits(3), digits(3), digits(4)
        return 4, pick(f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"00{digits(2)} {digits(3)} {digits(7)}", f"1-{a}-{b}-{c}", f"0{digits(3)} {digits(3)} {digits(4)}", f"+{digits(2)}-{digits(4)}-{digits(6)}")
    return 0, pick(
        f"20{digits(2)}-0{1 + int(digits(1)) % 9}-{10 + int(digits(1))}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(2)}", digits(rng.integers(1, 8)), f"${digits(2)},{digits(3)}",
        f"{digits(1)}:{digits(2)}", "".join(rng.choice(list("0123456789abcdef"), 40)), f"{digits(2)}/{digits(2)}/20{digits(2)}", f"@{word()}", f"{digits(2)} {word()} {digits(2)}", f"{digits(3)}%%%", f"#{digits(5)}", f"{digits(2)}-{digits(2)}",
    )


def examples(lines: list[str], n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags (steps, n) of windows: labelled spans set between words of the given lines."""
    rng = np.random.default_rng(seed)
    lines = [w for w in lines if not _SIGN.search(w)] or ["lorem ipsum dolor sit amet, consectetur adipiscing elit"]
    x, y = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.int8)
    for row in range(n):
        text, tags = "", []
        while len(text) < WINDOW:
            words = lines[rng.integers(len(lines))].split(" ")
            at = int(rng.integers(len(words)))
            piece = " ".join(words[at : at + int(rng.integers(1, 7))])
            text += piece
            tags += [0] * len(piece)
            left, right = (" ", " ") if rng.random() < 0.8 else [(" ", ". "), ("\n", "\n"), (": ", ", "), ("(", ")"), (" ", "!! "), ("; ", "\n"), ("=", " ")][rng.integers(7)]
            tag, inside = _example(rng)
            text += left + inside + right
            tags += [0] * len(left) + [tag] * len(inside) + [0] * len(right)
        shift = int(rng.integers(0, max(1, len(text) - WINDOW)))
        x[row], y[row] = symbols(text)[shift : shift + WINDOW], tags[shift : shift + WINDOW]
    return x.T.copy(), y.T.copy()


def train(lines: list[str], size: int = 20, windows: int = 6000, steps: int = 320, batch: int = 64, seed: int = 5) -> Tagger:
    """A tagger fitted by Adam to labelled spans set into lines of text."""
    x, y = examples(lines, windows)
    rng = np.random.default_rng(seed)
    k = len(KINDS) + 1

    def draw(*shape):
        return (rng.normal(size=shape) * 0.15).astype(np.float32)

    p = [draw(2, _SYMBOLS, 4 * size), draw(2, size, 4 * size), draw(2 * size, k), np.zeros(k, np.float32), np.zeros((k, k), np.float32)]
    p[0][..., size : 2 * size] += 1
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        rows = rng.integers(0, windows, batch)
        bx, by, kept = _both(x[:, rows]), y[:, rows], []
        each = _lstm(bx, p[0], p[1], kept)
        h = np.concatenate([each[:, 0], each[::-1, 1]], 2)
        _, de, dm = _crf(h @ p[2] + p[3], by, p[4])
        dh = de @ p[2].T
        d_inputs, d_recurrent = _lstm_back(bx, p[1], kept, np.stack([dh[:, :, :size], dh[::-1, :, size:]], 1))
        grads = [d_inputs, d_recurrent, np.einsum("tbh,tbk->hk", h, de), de.sum((0, 1)), dm]
        rate = 0.02 * min(1, step / 20) * (1 - 0.9 * step / steps)
        for a, g, m, v in zip(p, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Tagger(*p)


def train_on(docs: DataFrame, sample: int = 200, **options) -> Tagger:
    """A tagger whose spans stand between words of the docs with the sample smallest hashes of their ids.

    Only whole lines of at most 400 characters are taken from them to the driver, 20 of each id.
    """
    picked = docs.select(F.col("doc_id").alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(sample).distinct()
    lines = F.slice(F.filter(F.split(text_of(), "\n"), lambda x: F.length(x).between(20, 400)), 1, 20)
    # sample ids: a proven bound
    taken = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).groupBy("doc_id").agg(F.min(lines).alias("lines")).collect()
    taken.sort(key=lambda r: (r.doc_id, r.lines))
    return train([line for r in taken for line in r.lines], **options)


def _stretches(text: str) -> list[tuple[int, int]]:
    """(first, last) of each run of neighbouring windows that lie within 64 characters of a sign."""
    step, out = WINDOW - OVERLAP, []
    most = max(0, -(-(len(text) - WINDOW) // step))
    for found in _SIGN.finditer(text):
        low, high = max(0, (found.start() - 64 - WINDOW) // step + 1), min(most, (found.end() + 64) // step)
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        elif low <= high:
            out.append((low, high))
    return out


def tag_texts(tagger: Tagger, texts: list[str]) -> list[np.ndarray]:
    """The tag of every character; those of windows without a sign nearby are all 0."""
    step, out = WINDOW - OVERLAP, [np.zeros(len(t), np.int8) for t in texts]
    rows, spots, held, total = [], [], [], 0
    for k, text in enumerate(texts):
        runs = _stretches(text)
        coded = symbols(text) if runs else None
        for low, high in runs:
            begin, end = low * step, min(len(text), high * step + WINDOW)
            for w in range(low, high + 1):
                row = np.zeros(WINDOW, np.uint8)
                part = coded[w * step : w * step + WINDOW]
                row[: len(part)] = part
                rows.append(row)
                spots.append((total + w * step - begin, len(part)))
            held.append((k, begin, end))
            total += end - begin
            if len(rows) >= 2048:
                _decode(tagger, rows, spots, held, out)
                rows, spots, held, total = [], [], [], 0
    if rows:
        _decode(tagger, rows, spots, held, out)
    return out


def _decode(tagger: Tagger, rows: list[np.ndarray], spots: list[tuple[int, int]], held: list[tuple[int, int, int]], out: list[np.ndarray]) -> None:
    """Writes the tags of stretches; rows are their windows, spots where in the line of stretches these stand and how long they are."""
    lengths = np.array([end - begin for _, begin, end in held])
    total = int(lengths.sum())
    mean, weight = np.zeros((total, tagger.moves.shape[0]), np.float32), np.zeros((total, 1), np.float32)
    for at in range(0, len(rows), 1024):
        told = _emissions(tagger, np.stack(rows[at : at + 1024]).T).transpose(1, 0, 2) * _INSIDE[:, None]
        for (begin, n), own in zip(spots[at : at + 1024], told):
            mean[begin : begin + n] += own[:n]
            weight[begin : begin + n, 0] += _INSIDE[:n]
    tags, at = viterbi(mean / weight, lengths, tagger.moves), 0
    for (k, begin, end), n in zip(held, lengths.tolist()):
        out[k][begin:end] = tags[at : at + n]
        at += n


def all_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans and the runs of equal tags that pass the check and touch no base span."""
    if not tags.any():
        return base
    edges = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
    added = []
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        kind = int(tags[begin]) - 1
        while begin < end and text[begin] in " \t\n.,;:!?=":
            begin += 1
        while begin < end and text[end - 1] in " \t\n.,;:!?=(":
            end -= 1
        if kind < 0 or begin >= end or not acceptable(kind, text[begin:end]):
            continue
        if (begin and text[begin - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
            continue
        if all(end <= i or j <= begin for i, j, _ in base):
            added.append((begin, end, kind))
    return sorted(base + added, key=lambda s: (s[0], s[2]))


_SPAN = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, spans (array of kind, begin, end, base; code points, by begin then kind) for every row of docs(doc_id, text, ...).

    Null texts count as empty and have no spans. Repeated rows are searched each. No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in texts_of(b.column(1), 1_000_000):
                out = []
                for text, tags in zip(texts, tag_texts(shared.value, texts)):
                    base = base_spans(text)
                    fixed = set(base)
                    out.append([{"kind": KINDS[s[2]], "begin": s[0], "end": s[1], "base": s in fixed} for s in all_spans(text, tags, base)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(out, pa.list_(_SPAN))], schema=_FOUND)

    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,begin:int,end:int,base:boolean>>")
