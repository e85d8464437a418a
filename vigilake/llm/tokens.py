"""Token ids of whole texts by the tokenizers library, with a cache of words."""

from __future__ import annotations

from array import array
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of str.split() that the tokenizer's pattern may see otherwise, and a letter whose lower case depends on its place.
_ODD = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x3A3)]
#: A sign after a letter or digit, where the tokenizer always parts.
_SIGN = r"([\pL\pN])([.,!?;:#$%&*|])"


class WordEncoder:
    """Encodes texts by a tokenizer that composes, lowers case, drops white space and parts letters from signs.

    Then the ids of a text are those of its pieces in order, where it is lowered and cut at white
    space and between a letter or digit and a sign; so each distinct piece is encoded once and its
    ids are kept as little-endian 32-bit bytes. A text for which that may not hold is given to the
    library whole. limit: pieces that are kept; beyond it those that have come up again stay.
    """

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.cache = Tokenizer.from_file(path), limit, {}
        self.again: dict[str, bytes] = {}
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        #: Which ids end a word, if the tokenizer marks that.
        self.ends, mark = None, getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if mark:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(mark)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word. Words of letters only are encoded side by side and cut where the ids end words."""
        plain = [w for w in words if w.isalpha()] if self.ends is not None else []
        out = {}
        if plain:
            lines = [" ".join(plain[i : i + 500]) for i in range(0, len(plain), 500)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(plain):
                coded = ids.tobytes()
                out = dict(zip(plain, (coded[i:j] for i, j in zip([0, *cuts], cuts))))
        rest = [w for w in words if w not in out]
        return out | dict(zip(rest, self._ids(rest)))

    @staticmethod
    def _low(text: str) -> str | None:
        """The text in lower case, or None if it must be given to the library whole."""
        if "<|" in text or any(c in text for c in (_ODD[:4] if text.isascii() else _ODD)):
            return None
        low = text.lower()
        return low if low.isascii() or is_normalized("NFC", text) and is_normalized("NFC", low) else None

    def _known(self, words: list[str]) -> list[bytes]:
        found = list(map(self.cache.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if len(self.cache) + len(new) > self.limit:
            # what has come up since the cache was last emptied, and then again, stays
            self.cache = {w: ids for w, ids in zip(words, found) if ids is not None} | self.again
            self.again = {}
        elif len(self.cache) > self.limit // 2:
            self.again.update((w, ids) for w, ids in zip(words, found) if ids is not None)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.cache.update(self._word_ids(part))
        return list(map(self.cache.__getitem__, words)) if new else found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        low = [self._low(t) for t in texts]
        rows = pc.ascii_split_whitespace(pc.replace_substring_regex(pa.array([t or "" for t in low], pa.string()), _SIGN, r"\1 \2"))
        coded = rows.values.dictionary_encode()
        parts = self._known(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        start, which = np.cumsum(size) - size, coded.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(start[which] - ends[:-1], n)
        place += np.arange(ends[-1])
        ids = np.frombuffer(b"".join(parts), "<u4")[place] if len(parts) else np.empty(0, "<u4")
        cuts = ends[rows.offsets.to_numpy()].tolist()
        return [self._ids([t])[0] if own is None else ids[i:j].tobytes() for t, own, i, j in zip(texts, low, cuts[:-1], cuts[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def forget() -> None:
    """Drops the encoders and their pieces, which a stage that counts no tokens has no use for."""
    encoder.cache_clear()
