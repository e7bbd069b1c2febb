"""Token ids of whole texts, by the tokenizers library, with a cache of pre-tokens.

A byte-level BPE encodes each pre-token on its own, so each distinct pre-token of a worker is
encoded once and its ids are kept, up to `cache` of them. Splitting follows the byte-level pattern,
as array operations over character classes. A 64-bit hash finds a pre-token's entry and its
characters are then compared with the entry's, so no two are mixed up; texts where a hash leads to
other characters are encoded whole. So are texts with characters beyond U+024F, texts that contain a
special token's string, and every text where the vocabulary isn't a byte-level BPE of that pattern.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from .shared import Powers, mixed

VOCABULARY = "byte_bpe_50k.json"
LETTER, NUMBER, OTHER, SPACE, BREAK = range(5)
_SPACES = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
_LAST = 0x24F
_CLASS = np.array([SPACE if c in _SPACES else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(_LAST + 1)] + [BREAK], np.uint8)
_BLANK = re.compile(r"[a-z] [a-z]")
_POWERS = Powers(0x9E3779B97F4A7C15)


def pretokens(codes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of a run of texts start; 0x250 stands before, between and after texts.

    The pattern: an apostrophe with s, t, re, ve, m, ll or d; letters, numbers or other signs with
    one blank before them; white space up to its last character if text follows, else all of it.
    """
    kind = _CLASS[codes]
    start = np.ones(len(codes), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BREAK)
    blank = codes == 32
    space = kind == SPACE
    word = kind < SPACE
    start[:-1] |= space[:-1] & word[1:]
    start[1:] &= ~(word[1:] & blank[:-1])
    quote = np.flatnonzero((codes[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
    if len(quote):
        a, b = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
        one = np.isin(a, (115, 116, 109, 100))
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        for q, n in ((quote[one], 2), (quote[two], 3)):
            start[q + 1] = False
            start[(q + n)[kind[q + n] == LETTER]] = True
    return np.flatnonzero(start)


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Two tables, sorted by their first columns, as one."""
    place = np.searchsorted(a[0], b[0])
    return [np.insert(x, place, y) for x, y in zip(a, b)]


class _Store:
    """A growing array."""

    def __init__(self, kind):
        self.values, self.used = np.zeros(1 << 16, kind), 0

    def put(self, more: np.ndarray) -> int:
        """Appends, and says where."""
        at, self.used = self.used, self.used + len(more)
        if self.used > len(self.values):
            self.values = np.concatenate([self.values[:at], np.zeros(self.used + len(more), self.values.dtype)])
        self.values[at : self.used] = more
        return at

    def take(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The stretches at these places, one after the other."""
        before = np.cumsum(size) - size
        return self.values[np.repeat(at - before, size) + np.arange(int(size.sum()))]


def splits_by_pattern(vocabulary: dict) -> bool:
    """Whether a tokenizer is a byte-level BPE that pretokens() splits for."""
    kind, model = vocabulary.get("pre_tokenizer") or {}, vocabulary["model"]
    plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
    merges_only = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    return bool(plain and merges_only and vocabulary.get("normalizer") is None)


class Encoder:
    def __init__(self, path: str | None = None, cache: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.by_pattern = splits_by_pattern(json.loads(self.whole.to_str()))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.limit = cache
        self._clear()

    def _clear(self) -> None:
        # Columns: key, number of characters, their place, number of ids, their place. New rows go to
        # the small table.
        empty = [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64)]
        self.large, self.small = empty, empty
        self.ids, self.letters = _Store(self.type), _Store(np.uint16)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], keys: np.ndarray) -> None:
        new, codes = self._ids(words), [np.frombuffer(w.encode("utf-16-le"), np.uint16) for w in words]
        columns = [keys]
        for store, parts in ((self.letters, codes), (self.ids, new)):
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            columns += [size, store.put(np.concatenate(parts)) + np.cumsum(size) - size]
        self.small = _merged(self.small, columns)
        if 4 * len(self.small[0]) > len(self.large[0]) + (1 << 16):
            self.large, self.small = _merged(self.large, self.small), [c[:0] for c in self.small]

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which keys are known, and the other columns of their rows."""
        known, out = np.zeros(len(keys), bool), [np.zeros(len(keys), np.int64) for _ in range(4)]
        for part in (self.large, self.small):
            if len(part[0]):
                place = np.minimum(np.searchsorted(part[0], keys), len(part[0]) - 1)
                here = part[0][place] == keys
                known |= here
                for column, values in zip(out, part[1:]):
                    column[here] = values[place[here]]
        return known, out

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(["ɐ", *(f"{t}ɐ" for t in texts)])
        codes = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        start = pretokens(codes)
        end = np.append(start[1:], len(codes))
        real = codes[start] <= _LAST
        ends_text = np.flatnonzero(~real)
        start, end = start[real], end[real]
        per_text = np.diff(ends_text) - 1
        up, down = _POWERS.get(len(codes) + 1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        keys = (total[end] - total[start]) * down[start]
        keys = mixed(keys ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.large[0]) + len(self.small[0]) + len(unique) > self.limit:
            self._clear()
        known, found = self._look(unique)
        if not known.all():
            new = first[~known]
            self._learn([joined[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())], unique[~known])
            known, found = self._look(unique)
        n_codes, at_codes, n_ids, at_ids = (c[which] for c in found)
        same = n_codes == end - start
        if same.all():  # texts are made of pre-tokens alone: their characters in order are those of the entries
            same = self.letters.take(at_codes, n_codes) == codes[codes <= _LAST]
        if not same.all():
            return self._ids(texts)
        out = self.ids.take(at_ids, n_ids)
        last = np.concatenate([[0], np.cumsum(n_ids)])[np.concatenate([[0], np.cumsum(per_text)])]
        return [out[a:b] for a, b in zip(last[:-1].tolist(), last[1:].tolist())]

    def _long(self, text: str, piece: int = 1 << 19) -> np.ndarray:
        """The ids of a long text, in pieces that end before a single blank between two words."""
        out, at = [], 0
        while at < len(text):
            end = at + piece
            if end < len(text):
                cut = _BLANK.search(text, end)
                end = cut.start() + 1 if cut else len(text)
            out += self._split([text[at:end]])
            at = end
        return np.concatenate(out)

    def encode(self, texts: list[bytes | memoryview]) -> list[np.ndarray]:
        """The ids of each text, given in UTF-8."""
        plain, odd, out = [], [], [None] * len(texts)
        for k, raw in enumerate(texts):
            text = bytes(raw).decode()
            latin = not len(raw) or np.frombuffer(raw, np.uint8).max() < 0xC9 or max(text) <= chr(_LAST)
            (plain if latin and self.by_pattern and not any(s in text for s in self.special) else odd).append((k, text))
        for part, how in ((plain, self._split), (odd, self._ids)):
            if part:
                short = [x for x in part if how == self._ids or len(x[1]) <= 1 << 20]
                for (k, _), ids in zip(short, how([t for _, t in short]) if short else []):
                    out[k] = ids
        for k, text in plain:
            if out[k] is None:
                out[k] = self._long(text)
        return out


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
