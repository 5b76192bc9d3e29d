"""Fast, exact use of the two byte-level BPE vocabularies of the tokenizers library.

The library spends most of its time cutting a text into pre-tokens and keeping alignments that nobody
asks for.  Here the cut is done over whole batches with numpy, each distinct pre-token goes through the
library's model once, in the characters that stand for its bytes, and its ids are kept (bounded: the store
is emptied when it is full).  The character classes come from the library's own regular expressions, so
both agree on every code point.
Texts that hold the string of an added token are encoded by the library as a whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from .common import mix64, powers

#: Distinct pre-tokens whose ids are kept in a worker.
KEPT_WORDS = 1_000_000
#: Characters handled at once.
CHUNK_CHARS = 1 << 20

_NFC_STABLE = 0x250  #: below it each character is its own NFC form and has the same lower case in every Unicode version


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _class_table() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space for each code point, asked of the library itself."""
    from tokenizers import Regex, pre_tokenizers

    points = np.concatenate([np.arange(0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)])
    table = np.zeros(0x110000, dtype=np.uint8)
    for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for some in np.array_split(points, 256):  # a little at a time, since the library returns all pieces at once
            for _, (a, b) in split.pre_tokenize_str(some.tobytes().decode("utf-32-le")):
                table[some[a:b]] = k
    return table


_TABLE: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_class_table())
    return _TABLE[0]


_APOSTROPHE = 39


def _byte_points() -> np.ndarray:
    """The code point that a byte-level vocabulary has for each byte: printable bytes are themselves, the others follow 255."""
    out, hidden = np.arange(256, dtype=np.uint32), np.r_[:33, 127:161, 173]
    out[hidden] = 256 + np.arange(hidden.size, dtype=np.uint32)
    return out


_BYTE_POINTS = _byte_points()


def byte_level(words: list[str]) -> list[str]:
    """The words as the byte-level pre-tokeniser of the library hands them to its model."""
    text = "".join(words)
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    ends = np.zeros(points.size + 1, dtype=np.int64)  # in bytes of UTF-8
    np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=ends[1:])
    at = ends[np.cumsum(np.fromiter(chain([0], map(len, words)), dtype=np.int64, count=len(words) + 1))].tolist()
    shown = _BYTE_POINTS[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")
    return [shown[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class _Store:
    """An open-addressing table from 64-bit keys to running numbers, worked on a batch at a time."""

    def __init__(self, capacity: int):
        self.bits = max(10, (2 * capacity - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.zeros(1 << self.bits, dtype=np.int64)
        self.size = 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 where a key isn't there."""
        at, out = self._home(keys), np.full(keys.size, -1, dtype=np.int64)
        todo, mask = np.arange(keys.size), self.keys.size - 1
        while todo.size:
            there, wanted = self.keys[at], keys[todo]
            hit = there == wanted
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number distinct new keys from ``size`` on."""
        number, at, mask = np.arange(self.size, self.size + keys.size), self._home(keys), self.keys.size - 1
        self.size += keys.size
        while keys.size:
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several the last stays
            own = free & (self.keys[at] == keys)
            self.values[at[own]] = number[own]
            keys, number, at = keys[~own], number[~own], (at[~own] + ~free[~own]) & mask


_POINT_KEYS: list[np.ndarray] = []


def _point_keys() -> np.ndarray:
    if not _POINT_KEYS:
        _POINT_KEYS.append(mix64(np.arange(0x110000, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)))
    return _POINT_KEYS[0]


class Encoder:
    """ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives them.

    Vocabularies without a normaliser: pre-tokens by
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    Those with one (NFC, white space to one space, lower case): by
    ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`` with everything else dropped.
    A pre-token is known by a 64-bit hash and its length.
    """

    def __init__(self, path: str):
        self.tok = _load(path)
        self.dropped = self.tok.normalizer is not None
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.store = _Store(KEPT_WORDS)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1, dtype=np.int64)

    def normal(self, text: str) -> str:
        if not text.isascii() and np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).max() >= _NFC_STABLE:
            return self.tok.normalizer.normalize_str(text)
        return text.lower()

    def cuts(self, text: str, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens; rows: where each text of ``text`` begins, and its end."""
        kind = classes()[points]
        n = kind.size
        change = np.empty(n, dtype=bool)
        change[0] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        first = rows[:-1][rows[:-1] < n]
        change[first] = True
        if self.dropped:
            change |= kind == 2
        elif n > 1:
            # a run of white space before a word gives its last character away: to the word if it is a space, else to itself
            last_space = np.zeros(n, dtype=bool)
            last_space[:-1] = (kind[:-1] == 3) & (kind[1:] != 3)
            last_space[first[first > 0] - 1] = False  # at the end of a text nothing follows
            change |= last_space
            change[1:] &= ~(last_space[:-1] & (points[:-1] == 32))
        marks = np.flatnonzero(points == _APOSTROPHE)
        if marks.size:
            stops = rows[np.searchsorted(rows, marks, side="right")]
            self._contractions(text, marks[change[marks]].tolist(), stops[change[marks]].tolist(), change, kind)
        start = np.flatnonzero(change)
        end = np.append(start[1:], n)
        if self.dropped:
            keep = kind[start] != 3
            start, end = start[keep], end[keep]
        return start, end

    def _contractions(self, text, marks, stops, change, kind) -> None:
        """'s 't 're 've 'm 'll 'd stand alone, but only where a match begins at the apostrophe."""
        done = -1
        for i, stop in zip(marks, stops, strict=True):
            if i < done:
                continue
            two = text[i + 1 : min(i + 3, stop)]
            size = 3 if two in ("re", "ve", "ll") else 2 if two and two[0] in "stmd" else 0
            if not size:
                continue
            done = i + size
            change[i + 1 : done] = False
            if done < stop and (self.dropped or kind[done] != 3):
                change[done] = True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of each text); None counts as empty."""
        whole = [k for k, text in enumerate(texts) if text and any(a in text for a in self.added)]
        if not whole:
            return self._plain(texts)
        rest = list(texts)
        for k in whole:
            rest[k] = ""
        ids, offsets = self._plain(rest)
        sizes, parts, last = np.diff(offsets), [], 0
        for k in whole:
            own = np.array(self.tok.encode(texts[k], add_special_tokens=False).ids, dtype=np.uint32)
            parts += [ids[last : offsets[k]], own]
            sizes[k], last = own.size, offsets[k]
        return np.concatenate([*parts, ids[last:]]), np.concatenate([[0], np.cumsum(sizes)])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without the string of an added token."""
        parts, counts, group, size = [], [], [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= CHUNK_CHARS:
                ids, n = self._some(group)
                parts.append(ids)
                counts.append(n)
                group, size = [], 0
        ids, n = self._some(group)
        parts.append(ids)
        counts.append(n)
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(np.concatenate(counts), out=offsets[1:])
        return np.concatenate(parts), offsets

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.dropped:
            texts = [self.normal(t) for t in texts]
        text = "".join(texts)
        if not text:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        rows = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=rows[1:])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        start, end = self.cuts(text, points, rows)
        prefix = np.zeros(points.size + 1, dtype=np.uint64)
        np.cumsum(_point_keys()[points] * powers(points.size), out=prefix[1:])
        keys = (prefix[end] - prefix[start]) * powers(points.size + 1, inverse=True)[start]
        keys = mix64(keys + (end - start).astype(np.uint64)) | np.uint64(1)
        which = self.store.find(keys)
        new = np.flatnonzero(which < 0)
        if new.size:
            fresh, at = np.unique(keys[new], return_index=True)
            if self.store.size + fresh.size > KEPT_WORDS:
                self.reset()
                fresh, at = np.unique(keys, return_index=True)
                new = np.arange(keys.size)
            if fresh.size > KEPT_WORDS:  # one text with more words than are kept
                self.store = _Store(fresh.size)
            at = new[at]
            self._learn([text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            self.store.add(fresh)
            which[new] = self.store.find(keys[new])
        first, size = self.ends[which], self.ends[which + 1] - self.ends[which]
        total = np.zeros(which.size + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        take = np.arange(total[-1]) + np.repeat(first - total[:-1], size)
        return self.flat[take], np.diff(total[np.searchsorted(start, rows)])

    def _learn(self, fresh: list[str]) -> None:
        # the model alone: what else the library does with a text (normalising, cutting, alignments) is done or not asked for
        tokenize = self.tok.model.tokenize
        ids = [[t.id for t in tokenize(word)] for word in byte_level(fresh)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        if ends[-1] > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros(max(self.flat.size, int(ends[-1]) - self.flat.size), dtype=np.uint32)])
        self.flat[self.ends[-1] : ends[-1]] = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum()))
        self.ends = ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
