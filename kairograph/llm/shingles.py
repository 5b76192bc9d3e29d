"""Sets of word shingles as sorted 64-bit hashes, and exact signatures for Jaccard joins; all over whole batches."""

from __future__ import annotations

import math

import numpy as np

from .common import ascii_lower, mix64, prefix_hash, span_hash, words_of

_STEP = np.uint64(0x9FB21C651E98DF25)
#: Families of signatures before sets with too many empty buckets share one by level.
FAMILIES = 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each row in ascending order.

    Words are runs without white space after A-Z were lower-cased.  A row with fewer words than ``width``
    has its whole sequence as the one shingle, one without words the empty set.
    """
    rows = offsets.size - 1
    low = ascii_lower(data)
    start, end, row = words_of(low, offsets)
    if not start.size:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    word = span_hash(prefix_hash(low), start, end)
    n = np.bincount(row, minlength=rows)
    parts_h, parts_r = [], []
    if word.size >= width:
        whole = row[width - 1 :] == row[: row.size - width + 1]
        h = np.zeros(word.size - width + 1, dtype=np.uint64)
        for j in range(width):
            h = h * _STEP + word[j : j + h.size]
        parts_h.append(mix64(h[whole]))
        parts_r.append(row[: h.size][whole])
    short = np.flatnonzero((n > 0) & (n < width))
    if short.size:
        first = np.cumsum(n) - n
        h = np.full(short.size, 0x51, dtype=np.uint64) + n[short].astype(np.uint64)
        for j in range(width - 1):
            on = n[short] > j
            h[on] = h[on] * _STEP + word[first[short[on]] + j]
        parts_h.append(mix64(h))
        parts_r.append(short)
    h, r = np.concatenate(parts_h), np.concatenate(parts_r)
    order = np.argsort(h)
    order = order[np.argsort(r[order].astype(np.uint16) if rows <= 1 << 16 else r[order], kind="stable")]
    h, r = h[order], r[order]
    new = np.ones(h.size, dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    out = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(np.bincount(r, minlength=rows), out=out[1:])
    return h, out


def set_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key of each set (0 for the empty one): equal sets have equal keys.  Of its 64 bits the low two are 01 and free for marks."""
    sums = np.zeros((2, hashes.size + 1), dtype=np.uint64)
    np.cumsum(mix64(hashes), out=sums[0, 1:])
    np.cumsum(mix64(hashes ^ _STEP), out=sums[1, 1:])
    a, b = offsets[:-1], offsets[1:]
    key = mix64((sums[0, b] - sums[0, a]) ^ mix64((sums[1, b] - sums[1, a]) + (b - a).astype(np.uint64)))
    return np.where(b > a, key & ~np.uint64(3) | np.uint64(1), np.uint64(0))


def most_apart(a, b, percent: int):
    """Elements that only one of two similar sets of a and b elements holds, at most."""
    return (a + b) * (100 - percent) // (100 + percent)


#: Similar sets share one signature and one more for each SHARED elements that they may differ in.
SHARED = 16


class Levels:
    """Signatures that every pair of sets with 100 |A & B| >= percent |A | B| shares at least one of.

    Such sets of a and b elements have at most D = (a + b) (100 - percent) / (100 + percent) elements that only
    one of them holds.  Elements are dealt to k > D + s buckets by hash; at least k - D buckets are equal in
    both, and one of these isn't empty if a set has at most s empty ones.  Its content is the signature.  k
    depends on a level of sizes, which are no further apart than similar sets may be; a set that may have a
    partner in the next level uses that level's k too.  A set with more empty buckets
    than s adds a second family of signatures, and so on; the partner does so as well, because buckets
    that are empty in both are empty in each.  Another ``round_`` deals the elements to buckets anew.
    """

    def __init__(self, percent: int, round_: int = 0):
        self.percent, self.round = percent, round_
        self.start, self.buckets, self.slack, self.most = [1], [], [], []
        while self.start[-1] < 1 << 40:
            low = self.start[-1]
            high = max(low + 1, low * 100 // percent)
            most = most_apart(high - 1, high - 1, percent)
            k, s = self._buckets(-(-low * percent // 100), most)  # guests are the smallest
            self.start.append(high)
            self.buckets.append(k if most else 0)  # sets that can't differ need no signature
            self.slack.append(s)
            self.most.append(most)
        self.start, self.buckets, self.slack, self.most = (np.array(x, dtype=np.int64) for x in (self.start, self.buckets, self.slack, self.most))

    @staticmethod
    def _buckets(low: int, most: int) -> tuple[int, int]:
        """k and s for sets of ``low`` elements at least that differ in ``most`` at most: few sets, and of the large ones hardly any, have more than s empty buckets."""
        spread = 3.0 if low >= 200 else 2.0 if low >= 60 else 1.0
        share = 1 + most // SHARED
        top = most + 2 + 2 * low + share
        k = most + share
        while k < top:
            empty = k * math.exp(-low / k)
            if k - most - share >= empty + spread * math.sqrt(empty):
                break
            k += max(1, k >> 7)
        return k, k - most - share

    def signatures(self, hashes: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, row), and for each row whether it has more empty buckets than s in every family of one of its levels.  common: a bit set of the hashes that the first family leaves out; any choice is right, frequent ones keep unlike sets apart."""
        n = np.diff(offsets)
        level = np.searchsorted(self.start, n, side="right") - 1
        guest = np.flatnonzero((n > 0) & (100 * n >= self.percent * self.start[np.minimum(level + 1, self.start.size - 1)]))
        own = np.flatnonzero(n > 0)
        rows, levels = np.concatenate([own, guest]), np.concatenate([level[own], level[guest] + 1])
        keep = self.buckets[levels] > 0
        rows, levels = rows[keep], levels[keep]
        sig, who = [], []
        bit = hashes & np.uint64(64 * common.size - 1)
        rare = (common[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 0
        odd = np.zeros(n.size, dtype=bool)
        for family in range(FAMILIES):
            if not rows.size:
                break
            s, r, sparse = self._family(hashes, offsets, rows, levels, rare if family == 0 else None, family + FAMILIES * self.round)
            sig.append(s)
            who.append(r)
            rows, levels = rows[sparse], levels[sparse]
        odd[rows] = True
        if rows.size:
            sig.append(mix64(levels.astype(np.uint64) + np.uint64(0xABCDEF)))
            who.append(rows)
        return (np.concatenate(sig), np.concatenate(who), odd) if sig else (np.zeros(0, np.uint64), np.zeros(0, np.int64), odd)

    def _family(self, hashes, offsets, rows, levels, rare, family):
        size = (offsets[1:] - offsets[:-1])[rows]
        at = np.zeros(rows.size + 1, dtype=np.int64)
        np.cumsum(size, out=at[1:])
        entry = np.repeat(np.arange(rows.size), size)
        h = hashes[np.arange(at[-1]) + np.repeat(offsets[:-1][rows] - at[:-1], size)]
        if rare is not None:
            ok = rare[np.arange(at[-1]) + np.repeat(offsets[:-1][rows] - at[:-1], size)]
            h, entry = h[ok], entry[ok]
        k = self.buckets[levels]
        base = np.cumsum(k) - k
        mixed = mix64(h + np.uint64(family * 0x1234567))
        bucket = ((mixed >> np.uint64(32)) * k[entry].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        slot = base[entry] + bucket
        total = int(k.sum())
        # order doesn't matter in a sum, so a bucket's content needs no sort
        low = mix64(mixed)
        sums = np.zeros(total, dtype=np.uint64)
        count = np.bincount(slot, minlength=total)
        np.add.at(sums, slot, low)
        row = np.repeat(np.arange(rows.size), k)
        full = count > 0
        empty = k - np.bincount(row[full], minlength=rows.size)
        number = np.arange(total) - base[row]
        tag = mix64((levels[row].astype(np.uint64) << np.uint64(40)) + (number.astype(np.uint64) << np.uint64(8)) + np.uint64(family + 1))
        sig = mix64((sums ^ tag) + count.astype(np.uint64))
        return sig[full], rows[row[full]], empty > self.slack[levels]
