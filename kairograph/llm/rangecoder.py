"""An adaptive context-mixing range coder for token ids.

The ids of a stripe share a table (:class:`Table`), stored once in its head: how often each id stands there
(order 0), and by which id it is followed most often and how surely (order 1).  Ids are cut into blocks.
Every block starts from the same fresh model and carries checksums of its coded bytes and of its ids, so
each can be read alone with the head.  The next id is predicted by a mixture:

    P(x) = w [x = c] + (1 - w) P0(x)

c is the id that followed the same two ids in this block before (order 2), if there is one, and else the
table's follower of the last id (order 1); P0 is the table's order 0.  The weights w are hit rates that
adapt in the block, one for each degree of confidence in c, and so does the table of order 2: a guess that
was right more than once stays for a miss.  One interval of a carry-less range coder (64-bit state, 16-bit
words) codes each id.  Everything is integer arithmetic, so all machines agree.

Blocks are coded side by side: one step of numpy work handles the same position of every block.  Choices
between two values are made by masks (0 or all ones), since a branch for each id costs more.  Ids are
unsigned 32-bit numbers, at most MOST_IDS different ones in a stripe.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
#: Blocks worked on side by side.
LANES = 4096

_U, _U32 = np.uint64, np.uint32
_SLOT_BITS = 11
_SLOTS = 1 << _SLOT_BITS
_GUESS_BITS = 28  # of an entry of order 2; above them its confidence
_GUESS = (1 << _GUESS_BITS) - 1
_WEIGHT_BITS, _COUNT_BITS = 12, 20
_WEIGHT, _COUNT = 1 << _WEIGHT_BITS, 1 << _COUNT_BITS
_TOTAL = _WEIGHT_BITS + _COUNT_BITS  # bits of an interval
_SMALL, _TOP = _U(1 << 40), _U(1 << 48)
MOST_IDS = _COUNT // 2

#: Degrees of sureness of order 1 (upper bounds of the follower's share, in 4096ths) and where the weights begin.
_SURE = np.array([8, 16, 32, 64, 128, 256, 400, 600, 900, 1200, 1600, 2100, 2700, 3300, 3900, 4097])
_DEGREES = _SURE.size
#: A follower that was seen less often tells nothing.
_LEAST_FOLLOWED = 4


class Table:
    """What the blocks of a stripe share.  ids: the different ones, ascending; the coder works with their places."""

    def __init__(self, ids: np.ndarray, count: np.ndarray, follower: np.ndarray, degree: np.ndarray):
        self.ids, self.count, self.follower, self.degree = ids, count, follower, degree
        self.below = np.cumsum(count) - count

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Table, np.ndarray]:
        """The table of a stripe and the places of its ids."""
        if ids.size and int(ids.max()) < max(_COUNT, 8 * ids.size):  # small numbers: count instead of sorting
            n = np.bincount(ids)
            known = np.flatnonzero(n)
            place, n = (np.cumsum(n > 0) - 1)[ids], n[known]
        else:
            known, place, n = np.unique(ids, return_inverse=True, return_counts=True)
        if known.size > MOST_IDS:
            raise ValueError(f"more than {MOST_IDS} different ids in a stripe")
        count = np.maximum(1, n * (_COUNT - known.size) // max(1, ids.size))
        if count.size:
            count[np.argmax(count)] += _COUNT - int(count.sum())
        follower, degree = np.zeros(known.size, dtype=np.int64), np.zeros(known.size, dtype=np.int64)
        if place.size > 1:
            pair = np.sort(place[:-1] * known.size + place[1:])
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            seen, pair = np.diff(np.append(first, pair.size)), pair[first]
            one = pair // known.size
            order = np.lexsort((pair, -seen, one))
            best = order[np.concatenate([[True], one[order][1:] != one[order][:-1]])]
            best = best[seen[best] >= _LEAST_FOLLOWED]
            share = seen[best] * _WEIGHT // n[one[best]]
            follower[one[best]], degree[one[best]] = pair[best] % known.size, np.searchsorted(_SURE, share, side="right")
        return cls(known, count, follower, degree), place

    def to_bytes(self) -> bytes:
        columns = (np.diff(self.ids.astype(np.int64), prepend=0).astype("<u4"), self.count.astype("<u4"), np.where(self.degree > 0, self.follower, 0).astype("<u4"), self.degree.astype(np.uint8))
        return struct.pack("<I", self.ids.size) + zlib.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(c.size, c.itemsize).T.tobytes() for c in columns), 6)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        n = struct.unpack_from("<I", raw)[0]
        data, at, columns = np.frombuffer(zlib.decompress(raw[4:]), dtype=np.uint8), 0, []
        for width in (4, 4, 4, 1):
            rows = np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T)
            columns.append(rows.view("<u4").ravel().astype(np.int64) if width == 4 else rows.ravel().astype(np.int64))
            at += n * width
        return cls(np.cumsum(columns[0]), *columns[1:])


def _joined(tables: list[Table]):
    """(start of each table, counts, sums below, followers, degrees) of several tables behind each other."""
    start = np.cumsum([0, *(t.ids.size for t in tables)])
    kinds = {"count": np.int64, "below": np.int64, "follower": np.int32, "degree": np.int32}
    return start, *(np.concatenate([getattr(t, c) for t in tables]).astype(kind) for c, kind in kinds.items())


#: Weights that a block begins with: by degree for a guess of order 1, then for one of order 2 by its confidence (1 to 3).
_FIRST = np.array([4, 12, 24, 48, 96, 192, 320, 500, 750, 1050, 1400, 1850, 2400, 3000, 3600, 4000, 600, 1800, 2800], dtype=np.int32)
_KINDS = 32
_GOAL_MISS, _GOAL_HIT = 8, _WEIGHT - 8
#: Confidence after a miss and after a hit; the entry of a fresh guess.
_AFTER = np.array([1, 1, 1, 2, 1, 2, 3, 3], dtype=np.int32) << _GUESS_BITS


def _chosen(mask: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``one`` where the mask is all ones, ``other`` where it is 0."""
    out = one ^ other
    out &= mask
    out ^= other
    return out


class _Model:
    """What coder and decoder know of n blocks; lanes are ordered by falling length, the first ``a`` are active.  two: the id before the last one, times a number."""

    def __init__(self, n: int):
        self.pair = np.zeros(n * _SLOTS, dtype=np.int32)
        self.weight = np.tile(np.pad(_FIRST, (0, _KINDS - _FIRST.size)), n)
        lanes = np.arange(n, dtype=np.int64)
        self.slot_base, self.kind_base = lanes * _SLOTS, lanes * _KINDS
        self.one, self.two = np.zeros(n, dtype=np.uint32), np.zeros(n, dtype=np.uint32)

    def guess(self, a: int, follower: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(guessed places, weights), given order 1's."""
        h = self.one[:a] * _U32(0x85EBCA6B)
        h += self.two[:a]
        h >>= _U32(32 - _SLOT_BITS)
        self.at = self.slot_base[:a] + h
        entry = self.pair.take(self.at)
        own = -entry
        own >>= 31
        self.sure = entry >> _GUESS_BITS
        entry &= _GUESS
        self.second = entry
        self.kind = self.kind_base[:a] + _chosen(own, self.sure + (_DEGREES - 1), degree)
        self.w = self.weight.take(self.kind)
        return _chosen(own, entry, follower), self.w

    def learn(self, a: int, x: np.ndarray, miss: np.ndarray) -> None:
        """x: the places that came; miss: a mask of those that were not the guesses."""
        step = miss & (_GOAL_MISS - _GOAL_HIT)
        step += _GOAL_HIT
        step -= self.w
        step >>= 5
        step += self.w
        self.weight[self.kind] = step
        after = (self.second == x).view(np.int8) << 2
        after = _AFTER.take(self.sure + after)
        stays = 1 - self.sure
        stays >>= 31
        after |= _chosen(stays, self.second, x)
        self.pair[self.at] = after
        np.multiply(self.one[:a], _U32(0xC2B2AE35), out=self.two[:a])
        self.one[:a] = x


def _shifted(low: np.ndarray, span: np.ndarray, a: int):
    """Lanes whose first 16 bits are settled, with their states, until there are none; low and span move on."""
    l, s = low[:a], span[:a]
    ready = np.flatnonzero(((l ^ (l + s - _U(1))) < _TOP) | (s < _SMALL))
    while ready.size:
        li, si = l[ready], s[ready]
        same = (li ^ (li + si - _U(1))) < _TOP
        if not same.all():
            si = np.where(same, si, (~li + _U(1)) & (_SMALL - _U(1)))
        yield ready, li
        li <<= _U(16)
        si <<= _U(16)
        l[ready], s[ready] = li, si
        ready = ready[((li ^ (li + si - _U(1))) < _TOP) | (si < _SMALL)]


def encode_blocks(blocks: list[np.ndarray], tables: list[Table], of: list[int]) -> list[bytes]:
    """Coded bytes of each block of places in the table ``of`` it."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    out: list[bytes] = [b""] * len(blocks)
    joined = _joined(tables) if tables else None
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        for k, data in zip(some, _encode([blocks[k] for k in some], joined, np.array([of[k] for k in some])), strict=True):
            out[k] = data
    return out


def _encode(blocks: list[np.ndarray], tables, of: np.ndarray) -> list[bytes]:
    start, count, below, follower, degree = tables
    n, sizes = len(blocks), np.array([len(b) for b in blocks])
    steps = int(sizes[0]) if n else 0
    grid = np.zeros((steps + 1, n), dtype=np.int32)  # the first row: no id before
    for k, b in enumerate(blocks):
        grid[1 : len(b) + 1, k] = b
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    model, base = _Model(n), start[of]
    low, span = np.zeros(n, dtype=np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    lanes, words = [], []
    for t in range(steps):
        a = int(active[t])
        before, x = grid[t, :a], grid[t + 1, :a]
        at = base[:a] + before
        guess, w = model.guess(a, follower.take(at), degree.take(at))
        miss = -(x != guess).astype(np.int64)
        here = base[:a] + x
        wide = w.astype(np.int64)
        rest = _WEIGHT - wide
        wide <<= _COUNT_BITS
        size = _chosen(miss, rest * count.take(here), wide)
        rest *= below.take(here)
        rest += wide
        rest &= miss
        r = span[:a] >> _U(_TOTAL)
        low[:a] += r * rest.view(np.uint64)
        np.multiply(r, size.view(np.uint64), out=span[:a])
        for ready, state in _shifted(low, span, a):
            lanes.append(ready.astype(np.uint16))
            words.append((state >> _U(48)).astype(np.uint16))
        model.learn(a, x, miss.astype(np.int32))
    final = (low + (_SMALL - _U(1))) & ~(_SMALL - _U(1))
    for shift in (48, 32):
        lanes.append(np.arange(n, dtype=np.uint16))
        words.append((final >> _U(shift)).astype(np.uint16))
    lane, word = np.concatenate(lanes), np.concatenate(words).astype("<u2")
    by = np.argsort(lane, kind="stable")
    ends = np.cumsum(np.bincount(lane, minlength=n))
    word = word[by]
    return [word[e0:e].tobytes() for e0, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def decode_blocks(data: list[bytes], sizes: list[int], tables: list[Table], of: list[int]) -> list[np.ndarray]:
    """Places of each block, given its coded bytes and its number of ids."""
    order = sorted(range(len(data)), key=lambda k: -sizes[k])
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(data)
    joined = _joined(tables) if tables else None
    # which id each count of a table belongs to
    places = [np.repeat(np.arange(t.ids.size, dtype=np.int32), t.count) for t in tables]
    places = np.concatenate(places) if places else None
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        for k, ids in zip(some, _decode([data[k] for k in some], np.array([sizes[k] for k in some]), joined, places, np.array([of[k] for k in some])), strict=True):
            out[k] = ids
    return out


def _decode(data: list[bytes], sizes: np.ndarray, tables, places: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    start, count, below, follower, degree = tables
    n = len(data)
    steps = int(sizes[0]) if n else 0
    words = np.frombuffer(b"".join(d + bytes(8) for d in data), dtype="<u2")
    cursor = np.cumsum([0] + [len(d) // 2 + 4 for d in data])[:-1].astype(np.int64)
    code = np.zeros(n, dtype=np.uint64)
    for j in range(4):
        code = code << _U(16) | words[cursor + j]
    cursor += 4
    limit = words.size - 1
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    model, base, counts_base = _Model(n), start[of], of.astype(np.int64) << _COUNT_BITS
    low, span = np.zeros(n, dtype=np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    grid = np.zeros((steps + 1, n), dtype=np.int32)
    for t in range(steps):
        a = int(active[t])
        at = base[:a] + grid[t, :a]
        guess, w = model.guess(a, follower.take(at), degree.take(at))
        r = span[:a] >> _U(_TOTAL)
        v = ((code[:a] - low[:a]) // r).view(np.int64)
        np.minimum(v, (1 << _TOTAL) - 1, out=v)
        wide = w.astype(np.int64)
        rest = _WEIGHT - wide
        wide <<= _COUNT_BITS
        v -= wide
        miss = v >> 63
        np.invert(miss, out=miss)
        v &= miss
        unsigned = v.view(np.uint64)
        unsigned //= rest.view(np.uint64)
        v += counts_base[:a]
        missed, x = miss.astype(np.int32), grid[t + 1, :a]
        x[:] = _chosen(missed, places.take(v), guess)
        here = base[:a] + x
        size = _chosen(miss, rest * count.take(here), wide)
        rest *= below.take(here)
        rest += wide
        rest &= miss
        low[:a] += r * rest.view(np.uint64)
        np.multiply(r, size.view(np.uint64), out=span[:a])
        for ready, _ in _shifted(low, span, a):
            place = cursor[ready]
            code[ready] = code[ready] << _U(16) | words[np.minimum(place, limit)]
            cursor[ready] = place + 1
        model.learn(a, x, missed)
    return [grid[1 : k + 1, j] for j, k in enumerate(sizes.tolist())]


# --- stripes: whole documents, in as many blocks as they need

MAGIC = b"KTS2"


def write_stripes(stripes: list[tuple[list[int | None], np.ndarray, np.ndarray, int]]) -> list[bytes]:
    """Stripes (document ids, lengths, ids, ids before it in its file) as bytes; several at once, so that more blocks are coded side by side.

    A stripe is a magic number, counts, documents, the table, a directory of the blocks, and the coded blocks; a
    checksum holds for all but these.
    """
    tables, cuts, of = [], [], []
    for k, (_, _, ids, _) in enumerate(stripes):
        table, place = Table.of(np.asarray(ids))
        tables.append(table)
        cuts.append([place[a : a + BLOCK] for a in range(0, len(place), BLOCK)])
        of += [k] * len(cuts[-1])
    coded = encode_blocks([b for blocks in cuts for b in blocks], tables, of)
    out, at = [], 0
    for (doc_ids, lengths, ids, before), blocks, table in zip(stripes, cuts, tables, strict=True):
        mine = coded[at : at + len(blocks)]
        at += len(blocks)
        null, shared = np.array([d is None for d in doc_ids], dtype=np.uint8), table.to_bytes()
        head = struct.pack("<QQQQQ", before, len(doc_ids), len(ids), len(blocks), len(shared))
        head += np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + null.tobytes() + np.asarray(lengths, dtype="<u8").tobytes() + shared
        directory = np.zeros((len(blocks), 4), dtype="<u4")
        raw = np.ascontiguousarray(ids, dtype="<u4")
        for k, c in enumerate(mine):
            part = raw[k * BLOCK : (k + 1) * BLOCK]
            directory[k] = part.size, len(c), zlib.crc32(c), zlib.crc32(part.tobytes())
        head += directory.tobytes()
        out.append(MAGIC + struct.pack("<I", zlib.crc32(head)) + head + b"".join(mine))
    return out


def read_stripes(data: list[bytes]) -> list[tuple[list[int | None], np.ndarray, np.ndarray, int]]:
    """(document ids, lengths, ids, ids before) of each stripe; a wrong checksum raises ValueError."""
    heads, tables, coded, sizes, sums, of = [], [], [], [], [], []
    for number, raw in enumerate(data):
        if raw[:4] != MAGIC:
            raise ValueError("not a stripe of token ids")
        before, docs, _, blocks, shared = struct.unpack_from("<QQQQQ", raw, 8)
        end = 48 + docs * 17 + shared + blocks * 16
        if zlib.crc32(raw[8:end]) != struct.unpack_from("<I", raw, 4)[0]:
            raise ValueError("checksum of a stripe's head")
        doc_ids = np.frombuffer(raw, "<i8", docs, 48)
        null = np.frombuffer(raw, np.uint8, docs, 48 + 8 * docs)
        lengths = np.frombuffer(raw, "<u8", docs, 48 + 9 * docs).astype(np.int64)
        at = 48 + 17 * docs
        tables.append(Table.from_bytes(raw[at : at + shared]))
        directory = np.frombuffer(raw, "<u4", blocks * 4, at + shared).reshape(-1, 4)
        for size, stored, check, ids_check in directory.tolist():
            part = raw[end : end + stored]
            end += stored
            if zlib.crc32(part) != check:
                raise ValueError("checksum of a coded block")
            coded.append(part)
            sizes.append(size)
            sums.append(ids_check)
            of.append(number)
        heads.append(([None if z else d for d, z in zip(doc_ids.tolist(), null.tolist(), strict=True)], lengths, before, blocks))
    decoded = [np.ascontiguousarray(tables[k].ids[b], dtype="<u4") for k, b in zip(of, decode_blocks(coded, sizes, tables, of), strict=True)]
    for b, check in zip(decoded, sums, strict=True):
        if zlib.crc32(b.tobytes()) != check:
            raise ValueError("checksum of a block's ids")
    out, at = [], 0
    for doc_ids, lengths, before, blocks in heads:
        mine = decoded[at : at + blocks]
        at += blocks
        out.append((doc_ids, lengths, np.concatenate(mine) if mine else np.zeros(0, "<u4"), before))
    return out
