"""Exact repeated passages: bytes covered by a LENGTH-byte string that also starts anywhere else.

What a longest-previous-factor array tells of a position, here only up to LENGTH: whether the string of
LENGTH bytes there has an earlier (or later) equal.  Positions are ordered by a 64-bit name of that string
and then by place, which is the suffix order cut off at the threshold; the neighbours with the same name
are the previous and the next equal one.  Naming every position of the corpus would cost eight bytes for
each byte, so it is done in two steps:

1. Every window of LENGTH bytes has an anchor, the least 64-byte gram in it.  Equal windows have equal
   anchors.  Windows that follow each other with one anchor are a run, named by its anchor and by its
   whole content.  Runs of equal content are repeated as they are; runs whose anchor is seen nowhere else
   are not repeated.
2. Only for runs with an anchor in common but other content each window is named and compared.

Names are dealt to tasks by their value, and a slice of text sends each name once, with a mark if it holds
it more often; so a passage that every document holds is no large group anywhere.  A task finishes one part
of its names after the other.

The same is done with words for symbols: PASSAGE words that also stand in another document are counted
beside the removed bytes, since a passage of that many words may be shorter than LENGTH bytes.

Defined results: texts are UTF-8 bytes, a null one is empty; matches never cross documents; repeated rows
and equal texts are copies of each other; texts shorter than LENGTH stay; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, by_part, discard, even_parts, in_filter, is_space, key_filter, mix64, only_in, powers, prefix_hash, releasing, row_slices, shuffle_partitions, span_hash, stored, table, text_bytes, tidy, words_of

LENGTH, GRAM = 400, 64
#: Words of a passage that counts as shared between documents (over 50), and those of its anchors.
PASSAGE, PASSAGE_GRAM = 51, 8
_POSITION_BITS = 24
#: Bytes of text worked on at once, window starts of one text at once, and bytes whose names are sent together.
SLICE, PIECE, TOGETHER = 1 << 18, 1 << 20, 1 << 22


def runs(offsets: np.ndarray, prefix: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor's name, content's name) of each run; windows count from the row's start.  offsets, prefix: the symbols' rows and prefix hashes."""
    width = length - gram + 1
    n = prefix.size - 1
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < length:
        return none
    grams = np.arange(n - gram + 1)
    names = span_hash(prefix, grams, grams + gram)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    key = (names & ~low) | grams.astype(np.uint64)
    pad = -key.size % width
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    anchor = (least & low).astype(np.int64)
    row = np.repeat(np.arange(offsets.size - 1), np.diff(offsets))[:windows]
    inside = np.arange(windows) + length <= offsets[1:][row]
    fresh = np.ones(windows, dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh & inside)
    if not first.size:
        return none
    ends = np.append(np.flatnonzero(fresh)[1:], windows) - 1
    last = ends[np.searchsorted(ends, first)]
    r = row[first]
    last = np.minimum(last, offsets[1:][r] - length)
    p = anchor[first]
    content = mix64(span_hash(prefix, first, last + length) ^ mix64(((p - first) << 20 | (last - first)).astype(np.uint64)))
    return r, first - offsets[:-1][r], last - offsets[:-1][r], names[p], content


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, prefix hashes) of texts whose symbols are their bytes."""
    return offsets, prefix_hash(data)


def word_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, names) of the words of texts, runs without white space; a long text is hashed in pieces that end after white space."""
    cuts = [0]
    while data.size - cuts[-1] > 2 * PIECE:
        at = cuts[-1] + PIECE
        while at < data.size and not (space := np.flatnonzero(is_space(data[at : at + PIECE]))).size:
            at += PIECE
        cuts.append(min(data.size, at + (int(space[0]) + 1 if space.size else 0)))
    cuts.append(data.size)
    names, rows = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        # rows that end inside the piece cut its words too
        start, end, row = words_of(data[a:b], np.clip(offsets - a, 0, b - a))
        names.append(span_hash(prefix_hash(data[a:b]), start, end))
        rows.append(row)
    return np.searchsorted(np.concatenate(rows), np.arange(offsets.size)), np.concatenate(names)


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, prefix hashes) of texts whose symbols are their words."""
    at, names = word_names(data, offsets)
    return at, _prefix(names)


def _prefix(names: np.ndarray) -> np.ndarray:
    out = np.zeros(names.size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(names * powers(names.size), out=out[1:])
    return out


def _pieces(batch, length: int, symbols):
    """(text keys, start of the piece in its text, offsets, prefix hashes) in slices small enough for the cache and for an anchor's position."""
    for some in row_slices(batch, 1, SLICE):
        data, offsets, _ = text_bytes(some.column(1))
        t = some.column(0).to_numpy().view(np.uint64)
        if data.size <= PIECE:
            yield t, 0, *symbols(data, offsets)
        else:  # one long text
            by_words = symbols is word_symbols
            long = word_names(data, offsets)[1] if by_words else data
            for a in range(0, max(1, long.size - length + 1), PIECE):
                part = long[a : a + PIECE + length - 1]
                yield t, a, np.array([0, part.size]), _prefix(part) if by_words else prefix_hash(part)


def _joined(t: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window ranges of a text that follow each other, as one."""
    if not t.size:
        return t, low, high
    order = np.lexsort((low, t))
    t, low, high = t[order], low[order], high[order]
    new = np.ones(t.size, dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (low[1:] > high[:-1] + 1)
    first = np.flatnonzero(new)
    return t[first], low[first], np.maximum.reduceat(high, first)


def _pack(low: np.ndarray, high: np.ndarray, flag: np.ndarray) -> np.ndarray:
    return (low << 10 | (high - low) << 1 | flag).astype(np.uint64)


def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = x.astype(np.int64)
    return x >> 10, (x >> 10) + (x >> 1 & 511), (x & 1).astype(bool)


def _dealt(name: np.ndarray, columns: list[np.ndarray], parts: np.ndarray):
    """(part, bytes of the columns) by the name's value."""
    part = (name % np.uint64(parts.size)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    stacked, part = np.stack(columns)[:, order], part[order]
    ends = np.searchsorted(part, np.arange(parts.size + 1))
    return [(int(parts[p]), stacked[:, ends[p] : ends[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(ends)).tolist()]


_DEALT = "part long, kind long, data binary"
_RANGES = "t long, low long, high long, kind long"


def _blob_batch(rows: list[tuple[int, int, bytes]]):
    import pyarrow as pa

    part, kind, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int64()), pa.array(data, pa.binary())], ["part", "kind", "data"])


def _range_batch(t: np.ndarray, low: np.ndarray, high: np.ndarray, kind: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(low), pa.array(high), pa.array(kind)], ["t", "low", "high", "kind"])


COVERED, ASKS, HELPS = 0, 1, 2


def _several(group: np.ndarray, t: np.ndarray, across: bool) -> np.ndarray:
    """For each group of rows ordered by (group, text) whether it has more than one row, or rows of more than one text."""
    if not across:
        return np.bincount(group) > 1
    other = np.zeros(int(group[-1]) + 1, dtype=bool)
    k = np.flatnonzero((group[1:] == group[:-1]) & (t[1:] != t[:-1]))
    other[group[k]] = True
    return other


def first_step(texts: DataFrame, length: int, gram: int, symbols, across: bool) -> DataFrame:
    """Ranges of windows of texts (t, text): COVERED, or to be compared window by window, as one that ASKS or only HELPS others."""
    parts = even_parts(texts.sparkSession, 2)

    def sent(held: list[tuple[np.ndarray, ...]]):
        g, c, t, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
        if not g.size:
            return
        order = np.lexsort((low, t, c, g))
        g, c, t, low, high = g[order], c[order], t[order], low[order], high[order]
        new = np.ones(g.size, dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        group = np.cumsum(new) - 1
        several = _several(group, t, across)
        full = several[group]
        tell = new | ~full  # one of those that are answered here, and all others
        out = [(p, 0, raw) for p, raw in _dealt(g[tell], [g[tell], c[tell], t[tell], _pack(low[tell], high[tell], full[tell])], parts)]
        ct, cl, ch = _joined(t[full], low[full], high[full])
        if ct.size:
            out.append((int(parts[int(ct[0] % np.uint64(parts.size))]), 1, np.stack([ct, cl.astype(np.uint64), ch.astype(np.uint64)]).tobytes()))
        yield _blob_batch(out)

    def deal(batches):
        for batch in batches:
            held, size = [], 0
            for t, at, offsets, prefix in _pieces(batch, length, symbols):
                r, low, high, g, c = runs(offsets, prefix, length, gram)
                held.append((g, c, t[r], low + at, high + at))
                size += prefix.size
                if size >= TOGETHER:
                    yield from sent(held)
                    held, size = [], 0
            if held:
                yield from sent(held)

    def meet(batches):
        for rows in by_part(batches):
            for raw in (raw for kind, raw in rows if kind):
                x = np.frombuffer(raw, dtype=np.uint64).reshape(3, -1)
                yield _range_batch(x[0].copy(), x[1].astype(np.int64), x[2].astype(np.int64), np.full(x.shape[1], COVERED, dtype=np.int64))
            held = [np.frombuffer(raw, dtype=np.uint64).reshape(4, -1) for kind, raw in rows if not kind]
            if not held:
                continue
            g, c, t, packed = np.concatenate(held, axis=1)
            order = np.argsort(g, kind="stable")
            g = g[order]
            alone = np.ones(g.size, dtype=bool)
            alone[1:] &= g[1:] != g[:-1]
            alone[:-1] &= g[1:] != g[:-1]
            # a run marked as held several times is covered already; alone it has nothing to compare with
            order, g = order[~alone], g[~alone]
            if not g.size:
                continue
            c, t, packed = c[order], t[order], packed[order]
            order = np.lexsort((t, c, g))
            g, c, t, packed = g[order], c[order], t[order], packed[order]
            low, high, many = _unpack(packed)
            new = np.ones(g.size, dtype=bool)
            new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            group = np.cumsum(new) - 1
            several = _several(group, t, across)
            np.logical_or.at(several, group, many)
            full = several[group] & ~many
            if full.any():
                ct, cl, ch = _joined(t[full], low[full], high[full])
                yield _range_batch(ct, cl, ch, np.full(ct.size, COVERED, dtype=np.int64))
            first = np.flatnonzero(new)
            gg = g[first]
            mixed = np.zeros(gg.size, dtype=bool)
            mixed[1:] |= gg[1:] == gg[:-1]
            mixed[:-1] |= gg[1:] == gg[:-1]
            # those not answered ask; of the others one helps
            pick = (mixed & ~several)[group] | (new & (mixed & several)[group])
            if pick.any():
                yield _range_batch(t[pick], low[pick], high[pick], np.where(several[group][pick], HELPS, ASKS).astype(np.int64))

    dealt = texts.mapInArrow(releasing(deal), _DEALT).repartition(shuffle_partitions(texts.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(releasing(meet), _RANGES)


def second_step(asked: DataFrame, length: int, symbols, across: bool) -> DataFrame:
    """Covered ranges from comparing windows one by one; asked: t, text and the list of ranges."""
    parts = even_parts(asked.sparkSession, 2)

    def named(some):
        """(name, text, window, whether it asks) of the windows in the ranges of a slice, each text once."""
        data, offsets, _ = text_bytes(some.column(1))
        offsets, prefix = symbols(data, offsets)
        t = some.column(0).to_numpy().view(np.uint64)
        _, firsts = np.unique(t, return_index=True)
        lists = some.column(2)
        at = lists.offsets.to_numpy().astype(np.int64)
        low, high, kind = (lists.values.field(k).to_numpy(zero_copy_only=False)[int(at[0]) : int(at[-1])] for k in range(3))
        entry = np.repeat(np.arange(t.size), np.diff(at))
        chosen = np.zeros(t.size, dtype=bool)
        chosen[firsts] = True
        keep = chosen[entry]
        entry, low, high, kind = entry[keep], low[keep], high[keep], kind[keep]
        n = high - low + 1
        owner = np.repeat(np.arange(n.size), n)
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[owner]
        where = offsets[:-1][entry[owner]] + start
        return span_hash(prefix, where, where + length), t[entry[owner]], start, kind[owner] == ASKS

    def sent(held: list[tuple[np.ndarray, ...]]):
        name, t, start, asks = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((~asks, start, t, name))
        name, t, start, asks = name[order], t[order], start[order], asks[order]
        keep = np.ones(name.size, dtype=bool)
        keep[1:] = (name[1:] != name[:-1]) | (t[1:] != t[:-1]) | (start[1:] != start[:-1])  # a text may be in two slices
        name, t, start, asks = name[keep], t[keep], start[keep], asks[keep]
        if not name.size:
            return
        new = np.ones(name.size, dtype=bool)
        new[1:] = name[1:] != name[:-1]
        group = np.cumsum(new) - 1
        found = _several(group, t, across)
        np.logical_or.at(found, group, ~asks)  # what helps stands in several places
        several = found[group]
        full = several & asks
        # one for each name that several hold, as all of them are answered here; else all
        tell = new | ~several
        tell = [name[tell], t[tell], (start[tell] << 2 | several[tell] << 1 | ~several[tell]).astype(np.uint64)]
        out = [(p, 0, raw) for p, raw in _dealt(tell[0], tell, parts)]
        ct, cl, ch = _joined(t[full], start[full], start[full])
        if ct.size:
            out.append((int(parts[int(ct[0] % np.uint64(parts.size))]), 1, np.stack([ct, cl.astype(np.uint64), ch.astype(np.uint64)]).tobytes()))
        yield _blob_batch(out)

    def deal(batches):
        for batch in batches:
            held, size = [], 0
            for some in row_slices(batch, 1, SLICE):
                held.append(named(some))
                size += held[-1][0].size
                if size >= TOGETHER // 8:
                    yield from sent(held)
                    held, size = [], 0
            if held:
                yield from sent(held)

    def meet(batches):
        for rows in by_part(batches):
            for raw in (raw for kind, raw in rows if kind):
                x = np.frombuffer(raw, dtype=np.uint64).reshape(3, -1)
                yield _range_batch(x[0].copy(), x[1].astype(np.int64), x[2].astype(np.int64), np.full(x.shape[1], COVERED, dtype=np.int64))
            held = [np.frombuffer(raw, dtype=np.uint64).reshape(3, -1) for kind, raw in rows if not kind]
            if not held:
                continue
            name, t, packed = np.concatenate(held, axis=1)
            order = np.lexsort((packed, t, name))
            name, t, packed = name[order], t[order], packed[order]
            place = packed >> np.uint64(2)
            new = np.ones(name.size, dtype=bool)
            new[1:] = name[1:] != name[:-1]
            group = np.cumsum(new) - 1
            # one place may have been sent by two copies of its text
            again = np.zeros(name.size, dtype=bool)
            again[1:] = ~new[1:] & (t[1:] == t[:-1]) & (place[1:] == place[:-1])
            found = _several(group[~again], t[~again], across)
            np.logical_or.at(found, group, (packed & np.uint64(2)) > 0)
            full = found[group] & ((packed & np.uint64(1)) == 1)
            if full.any():
                start = place[full].astype(np.int64)
                ct, cl, ch = _joined(t[full], start, start)
                yield _range_batch(ct, cl, ch, np.full(ct.size, COVERED, dtype=np.int64))

    dealt = asked.mapInArrow(releasing(deal), _DEALT).repartition(shuffle_partitions(asked.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(releasing(meet), _RANGES)


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def covered_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, symbols=byte_symbols, across: bool = False) -> DataFrame:
    """(t, low, high): ranges of windows of the texts (t, text) whose string also starts elsewhere, or, with ``across``, in another text."""
    sc = texts.sparkSession.sparkContext
    ranges = stored(first_step(texts, length, gram, symbols, across), "repeat-ranges")
    done = ranges.filter(F.col("kind") == COVERED).select("t", "low", "high")
    open_ = ranges.filter(F.col("kind") != COVERED)
    # stored, so that Spark can split the join where many rows hold one text
    lists = stored(open_.groupBy("t").agg(F.collect_list(F.struct("low", "high", "kind")).alias("ranges")).withColumnRenamed("t", "r_t"), "repeat-asked")
    some = only_in(texts, sc.broadcast(key_filter(open_)))
    asked = some.join(lists, some["t"] == lists["r_t"]).select("t", "text", "ranges")
    covered = stored(done.unionByName(second_step(asked, length, symbols, across).select("t", "low", "high")), "repeat-covered")
    discard(ranges)
    discard(lists)
    tidy(texts.sparkSession)
    return covered


def _merged(row: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs that windows in the ranges cover, in order."""
    if not row.size:
        return row, low, high
    order = np.lexsort((low, row))
    row, low, high = row[order], low[order], high[order]
    apart = row * (int(high.max()) + length + 2)  # so that no run goes on into the next row
    reach = np.maximum.accumulate(high + apart)
    new = np.ones(row.size, dtype=bool)
    new[1:] = (low + apart)[1:] > reach[:-1] + length
    first = np.flatnonzero(new)
    last = np.append(first[1:], row.size) - 1
    return row[first], low[first], reach[last] - apart[last] + length


_BYTES, _WORDS, _COPIED = 0, 1, 2


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE, keep_text: bool = False) -> DataFrame:
    """Per document: its bytes, those removed, the removed runs, a digest of the rest, the words in passages shared with other documents, and the rest itself on request."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id")).select(text_key(F.col("text")).alias("t"), "text", "doc_id")
    texts = rows.select("t", "text")
    in_bytes = covered_ranges(texts, length, gram)
    in_words = covered_ranges(texts, passage, max(1, min(PASSAGE_GRAM, passage)), word_symbols, across=True)
    copied = rows.groupBy("t").count().filter("count > 1").select("t", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    ranges = reduce(DataFrame.unionByName, [x.withColumn("kind", F.lit(k)) for k, x in ((_BYTES, in_bytes), (_WORDS, in_words), (_COPIED, copied))])
    lists = stored(ranges.groupBy("t").agg(F.collect_list(F.struct("kind", "low", "high")).alias("ranges")).withColumnRenamed("t", "r_t"), "repeat-lists")
    for done in (in_bytes, in_words):
        discard(done)
    bits = spark.sparkContext.broadcast(key_filter(lists.select(F.col("r_t").alias("t"))))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long" + (", kept binary" if keep_text else "")

    def measured(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_columns == 3:  # not joined: the rows that have no ranges
                batch = batch.filter(pa.array(~in_filter(bits.value, batch.column(0).to_numpy())))
            if not (n := batch.num_rows):
                continue
            row = low = high = kind = np.zeros(0, dtype=np.int64)
            if batch.num_columns > 3:
                lists = batch.column(3)
                at = lists.offsets.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(n), np.diff(at))
                kind, low, high = (lists.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64)[int(at[0]) : int(at[-1])] for k in range(3))
            mine = kind == _BYTES
            of, start, end = _merged(row[mine], low[mine], high[mine], length)
            at = np.searchsorted(of, np.arange(n + 1)).tolist()
            start, end = start.tolist(), end.tolist()
            mine = kind == _WORDS
            words, a, b = _merged(row[mine], low[mine], high[mine], passage)
            shared = np.bincount(words, weights=b - a, minlength=n).astype(np.int64).tolist()
            copied = np.zeros(n, dtype=bool)
            copied[row[kind == _COPIED]] = True
            out = []
            for k, raw in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                i, j = at[k], at[k + 1]
                kept = b"".join(raw[x:y] for x, y in zip([0, *end[i:j]], [*start[i:j], len(raw)], strict=True)) if i < j else raw
                if copied[k]:
                    n_words = len(raw.split())  # of bytes: at space and tab to carriage return
                    shared[k] = n_words if n_words >= passage else 0
                out.append((len(raw), len(raw) - len(kept), j - i, hashlib.sha256(kept).hexdigest(), shared[k], kept))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: 6 if keep_text else 5]
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", "kept"][: 7 if keep_text else 6])

    some = only_in(rows, bits)
    held = some.join(lists, some["t"] == lists["r_t"], "left").select("t", "text", "doc_id", "ranges")
    return held.mapInArrow(measured, schema).unionByName(rows.mapInArrow(measured, schema))


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op7_repeats": op7_repeats}
ORACLE_SQL: dict[str, str] = {}
