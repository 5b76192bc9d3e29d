"""N-gram Jaccard join with prefix trees.

Equal sets are one class from the start.  Signatures (see ``shingles``) that every similar pair of
classes shares bring possible partners together: chains over equal signatures, as components, hold every
link.  Each such group stores its globally ordered sets (frequent n-grams first) in a prefix tree; all
sets of the group walk the tree together, share the overlap of a common path, and leave a subtree once
the missed elements or the remaining length can't reach the threshold.  What a walk ends at is compared
exactly.

Groups of very many blocks, which chance meetings may hold together, are dealt anew by other signatures
within the group; what isn't similar hardly meets twice.  A group is split into blocks of MEMBERS sets.  A
few pivots of the group go into every block and tie the blocks' clusters together; sets outside the group's
largest cluster are then walked against all its blocks.  So no task holds a large group, a group of near
copies costs time in proportion, and no link is left out.

Defined results: words as in ``shingles``; a document without words links with nothing; equal sets link,
repeated rows too; a null doc_id is returned as it is and never chosen as component_id while another is
there; other columns are ignored (kept by :func:`deduplicate`); an empty table gives no rows.  Sets and
n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, by_part, discard, even_parts, key_filter, mix64, only_in, releasing, row_slices, shuffle_partitions, stored, table, text_bytes, tidy, without
from .graph import components
from .shingles import Levels, set_keys, shingle_sets

WIDTH, PERCENT = 3, 90
#: Sets in a block, and bits (sets x different n-grams) of its table.
MEMBERS, CELLS = 1024, 1_000_000_000
PIVOTS = 32
#: Groups of more blocks are dealt anew, so often at most, and while this part of their sets at most stays in such groups; all concern speed only.
LARGE, ROUNDS, STILL = 8, 6, 0.7
#: Copies of sets for which the blocks of large groups are compared at a time, in so many rounds at most.
COPIES, COMPARED = 50_000, 8
#: So many signatures in common make a pair part of a component.
MANY = 8
#: Signatures of so many classes give each pair of them.
FEW = 5
#: An n-gram is common if TIMES documents hold it; common ones are known by bits of a set of fixed size.
TIMES, COMMON_BITS = 12, 25


def _sets(batch, width: int):
    """(slice of the batch, hashes, offsets) of about 1 MB of text each; the text is the second column."""
    for some in row_slices(batch, 1, 1 << 20):
        data, offsets, _ = text_bytes(some.column(1))
        hashes, at = shingle_sets(data, offsets, width)
        yield some, hashes, at


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def keys(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, hash of the text, set size and class of each document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for some, hashes, at in _sets(batch, width):
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(np.diff(at)), pa.array(_signed(set_keys(hashes, at)))], ["doc_id", "th", "n", "cls"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(run, "doc_id long, th long, n long, cls long")


def common_ngrams(docs: DataFrame, width: int) -> np.ndarray:
    """A bit set of the n-grams that TIMES documents or more hold, counted over all documents.

    Only speed depends on it: the signatures are exact whichever n-grams are left out of their first
    family, so a set with chance hits will do.
    """
    spark = docs.sparkSession
    parts = even_parts(spark)
    first = np.arange(parts.size, dtype=np.uint64) * np.uint64((1 << 64) // parts.size)  # least n-gram of each part

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for _, hashes, _ in _sets(batch, width):
                own, n = np.unique(hashes, return_counts=True)
                # kind 0: n-grams of one document here; kind 1: of more, each followed by their number
                for kind, on in enumerate((n == 1, n > 1)):
                    some = own[on]
                    ends = np.append(np.searchsorted(some, first), some.size)
                    where = np.flatnonzero(np.diff(ends))
                    if kind:
                        some = np.stack([some, n[on].astype(np.uint64)], axis=1)
                    blobs = [some[ends[p] : ends[p + 1]].tobytes() for p in where]
                    yield pa.RecordBatch.from_arrays([pa.array(parts[where]), pa.array(np.full(where.size, kind)), pa.array(blobs, pa.binary())], ["part", "kind", "data"])

    def count(batches):
        import pyarrow as pa

        for held in by_part(batches):
            once = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(raw, np.uint64) for kind, raw in held if not kind)])
            more = np.concatenate([np.zeros((0, 2), np.uint64), *(np.frombuffer(raw, np.uint64).reshape(-1, 2) for kind, raw in held if kind)])
            own, n = np.concatenate([once, more[:, 0]]), np.concatenate([np.ones(once.size, np.int64), more[:, 1].astype(np.int64)])
            order = np.argsort(own)
            own, n = own[order], n[order]
            new = np.ones(own.size, dtype=bool)
            new[1:] = own[1:] != own[:-1]
            head = np.flatnonzero(new)
            bit = own[head][np.add.reduceat(n, head) >= TIMES] & np.uint64((1 << COMMON_BITS) - 1)
            word, at = np.unique(bit >> np.uint64(6), return_inverse=True)
            bits = np.zeros(word.size, dtype=np.uint64)
            np.bitwise_or.at(bits, at, np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(word)), pa.array(_signed(bits))], ["w", "b"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = text.mapInArrow(releasing(deal), "part long, kind long, data binary")
    counted = dealt.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part").mapInArrow(releasing(count), "w long, b long")
    found = counted.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # so many rows at most as the set has words
    out = np.zeros(1 << (COMMON_BITS - 6), dtype=np.uint64)
    out[found["w"].to_numpy(dtype=np.int64)] = found["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _chained(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, class) in order, each once, and the position of each signature's first entry."""
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    keep = np.ones(sig.size, dtype=bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
    sig, cls = sig[keep], cls[keep]
    new = np.ones(sig.size, dtype=bool)
    new[1:] = sig[1:] != sig[:-1]
    return sig, cls, np.flatnonzero(new)


def _counted(links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, how often, whether strong) of rows of links (a, b, strong) or (a, b, strong, how often)."""
    n = np.concatenate([x[:, 3].astype(np.int64) if x.shape[1] > 3 else np.ones(len(x), dtype=np.int64) for x in links])
    x = np.concatenate([x[:, :3] for x in links])
    order = np.lexsort((x[:, 1], x[:, 0]))
    x, n = x[order], n[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])
    first = np.flatnonzero(new)
    return x[first, 0], x[first, 1], np.add.reduceat(n, first), np.maximum.reduceat(x[:, 2], first)


def _shared(levels: Levels, cls: np.ndarray, hashes: np.ndarray, at: np.ndarray, common: np.ndarray, salt: np.ndarray | None, parts: np.ndarray, chain: bool):
    """An Arrow batch with the signatures of some sets, dealt to ``parts``, and the rows of :func:`_meet` that are plain from these sets alone.  salt: only sets of one salt share signatures."""
    import pyarrow as pa

    one, two = np.uint64(1), np.uint64(2)
    sig, who, odd = levels.signatures(hashes, at, common)
    if salt is not None:
        sig = mix64(sig ^ mix64(salt)[who])
    odd = np.sort(cls[odd])
    sig, own, head = _chained(sig, cls[who])
    size = np.diff(np.append(head, sig.size))
    many = np.repeat(size > FEW, size)
    inside = many.copy()
    inside[head] = False
    if chain:
        later = np.flatnonzero(inside)
        links = np.stack([own[later - 1], own[later], np.ones(later.size, dtype=np.uint64)], axis=1)
    else:
        links = np.stack([own[many], own[many], np.zeros(int(many.sum()), dtype=np.uint64)], axis=1)
    # of many that share a signature here one goes on, with its low bit off; the next bit is on if a class is odd
    own = np.where(many, own & ~one, own)
    own = np.where(np.isin(own | one, odd), own | two, own)
    sig, own = sig[~inside], own[~inside]
    part = (sig % np.uint64(parts.size)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    sig, own, part = sig[order], own[order], part[order]
    ends = np.searchsorted(part, np.arange(parts.size + 1))
    where = np.flatnonzero(np.diff(ends))
    # the part is known, so half of the signature is enough; a chance match only asks for one comparison more
    short = (sig >> np.uint64(32)).astype(np.uint32)
    blobs = [short[ends[p] : ends[p + 1]].tobytes() + own[ends[p] : ends[p + 1]].tobytes() for p in where]
    numbers, kinds = parts[where].tolist(), [0] * where.size
    if links.size:
        numbers.append(int(parts[int(links[0, 0] % np.uint64(parts.size))]))
        kinds.append(1)
        a, b, n, strong = _counted([links])
        blobs.append(np.stack([a, b, strong, n.astype(np.uint64)], axis=1).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(kinds, pa.int64()), pa.array(blobs, pa.binary())], ["part", "kind", "data"])


def _meet(chain: bool):
    """Rows (a, b, n, strong) for sets that share signatures, part by part.

    A signature of FEW sets gives each pair of them.  One of more sets chains them by strong links if ``chain``,
    and else gives a row (a, a) for each; so does one of a set that has too many empty buckets, strong then.
    """

    def run(batches):
        import pyarrow as pa

        one, two = np.uint64(1), np.uint64(2)
        for held in by_part(batches):
            links = [np.frombuffer(raw, dtype=np.uint64).reshape(-1, 4) for kind, raw in held if kind]
            x = [(np.frombuffer(raw, np.uint32, len(raw) // 12), np.frombuffer(raw[len(raw) // 3 :], np.uint64)) for kind, raw in held if not kind]
            if x:
                sig, own = np.concatenate([y[0] for y in x]), np.concatenate([y[1] for y in x])
                # what one entry of a class says holds for all; a chance equal only makes one more link strong
                names = lambda x, c: x.astype(np.uint64) << np.uint64(32) ^ c >> np.uint64(32)
                off, odd = np.unique(names(sig, own)[own & one == 0]), np.unique(own[own & two != 0] & ~two | one)
                sig, own, head = _chained(sig, own & ~two | one)
                met, odd = np.isin(names(sig, own), off), np.isin(own, odd)
                count = np.diff(np.append(head, sig.size))
                few = np.repeat((count <= FEW) & (np.add.reduceat(met, head) == 0), count) if head.size else met
                group = np.repeat(np.arange(head.size), count)
                for d in range(1, FEW):  # each pair of a few
                    k = np.flatnonzero(few[d:] & (group[d:] == group[:-d]))
                    links.append(np.stack([own[k], own[k + d], (odd[k] & odd[k + d]).astype(np.uint64)], axis=1))
                if chain:
                    k = np.flatnonzero(~few[1:] & (group[1:] == group[:-1]))
                    links.append(np.stack([own[k], own[k + 1], np.ones(k.size, dtype=np.uint64)], axis=1))
                else:
                    k = np.flatnonzero(~few | odd)
                    links.append(np.stack([own[k], own[k], odd[k].astype(np.uint64)], axis=1))
            if links and sum(map(len, links)):
                a, b, n, strong = _counted(links)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.ascontiguousarray(a))), pa.array(_signed(np.ascontiguousarray(b))), pa.array(n), pa.array(strong.astype(bool))], ["a", "b", "n", "strong"])

    return run


def _pairs(dealt: DataFrame, chain: bool) -> DataFrame:
    met = dealt.repartition(shuffle_partitions(dealt.sparkSession), "part").sortWithinPartitions("part").mapInArrow(releasing(_meet(chain)), "a long, b long, n long, strong boolean")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", "strong").groupBy("a", "b").agg(F.sum("n").alias("shared"), F.max("strong").alias("strong"))


def candidates(docs: DataFrame, width: int, percent: int, common) -> DataFrame:
    """Classes (a, b) that share signatures: for a < b with ``n``, how many that FEW classes at most hold; for a = b how many that more hold."""
    parts = even_parts(docs.sparkSession)

    def deal(batches):
        levels = Levels(percent)
        for batch in batches:
            for _, hashes, at in _sets(batch, width):
                cls = set_keys(hashes, at)
                _, first = np.unique(cls, return_index=True)  # one row of each class
                rows = np.sort(first)
                n = np.diff(at)[rows]
                at2 = np.concatenate([[0], np.cumsum(n)])
                hashes = hashes[np.arange(at2[-1]) + np.repeat(at[:-1][rows] - at2[:-1], n)]
                yield _shared(levels, cls[rows], hashes, at2, common.value, None, parts, False)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _pairs(text.mapInArrow(releasing(deal), "part long, kind long, data binary"), False)


def again(sets: DataFrame, percent: int, common, round_: int, chain: bool) -> DataFrame:
    """Like :func:`candidates` for the sets (cls, g1, items), within each g1 and by other signatures: what met by chance hardly does so twice.

    chain: signatures of many classes give strong links (a, b) that chain these instead.
    """
    parts = even_parts(sets.sparkSession)

    def deal(batches):
        levels = Levels(percent, round_)
        for batch in batches:
            for some in row_slices(batch, 2, 1 << 21):
                items = [np.frombuffer(raw, np.uint64) for raw in some.column(2).to_pylist()]
                at = np.concatenate([[0], np.cumsum([x.size for x in items])]).astype(np.int64)
                cls, g1 = (some.column(k).to_numpy().view(np.uint64) for k in (0, 1))
                yield _shared(levels, cls, np.concatenate(items), at, common.value, g1, parts, chain)

    return _pairs(sets.select("cls", "g1", "items").mapInArrow(deal, "part long, kind long, data binary"), chain)


def _level_value(levels: Levels, n: Column, values) -> Column:
    """The entry of ``values`` for the level that the size ``n`` belongs to."""
    level = F.size(F.filter(F.array(*[F.lit(int(x)) for x in levels.start[:-1]]), lambda x: x <= n))
    return F.element_at(F.array(*[F.lit(int(x)) for x in values]), level)


def _least(levels: Levels) -> Column:
    """How many signatures a similar pair of n_a and n_b elements shares at least.

    Of the k buckets of the larger set's level at most D differ, and at most s are empty in both: k - s - D.
    (A set with more empty buckets has more signatures, in further families, where the same holds.)
    """
    p = levels.percent
    return _level_value(levels, F.greatest("n_a", "n_b"), levels.buckets - levels.slack) - F.floor((F.col("n_a") + F.col("n_b")) * (100 - p) / (100 + p))


def _sized(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Pairs with what ``named`` has of either class, without those that differ too much in size."""
    sides = [named.select(*[F.col(c).alias(x if c == "cls" else f"{c}_{x}") for c in named.columns]) for x in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.filter(F.col("strong") | (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))


def _counting(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Without pairs that share too few signatures to be similar, or differ too much in size."""
    return _sized(pairs, named.select("cls", "n"), percent).filter(F.col("strong") | (F.col("shared") >= _least(Levels(percent)))).select("a", "b", "shared", "strong")


def _heavy(met: DataFrame, named: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(cls) of the sets that might have a partner with which they share frequent signatures only, and the other pairs (a, b).

    Similar sets share a number of signatures.  A set with fewer frequent ones than that shares rare ones too with
    any partner, and these give every pair.
    """
    levels = Levels(percent)
    own = met.filter("a = b").select(F.col("a").alias("cls"), F.col("shared").alias("often"), F.col("strong").alias("odd"))
    known = named.select("cls", "n").join(own, "cls", "left").select("cls", "n", F.coalesce("often", F.lit(0)).alias("often"), F.coalesce("odd", F.lit(False)).alias("odd"))
    needed = F.greatest(F.lit(1), _level_value(levels, F.col("n"), levels.buckets - levels.slack - levels.most))
    known = stored(known.withColumn("heavy", F.col("odd") | (F.col("often") >= needed)), "ngram-known")
    pairs = _sized(met.filter("a < b"), known, percent).filter(~(F.col("heavy_a") & F.col("heavy_b")))
    pairs = pairs.filter(F.col("shared") + F.least("often_a", "often_b") >= _least(levels))
    return known.filter("heavy").select("cls"), pairs.select("a", "b")


def linked(sets: list[np.ndarray], percent: int, probes: np.ndarray | None = None) -> np.ndarray:
    """The number of a set of the same cluster for each set: the roots under all links between them (with ``probes``: all that touch a probe)."""
    m = len(sets)
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    size = np.array([s.size for s in sets], dtype=np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # what one set alone holds is in no overlap, so the tree and its table leave it out
    several = np.flatnonzero(counts > 1)
    rank = np.full(values.size, -1, dtype=np.int64)
    rank[several[np.lexsort((values[several], -counts[several]))]] = np.arange(several.size)
    ends = np.cumsum(size)
    ordered = []
    for e, n in zip(ends.tolist(), size.tolist(), strict=True):
        r = np.sort(rank[inverse[e - n : e]])
        ordered.append(r[np.searchsorted(r, 0) :])
    has = np.zeros((several.size, -(-m // 8)), dtype=np.uint8)
    for k, r in enumerate(ordered):
        has[r, k >> 3] |= np.uint8(128 >> (k & 7))
    by = sorted(range(m), key=lambda k: ordered[k].astype(">u4").tobytes())
    shared = [0]
    for x, y in zip(by, by[1:], strict=False):
        a, b = ordered[x], ordered[y]
        n = min(a.size, b.size)
        differ = np.flatnonzero(a[:n] != b[:n])
        shared.append(int(differ[0]) if differ.size else n)
    shared.append(0)
    longest = max(r.size for r in ordered)
    need = -(-percent * size // 100)  # a partner's overlap at least
    may_miss = size * (100 - percent) // percent

    def held(tokens):
        """How many of the tokens each set holds."""
        total = np.zeros(m, dtype=np.int64)
        for a in range(0, tokens.size, 255):  # so many at a time, as one byte counts
            total += np.unpackbits(has[tokens[a : a + 255]], axis=1, count=m).sum(axis=0, dtype=np.uint8)
        return total

    def step(at, tokens):
        """The node further down: overlap of every walker that can still reach the threshold there."""
        depth, walkers, overlap = at
        depth += tokens.size
        overlap = overlap + held(tokens)[walkers]
        keep = (depth - overlap <= may_miss[walkers]) & (overlap + longest - depth >= need[walkers])
        return depth, walkers[keep], overlap[keep]

    start = np.arange(m) if probes is None else np.flatnonzero(probes)
    stack = [(0, start, np.zeros(start.size, dtype=np.int64))]
    for k, x in enumerate(by):
        path = ordered[x]
        while stack[-1][0] > shared[k]:
            stack.pop()
        for depth in (shared[k], shared[k + 1]):
            if depth > stack[-1][0]:
                stack.append(step(stack[-1], path[stack[-1][0] : depth]))
        _, walkers, overlap = step(stack[-1], path[stack[-1][0] :])
        good = walkers[100 * overlap >= percent * (size[walkers] + size[x] - overlap)]
        for y in good.tolist():
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(k) for k in range(m)], dtype=np.int64)


def _walk(percent: int):
    """Groups (ordered by g1, g2) of cls, probe, set -> links (a, b)."""

    def group(cls, probe, sets):
        import pyarrow as pa

        _, first = np.unique(np.array([(c, not p) for c, p in zip(cls, probe, strict=True)], dtype=np.int64)[:, 0], return_index=True)
        ask = {c for c, p in zip(cls, probe, strict=True) if p}
        rows = first.tolist()
        if len(rows) < 2:
            return None
        names = np.array([cls[k] for k in rows], dtype=np.int64)
        flags = np.array([c in ask for c in names.tolist()])
        roots = linked([sets[k] for k in rows], percent, None if flags.all() else flags)
        away = roots != np.arange(roots.size)
        return pa.RecordBatch.from_arrays([pa.array(names[away]), pa.array(names[roots[away]])], ["a", "b"]) if away.any() else None

    def run(batches):
        at, cls, probe, sets = None, [], [], []
        for batch in batches:
            for a, b, c, p, raw in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
                if (a, b) != at:
                    if len(cls) > 1 and (out := group(cls, probe, sets)):
                        yield out
                    at, cls, probe, sets = (a, b), [], [], []
                cls.append(c)
                probe.append(p)
                sets.append(np.frombuffer(raw, np.uint64))
        if len(cls) > 1 and (out := group(cls, probe, sets)):
            yield out

    return run


def _grouped(rows: DataFrame, percent: int) -> DataFrame:
    n = shuffle_partitions(rows.sparkSession)
    rows = rows.select("g1", "g2", "cls", "probe", "items").repartition(n, "g1", "g2").sortWithinPartitions("g1", "g2")
    return rows.mapInArrow(releasing(_walk(percent)), "a long, b long")


def _sets_of(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """chosen: cls, doc_id of a document with it, groups (an array of g1, c, blocks).  Their sets as cls, g1, c, blocks, items."""
    spark = docs.sparkSession

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for some, hashes, at in _sets(batch, width):
                same = _signed(set_keys(hashes, at)) == some.column(2).to_numpy()  # a doc_id may stand on several texts
                items = pa.array([raw.tobytes() for raw in np.split(hashes, at[1:-1])], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(2), some.column(3), items], ["cls", "groups", "items"]).filter(pa.array(same))

    # few documents have a partner: the others are left out before the shuffle, which both sides make at any size
    listed = chosen.select(F.col("cls").alias("m_cls"), F.col("doc_id").alias("m_id"), "groups").withColumn("t", F.xxhash64("m_id"))
    bits = spark.sparkContext.broadcast(key_filter(listed.select("t")))
    text = only_in(docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("t"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), bits)
    sets = text.hint("merge").join(listed, (text["t"] == listed["t"]) & text["doc_id"].eqNullSafe(listed["m_id"])).select("doc_id", "text", F.col("m_cls").alias("cls"), "groups")
    sets = sets.mapInArrow(read, "cls long, groups array<struct<g1: long, c: long, blocks: long>>, items binary")
    return sets.withColumn("group", F.explode("groups")).select("cls", "group.g1", "group.c", "group.blocks", "items")


def _as_groups(pairs: DataFrame) -> DataFrame:
    """(g1, cls): each pair (a, b) as a group of its own."""
    return pairs.select(F.xxhash64("a", "b").alias("g1"), F.explode(F.array("a", "b")).alias("cls"))


def _sizes(groups: DataFrame, named: DataFrame) -> DataFrame:
    """g1, its number of sets, and the blocks that these make."""
    sizes = named.join(groups, "cls").groupBy("g1").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("c") / MEMBERS), F.ceil(F.sqrt(F.col("c") * F.col("s") / CELLS))).cast("long")
    return sizes.select("g1", "c", blocks.alias("blocks"))


def _grouping(docs: DataFrame, named: DataFrame, heavy: DataFrame, pairs: DataFrame, width: int, percent: int, common) -> tuple[DataFrame, DataFrame]:
    """(cls, g1) and (g1, cls): groups of the heavy sets, and pairs, that hold all links.

    Chains through the signatures that many share make groups.  Groups of very many blocks are dealt anew, first for
    their own heavy sets, then for the chains among these, until that splits few.
    """
    spark, before, groups, pairs, rest = docs.sparkSession, None, None, _as_groups(pairs), None
    empty = F.array(F.struct(F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("blocks")))
    read = lambda classes: _sets_of(docs, named.join(classes.select("cls"), "cls").select("cls", "doc_id", empty.alias("groups")), width).select("cls", "items")
    # stored, so that reading and dealing them are two stages: a task holds one Python worker at a time
    sets, members = stored(read(heavy), "ngram-sets").withColumn("g1", F.lit(0).cast("long")), None
    for round_ in range(ROUNDS):
        if round_:
            large = _sizes(groups, named).filter(F.col("blocks") > LARGE).select("g1")
            members = stored(groups.join(large, "g1").select("cls", "g1"), "ngram-large")
            n = members.count()
            if not n or before is not None and n > STILL * before:
                break
            before, rest = n, groups.join(large, "g1", "left_anti").select("cls", "g1")
            sets = stored(read(members).join(members, "cls").select("cls", "g1", "items"), "ngram-sets")
            met = stored(again(sets, percent, common, 2 * round_, False), "ngram-met")
            still, more = _heavy(met, named.join(members.select("cls"), "cls", "left_semi"), percent)
            sets = sets.join(still, "cls", "left_semi")
            pairs = pairs.unionByName(_as_groups(more))
        met = stored(again(sets, percent, common, 2 * round_ + 1, True), "ngram-met")
        met, raw = stored(_counting(met, named, percent), "ngram-counted"), met
        discard(raw)
        strong = F.col("strong") | (F.col("shared") >= MANY)
        split = components(met.filter(strong).select("a", "b")).select(F.col("node").alias("cls"), F.col("root").alias("g1"))
        groups = split if rest is None else stored(rest.unionByName(split), "ngram-grouped")
        # what shares few signatures is compared as a pair
        pairs = pairs.unionByName(_as_groups(met.filter(~strong)))
        tidy(spark)
    return groups, pairs


def similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(keys, roots): doc_id, n, cls of each document, and (cls, root) for the classes that link with others."""
    spark = docs.sparkSession
    arrow_batches(spark)
    keyed = stored(keys(docs, width), "ngram-keys")
    common = spark.sparkContext.broadcast(common_ngrams(docs, width))
    tidy(spark)
    none = spark.createDataFrame([], "cls long, root long")
    met = stored(candidates(docs, width, percent, common), "ngram-candidates")
    tidy(spark)
    if met.isEmpty():
        return keyed, none
    named = stored(keyed.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "ngram-classes")
    heavy, pairs = _heavy(met, named, percent)
    groups, pairs = _grouping(docs, named, heavy, pairs, width, percent, common)
    every = groups.join(_sizes(groups, named), "g1").select("cls", "g1", "c", "blocks")
    every = every.unionByName(pairs.select("cls", "g1", F.lit(2).cast("long").alias("c"), F.lit(1).cast("long").alias("blocks")))
    members = stored(named.join(every, "cls").select("cls", "doc_id", "n", "g1", "c", "blocks"), "ngram-groups")
    discard(met)
    tidy(spark)
    # not stored: only large groups read them again
    sets = _sets_of(docs, members.groupBy("cls").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("g1", "c", "blocks")).alias("groups")), width)
    own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("cls", F.lit(1)), F.col("c")) < PIVOTS)
    places = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))
    links = stored(_grouped(sets.withColumn("g2", F.explode(places)).withColumn("probe", F.lit(True)), percent), "ngram-links")
    tidy(spark)
    large = members.filter("blocks > 1").select("cls", "g1", "n")
    if not large.isEmpty():
        links = stored(links.unionByName(_leftovers(large, sets.filter("blocks > 1").select("cls", "items"), links, percent)), "ngram-links")
        tidy(spark)
    if links.isEmpty():
        return keyed, none
    return keyed, stored(components(links).select(F.col("node").alias("cls"), "root"), "ngram-components")


def _leftovers(large: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links of the sets outside the largest cluster of a large group with all its other sets, block against block.

    large: cls, g1, n; sets: cls, items.  Only blocks of sizes that may be similar meet.
    """
    spark = large.sparkSession
    bucket = F.floor(F.log(F.col("n")) / F.log(F.lit(101.0 / percent))).cast("long")
    rooted = large.dropDuplicates(["cls"]).withColumn("size", bucket)
    if links.isEmpty():
        rooted = rooted.withColumn("root", F.col("cls"))
    else:
        rooted = rooted.join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = stored(rooted, "ngram-rooted")
    main = rooted.groupBy("g1", "root").count().groupBy("g1").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
    rows = stored(rooted.join(main.filter("all > most").select("g1", "main"), "g1").select("g1", "cls", "n", "size", (F.col("root") != F.col("main")).alias("probe")), "ngram-open")
    if rows.isEmpty():
        return links.limit(0)
    asks = F.col("probe").cast("long")

    def blocks(number, elements):
        """Blocks of about MEMBERS at most, two of which have at most CELLS cells."""
        return F.ceil(F.greatest(number / MEMBERS, F.sqrt(4.0 * number * elements / CELLS))).cast("long")

    counts = rows.groupBy("g1", "size").agg(blocks(F.sum(asks), F.sum(asks * F.col("n"))).alias("r"), blocks(F.count("*"), F.sum("n")).alias("b"))
    own, other = counts.select("g1", "size", "r", "b"), counts.select("g1", F.col("size").alias("other"), F.col("r").alias("o_r"), F.col("b").alias("o_b"))
    near = rows.join(own, ["g1", "size"]).withColumn("other", F.explode(F.array(*[F.col("size") + k for k in (-1, 0, 1)]))).join(other, ["g1", "other"])
    mine = F.pmod(F.xxhash64("cls", F.lit(2)), F.greatest("r", F.lit(1)))
    ask = near.filter("probe").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_b") - 1))).select("g1", "cls", F.lit(True).alias("probe"), F.xxhash64("size", "other", mine, "k").alias("g2"))
    place = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("b"))
    index = near.filter("o_r > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_r") - 1))).select("g1", "cls", F.lit(False).alias("probe"), F.xxhash64("other", "size", "k", place).alias("g2"))
    # in rounds, so that the copies of one round only are on disk at a time
    sets = stored(sets, "ngram-large")
    placed = stored(ask.unionByName(index), "ngram-placed")
    parts, rounds = [], min(COMPARED, 1 + placed.count() // COPIES)
    for k in range(rounds):
        parts.append(stored(_grouped(placed.filter(F.pmod("g2", F.lit(rounds)) == k).join(sets, "cls"), percent), "ngram-links"))
        tidy(spark)
    discard(sets)
    return reduce(DataFrame.unionByName, parts)


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    keyed, roots = similar(docs, width, percent)
    # by classes, of which copies are one; only the last join meets all copies, and Spark splits it where a class is hot
    classes = keyed.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members"))
    rooted = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"), F.sum("members").alias("members")).filter("members > 1")
    found = stored(rooted.select("cls", "root").join(least, "root").select("cls", "least"), "ngram-least")
    out = keyed.join(found, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of similar ones, that of the smallest doc_id; all columns stay.  Documents without words stay; repeated rows are one.

    Only what may go, or stands there twice, is shuffled; the other rows stay where they are.
    """
    spark = docs.sparkSession
    keyed, roots = similar(docs, width, percent)
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th").alias("m")
    classes = keyed.filter("n > 0").groupBy("cls").agg(F.min(first).alias("m"), F.count("*").alias("members"))
    rooted = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("m").alias("best"), F.sum("members").alias("members")).filter("members > 1")
    grouped = stored(rooted.select("cls", "root").join(least, "root").select("cls", "best"), "ngram-least")
    held = keyed.select("doc_id", "th", "n", "cls").join(grouped, "cls", "left").filter("best IS NOT NULL OR n = 0")
    stays = F.col("best").isNull() | (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.th") == F.coalesce("th", F.lit(0))))
    held = held.groupBy("doc_id", F.coalesce("th", F.lit(0)).alias("th")).agg(F.max(stays).alias("stays"), F.count("*").alias("rows")).filter("NOT stays OR rows > 1")
    chosen = stored(held.select(F.xxhash64("doc_id", "th").alias("t"), F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), "stays"), "ngram-chosen")
    bits = spark.sparkContext.broadcast(key_filter(chosen.select("t")))
    doc_id, th = F.col("doc_id").cast("long"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0))
    rows = docs.select(F.xxhash64(doc_id, th).alias("t"), F.struct(*docs.columns).alias("row"))
    clear = without(rows, bits).select("row.*")
    odd = only_in(rows, bits).withColumn("k_id", F.col("row.doc_id").cast("long")).withColumn("k_th", F.coalesce(F.xxhash64(F.col("row.text").cast("string")), F.lit(0)))
    odd = odd.withColumn("t", F.xxhash64("k_id", "k_th"))
    same = (odd["t"] == chosen["t"]) & odd["k_id"].eqNullSafe(chosen["k_id"]) & (odd["k_th"] == chosen["k_th"])
    odd = odd.join(chosen, same, "left").select("row", odd["k_id"], odd["k_th"], "stays")
    once = odd.filter("stays").dropDuplicates(["k_id", "k_th"]).select("row.*")
    return clear.unionByName(odd.filter("stays IS NULL").select("row.*")).unionByName(once)


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLE_SQL: dict[str, str] = {}
