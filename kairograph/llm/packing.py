"""Hierarchical multi-length packing of token sequences.

Each document is routed to a tier by its length: whole windows leave at once, the rest goes to the
smallest tier that holds it.  The tiers are packed from the longest down; the gap that a piece leaves in
its window is filled from the shorter tiers, first with whole pieces (the longest that fit), then with
the front of one piece that is cut.  Windows of the shorter tiers are therefore full at a power of two,
and so is the tail, which is cut into powers of two: nothing is padded.  Sequences are dealt to step
groups with the same number of tokens.

Packing needs no order between documents, so each batch of a task is a pool of its own and nothing is
shuffled; a task that is run again on the same split gives the same sequences.

Defined results: a null text counts as empty (its end id alone is packed); repeated rows are packed as
often as they stand there; a null doc_id stays null; other columns are ignored; an empty table gives no
rows; a very long text is cut into as many windows as it needs.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import releasing, table
from .tokens import encoder, tokenizer_path

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Windows of tokens in a step group.
STEP_WINDOWS = 16

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long, tier long, step_group long"


def pack_lengths(lengths: list[int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset) and the length of each sequence."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequences: list[int] = []
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(window)]  # by length: (document, start)
    there = 0  # bit n: a piece of length n waits

    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= window:
            pieces.append((doc, start, window, len(sequences), 0))
            sequences.append(window)
            start += window
        if n > start:
            waiting[n - start].append((doc, start))
            there |= 1 << (n - start)

    def take(n: int) -> tuple[int, int]:
        nonlocal there
        got = waiting[n].pop()
        if not waiting[n]:
            there &= ~(1 << n)
        return got

    def fill(size: int, first: int) -> None:
        """One sequence of ``size`` that begins with a piece of length ``first``; what waits is enough for it."""
        nonlocal there
        at, n = 0, first
        while True:
            doc, start = take(n)
            part = min(n, size - at)
            pieces.append((doc, start, part, len(sequences), at))
            at += part
            if part < n:
                waiting[n - part].append((doc, start + part))
                there |= 1 << (n - part)
            if at == size:
                break
            fits = (there & ((1 << (size - at + 1)) - 1)).bit_length() - 1
            n = fits if fits > 0 else (there & -there).bit_length() - 1
        sequences.append(size)

    left = sum(n * len(w) for n, w in enumerate(waiting))
    for k in range(len(tiers) - 1, -1, -1):
        low = tiers[k - 1] if k else 0
        while left >= tiers[k] and (longest := there.bit_length() - 1) > low:
            fill(tiers[k], longest)
            left -= tiers[k]
    while left:  # the tail
        size = 1 << (min(left, window).bit_length() - 1)
        fill(size, there.bit_length() - 1)
        left -= size
    return pieces, sequences


def step_groups(sequences: np.ndarray, tokens: int) -> np.ndarray:
    """Deal sequences (powers of two up to the window) to groups of ``tokens`` each; the last may be short."""
    order = np.argsort(-sequences, kind="stable")
    before = np.cumsum(sequences[order]) - sequences[order]
    out = np.empty(sequences.size, dtype=np.int64)
    out[order] = before // tokens
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most ``window``; with ``keep_ids`` their ids too.

    window and tiers are powers of two, the last tier is the window.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq_base, group_base = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, offsets = encoder(tokenizer).encode(batch.column(1).to_pylist())
            n = np.diff(offsets) + 1
            ends = np.cumsum(n)
            full = np.full(int(ends[-1]), end_id, dtype="<u4")
            keep = np.ones(full.size, dtype=bool)
            keep[ends - 1] = False
            full[keep] = ids
            pieces, sequences = pack_lengths(n.tolist(), window, tiers)
            p, s = np.array(pieces, dtype=np.int64), np.array(sequences, dtype=np.int64)
            groups = step_groups(s, STEP_WINDOWS * window)
            at = (ends - n)[p[:, 0]] + p[:, 1]
            view = memoryview(full).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + p[:, 2]).tolist(), strict=True)]
            tier = np.asarray(tiers)[np.searchsorted(tiers, s[p[:, 3]])]
            columns = [batch.column(0).take(pa.array(p[:, 0])), p[:, 1], p[:, 2], crc, n[p[:, 0]], part + seq_base + p[:, 3], p[:, 4], s[p[:, 3]], tier, part + group_base + groups[p[:, 3]]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded", "tier", "step_group"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(p[:, 2])]).astype(np.int32), pa.array(np.concatenate([full[a : a + k] for a, k in zip(at, p[:, 2], strict=True)]).astype(np.int64))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)
            seq_base += s.size
            group_base += int(groups.max()) + 1

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(releasing(run), SCHEMA + (", ids array<long>" if keep_ids else ""))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op4_packing": op4_packing}
ORACLE_SQL: dict[str, str] = {}
