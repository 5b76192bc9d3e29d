"""Token ids in files of checksummed, independently reset blocks (see ``rangecoder``).  Ids are unsigned 32-bit numbers.

A dataset is a table in the shared folder with one row per stripe: file number, number in the file,
number of ids, and the stripe's bytes.  Files hold ascending ranges of doc_id, stripes and documents
ascend inside them; each stripe says how many ids of its file precede it, so a global position needs
only the total of each file.

Defined results: a null text counts as empty (its end id alone is stored); a null doc_id comes first;
repeated rows are stored as often as they stand there, equal ids in the order of their texts; other
columns are ignored; an empty table gives no rows.  A document is never split between stripes, so a very
long one makes one long stripe of many blocks.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, releasing, row_slices, shared_dir, shuffle_partitions, table
from .rangecoder import read_stripes, write_stripes
from .tokens import encoder, tokenizer_path

END_ID = 0
#: Ids after which a stripe ends.
STRIPE_IDS = 1 << 22
#: Ids coded side by side (about as many bytes of coded blocks are decoded together).
AT_ONCE = 1 << 23

FILE_SCHEMA = "file long, stripe long, n_ids long, data binary"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encode the documents in ascending doc_id order and write them below ``path``."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, before, number = TaskContext.get().partitionId(), 0, 0
        waiting: list = []  # parts of a stripe: document ids, lengths, ids
        stripes: list = []

        def close() -> None:
            nonlocal before
            if waiting:
                doc_ids, n, ids = [d for w in waiting for d in w[0]], np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting])
                stripes.append((doc_ids, n, ids, before))
                before += ids.size
                waiting.clear()

        def written():
            nonlocal number
            for data, stripe in zip(write_stripes(stripes), stripes, strict=True):
                yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int64()), "stripe": pa.array([number], pa.int64()), "n_ids": pa.array([len(stripe[2])], pa.int64()), "data": pa.array([data], pa.binary())})
                number += 1
            stripes.clear()

        for batch in batches:
            for some in row_slices(batch, 1):
                ids, offsets = encoder(tokenizer).encode(some.column(1).to_pylist())
                n = np.diff(offsets) + 1
                full = np.full(ids.size + n.size, end_id, dtype=np.uint32)
                keep = np.ones(full.size, dtype=bool)
                keep[np.cumsum(n) - 1] = False
                full[keep] = ids
                waiting.append((some.column(0).to_pylist(), n, full))
                if sum(w[2].size for w in waiting) >= STRIPE_IDS:
                    close()
                if sum(len(s[2]) for s in stripes) >= AT_ONCE:
                    yield from written()
        close()
        yield from written()

    arrow_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.length("text"), F.xxhash64("text"))
    ordered.mapInArrow(releasing(run), FILE_SCHEMA).write.parquet(path)


DOCUMENT_SCHEMA = "doc_id long, start_in_file long, file long, n_tokens long, ids_crc32 long"


def read_tokens(spark, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document of the files: where its ids start, how many they are, their checksum and, on request, the ids."""

    def run(batches):
        import pyarrow as pa

        for batch in (b for whole in batches for b in row_slices(whole, 1, AT_ONCE)):
            for file, (doc_ids, n, ids, before) in zip(batch.column(0).to_pylist(), read_stripes(batch.column(1).to_pylist()), strict=True):
                ends = np.cumsum(n)
                view = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = {"doc_id": pa.array(doc_ids, pa.int64()), "start_in_file": pa.array(before + ends - n), "file": pa.array(np.full(n.size, file, dtype=np.int64)), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(columns)

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # as many rows as files, a number that the writer's partitions bound
    totals = sorted((r["file"], r["n"]) for r in files.groupBy("file").agg(F.sum("n_ids").alias("n")).collect())
    starts, at = [], 0
    for file, n in totals:
        starts.append((file, at))
        at += n
    starts = spark.createDataFrame(starts, "file long, file_start long")
    docs = files.select("file", "data").mapInArrow(releasing(run), DOCUMENT_SCHEMA + (", ids array<long>" if keep_ids else ""))
    out = docs.join(F.broadcast(starts), "file").withColumn("start", F.col("start_in_file") + F.col("file_start"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), path)
    return read_tokens(spark, path)


QUERIES = {"op2_token_files": op2_token_files}
ORACLE_SQL: dict[str, str] = {}
