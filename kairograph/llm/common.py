"""What the operators of this subpackage share: tables, shared storage and byte-level text helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where it is unset and all run on one machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="kairograph-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def arrow_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Keep the batches between Spark and Python at ``limit`` bytes for the session, so that their copies on both sides stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def releasing(run, every: int = 16):
    """A function for mapInArrow whose worker gives the memory it has freed back to the system after some batches and at the end of a task."""

    def wrapped(batches):
        import ctypes

        trim = getattr(ctypes.CDLL(None), "malloc_trim", None) or (lambda _: None)  # of glibc
        try:
            for k, out in enumerate(run(batches), 1):
                yield out
                if not k % every:
                    trim(0)
        finally:
            trim(0)

    return wrapped


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so for what the driver's collectors have freed."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors.

    The files go to a fresh sub-folder, so a second call never mixes with a first one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from :func:`stored` once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_parts(spark: SparkSession, each: int = 4) -> np.ndarray:
    """Numbers that ``repartition(shuffle_partitions(spark), number)`` deals out evenly: ``each`` to every partition."""
    n = shuffle_partitions(spark)
    numbers = np.arange(1 << 12, dtype=np.int64)
    while True:
        rows = spark.range(int(numbers.size)).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).toPandas()  # a few for each partition
        order = rows.sort_values(["p", "id"]).reset_index(drop=True)
        first = order[order.groupby("p").cumcount() < each]
        if len(first) == n * each:
            return first["id"].to_numpy(dtype=np.int64)
        numbers = np.arange(2 * numbers.size, dtype=np.int64)


def by_part(batches):
    """(kind, data) lists of one part after the other; the batches are ordered by part."""
    at, held = None, []
    for batch in batches:
        for part, kind, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != at:
                if held:
                    yield held
                at, held = part, []
            held.append((kind, raw))
    if held:
        yield held


#: 64-bit words of the filter that spares rows without a partner a shuffle; its size is fixed, a full one spares none.
FILTER_WORDS = 1 << 18


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit set of fixed size with a bit for each hash t of ``keys``."""
    bit = F.col("t").bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))
    words = keys.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast(t & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(FILTER_WORDS, dtype=np.uint64)
    found = words.toPandas()  # FILTER_WORDS rows at most
    out[found["w"].to_numpy(dtype=np.int64)] = found["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def in_filter(bits: np.ndarray, t: np.ndarray) -> np.ndarray:
    place = t.view(np.uint64) & np.uint64(FILTER_WORDS * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def only_in(rows: DataFrame, bits) -> DataFrame:
    """The rows whose first column, a hash, may be in the broadcast filter; they are dropped before any shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(in_filter(bits.value, batch.column(0).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def without(rows: DataFrame, bits) -> DataFrame:
    """The rows that :func:`only_in` leaves out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(~in_filter(bits.value, batch.column(0).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


#: 2**64 divided by the golden ratio, and the two multipliers of the splitmix64 finaliser (fixed values).
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64, in a copy."""
    x = x + np.uint64(GOLDEN)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    return x


_BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base (or of its inverse) modulo 2**64; grown by doubling and kept."""
    base = _BASE_INV if inverse else _BASE
    have = _POWERS.get(base)
    if have is None or have.size < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.full(size, base, dtype=np.uint64)
            have[0] = 1
            have = np.cumprod(have, dtype=np.uint64)
        _POWERS[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of keyed bytes times powers: the input to :func:`span_hash`; one longer than ``data``."""
    out = np.zeros(data.size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_KEYS[data] * powers(data.size), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal spans give equal values wherever they stand."""
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * powers(prefix.size, inverse=True)[start])


def text_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of an Arrow string column, without a copy per row; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    nulls = np.asarray(column.is_null())
    return data, offsets - offsets[0], nulls


def row_chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """(first, last) row ranges of at most ``limit`` bytes each, or of one row if that is longer."""
    first, n = 0, offsets.size - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def row_slices(batch, column: int, limit: int = 1 << 21):
    """An Arrow batch in slices whose values in ``column`` hold about ``limit`` bytes, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for first, last in row_chunks(np.concatenate([[0], np.cumsum(sizes)]), limit):
        yield batch.slice(first, last - first)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def is_space(data: np.ndarray) -> np.ndarray:
    """Whether each byte is a space or one from tab to carriage return."""
    return _SPACE[data]


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes other than space and tab to carriage return; rows are cut at ``offsets``."""
    solid = np.zeros(data.size + 2, dtype=np.int8)
    solid[1:-1] = ~_SPACE[data]
    edge = np.diff(solid)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < data.size)]
    begins, ends = edge > 0, edge < 0
    joined = inner[(solid[inner] == 1) & (solid[inner + 1] == 1)]  # a word may not run on into the next row
    begins[joined] = True
    ends[joined] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row
