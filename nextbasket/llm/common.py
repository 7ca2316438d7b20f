"""Table access, shared scratch folder and the vectorised text kernels used by several operators."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a vectorised kernel handles at a time; longer texts are handled alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names in spark.checkpoint.dir; where it is unset, a local session makes a temporary one, and on a cluster this fails."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base}/llm-{uuid.uuid4().hex}"


#: The folders that saved() has written inside the innermost tracked(); other threads and runs have lists of their own.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


@contextlib.contextmanager
def tracked() -> Iterator[list[str]]:
    """The folders that saved() writes inside, in order."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield paths
    finally:
        _written.reset(token)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Takes written tables away, once nothing that is still to run reads them."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def saved(df: DataFrame, **options: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    if (paths := _written.get()) is not None:
        paths.append(path)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bitset(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of a fixed number of bits (a power of two, 32,768 at least) of the column's values modulo it: other values may seem to be in df."""
    bits = max(bits, 32768)
    place = F.pmod(column, F.lit(bits)) + 1
    blocks = df.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for block, part in blocks:
        out[(block - 1) * 4096 : (block - 1) * 4096 + len(part)] = np.frombuffer(part, np.uint8)
    return out


def in_bitset(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values & (8 * len(held) - 1)
    return (held[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def frequent(counted: DataFrame, n: str, most: int) -> DataFrame:
    """The rows whose count n is in the highest eighths of a power of two that hold at most `most` rows together. Nothing is sorted; a few hundred sums are collected."""
    eighth = F.floor(F.log2(n) * 8).cast("int")
    least, total = None, 0
    for level, rows in sorted(counted.groupBy(eighth.alias("level")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        total += rows
        if total > most:
            break
        least = level
    return counted.where(eighth >= least) if least is not None else counted.where(F.lit(False))


def ascii_lower(c) -> F.Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about limit bytes: (first row, end row, bytes, offsets of each text in them). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A 64-bit value for each byte, the same for A-Z and a-z.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
BASE = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, 2 * SLICE_BYTES), b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def spans_of(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of bytes that separator does not mark in the texts data[at[i]:at[i+1]]: their starts and ends, and where each text's begin among them."""
    n = len(data)
    word = ~separator[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = at[(at > 0) & (at < n)]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


class Spans:
    """The words (runs of bytes that separator does not mark) of the texts data[at[i]:at[i+1]]; begin tells where each text's begin in start and end."""

    def __init__(self, data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE):
        n = len(data)
        self.start, self.end, self.begin = spans_of(data, at, separator)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * up, out=self.sums[1:])

    def hashes(self, most: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first bytes, A-Z lower-cased."""
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        return mixed((self.sums[end] - self.sums[self.start]) * self.down[self.start] + (end - self.start).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, divided by ASCII white space, of the texts, and where each text's begin."""
    spans = Spans(data, at)
    return spans.hashes(), spans.begin


def shingles(h: np.ndarray, begin: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; the whole sequence as one where it has fewer words, none without words."""
    m, out = np.uint64(0x9E3779B97F4A7C15), []
    if len(h) >= width:
        a = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            a *= m
            a += h[k : len(h) - width + 1 + k]
        a = mixed(a)
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if hi - lo >= width:
            s = np.sort(a[lo : hi - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif hi > lo:
            x = hi - lo
            for w in h[lo:hi].tolist():
                x = (x * int(m) + w) % (1 << 64)
            out.append(mixed(np.array([x], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
