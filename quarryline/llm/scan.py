"""Vectorised reading of Arrow text columns: words, lines, word hashes and n-gram hashes, without a Python loop over words.

A word is a run of bytes other than the space and the five control characters 9 to 13; bytes and code points agree here,
as UTF-8 never uses those values inside a character.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder

U = np.uint64
BASE = 0x9E3779B97F4A7C15
STEP = 0xD1342543DE82EF95
#: Bytes of text that are taken through numpy at once (a longer text is taken alone).
SLICE_BYTES = 2 << 20
#: Length of the table of powers.
BLOCK = 1 << 16


def cache() -> dict:
    """A dictionary that lives as long as the Python worker (code pickled by value has fresh globals in each task)."""
    return sys.modules.setdefault("_quarryline_cache", types.ModuleType("_quarryline_cache")).__dict__


def lean() -> None:
    """Lets the worker give large arrays back to the system when they are freed (the allocator would keep them for later)."""
    kept = cache()
    if not kept.get("lean"):
        kept["lean"] = True
        pa.set_memory_pool(pa.system_memory_pool())
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # arrays from 1 MB on are mapped on their own
            libc.mallopt(-1, 8 << 20)  # and at most 8 MB stay on top of the heap


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. BLOCK - 1 of the base and of its inverse modulo 2**64, kept for the worker's life."""
    kept = cache()
    if "powers" not in kept:
        kept["powers"] = tuple(runs_of(b, BLOCK) for b in (BASE, pow(BASE, -1, 1 << 64)))
    return kept["powers"]


def runs_of(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[:1] = 1
    return np.multiply.accumulate(p)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0 .. n values, each times the base to the power of its place."""
    out = np.zeros(len(values) + 1, U)
    out[1:] = values
    up, scale = powers()[0], 1
    for at in range(1, len(out), BLOCK):  # powers are those within a block times that of its start
        part = out[at : at + BLOCK]
        part *= up[: len(part)]
        part *= U(scale)
        scale = scale * pow(BASE, BLOCK, 1 << 64) % (1 << 64)
    return np.cumsum(out, out=out)


def moved(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of prefix sums, divided by the base to the power of where they start."""
    down = powers()[1]
    far = runs_of(pow(BASE, -BLOCK, 1 << 64), int(starts.max(initial=0)) // BLOCK + 1)
    return values * down[starts % BLOCK] * far[starts // BLOCK]


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i]+counts[i]-1, one range after the other."""
    return np.repeat(starts, counts) + spread(counts)


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many true values lie between consecutive offsets."""
    at = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return at[offsets[1:]] - at[offsets[:-1]]


class Texts:
    """Some texts as one byte array. Rows are consecutive; nulls count as empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.offsets = offsets
        self.n = len(offsets) - 1
        self._words = None
        self._sums = None
        self._down = None

    @staticmethod
    def of(values: list[bytes]) -> Texts:
        return Texts(np.frombuffer(b"".join(values), np.uint8), np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64))))

    def lowered(self) -> Texts:
        """A-Z replaced by a-z."""
        d = self.data
        return Texts(np.where((d >= 65) & (d <= 90), d | 32, d).astype(np.uint8), self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the number of words before each row (one more entry than rows)."""
        if self._words is None:
            table = np.ones(256, bool)
            table[[9, 10, 11, 12, 13, 32]] = False
            ink = table[self.data]
            start, end = ink.copy(), ink.copy()
            start[1:] &= ~ink[:-1]
            end[:-1] &= ~ink[1:]
            edges = self.offsets[1:-1]
            at = edges[(edges > 0) & (edges < len(ink))]
            start[at] = ink[at]
            end[at - 1] = ink[at - 1]
            starts = np.flatnonzero(start)
            self._words = starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.offsets)
        return self._words

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        if self._sums is None:
            self._sums = prefix_sums(self.data.astype(U) + U(1))
            if len(self.data) <= 2 * SLICE_BYTES:  # else only those that are asked for
                far = runs_of(pow(BASE, -BLOCK, 1 << 64), len(self.data) // BLOCK + 1)
                self._down = np.multiply.outer(far, powers()[1][: len(self.data) + 1]).ravel()
        h = self._sums[ends] - self._sums[starts]
        h = moved(h, starts) if self._down is None else h * self._down[starts]
        return mix(h ^ ((ends - starts).astype(U) << U(48)))

    def word_hashes(self) -> np.ndarray:
        starts, ends, _ = self.words()
        return self.hashes(starts, ends)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive values that start at each place (k - 1 fewer places)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U(STEP)
        out += hashes[j : j + n]
    return mix(out)


def starts_within(ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which k words of one row start, and the number of them in each row."""
    counts = np.maximum(np.diff(ptr) - k + 1, 0)
    return ranges(ptr[:-1], counts), counts


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of an Arrow string or binary column (nulls are empty)."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Parts of a batch with at most ``size`` bytes of text each, unless one row alone has more."""
    lean()
    data, offsets = texts_of(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(at, end - at), Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch, Texts], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """``mapInArrow`` of a function on slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, column):
                out = fn(part, texts)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def blobs(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


def documents(df: DataFrame, *more: str) -> DataFrame:
    """The columns that the operators read, in fixed types; what else the table has is left out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir."""
    return shared_folder(spark)


#: Stored bytes of input for each part that a task gathers whole, and the most parts.
PART_BYTES, MOST_PARTS = 64 << 20, 1 << 16


def parts_of(rows: DataFrame) -> int:
    """How many parts work on some rows is dealt out to, so that a part stays of one size however large the input is: the session's
    number of shuffle partitions, or more by what Spark knows of the input's size."""
    known = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = known if known < 1 << 58 else 0  # Spark takes what it doesn't know for endless
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(known // PART_BYTES, MOST_PARTS))


def stored(df: DataFrame, what: str = "part") -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a job writes in the shared folder and removes when it is through, but for those that its result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, what: str = "part") -> DataFrame:
        path = f"{shared_dir(self.spark)}/{what}"
        df.write.parquet(path)
        self.paths[path] = what
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *keep: str) -> None:
        for path in [p for p, what in self.paths.items() if what not in keep]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
            del self.paths[path]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
