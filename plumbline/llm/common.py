"""What the operators share: scratch tables on the shared folder, Arrow batch
limits, and vectorised hashing of words and shingles."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limit_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and bytes, for tables of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception as e:  # a Spark version without this setting keeps to the row limit
        if "CONFIG" not in str(e):
            raise


class Scratch:
    """Written tables under the shared checkpoint folder, dropped together.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, a
    local one is made in local mode, and others raise an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = f"file://{os.path.join(tempfile.gettempdir(), 'plumbline')}"
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark remove the shuffle files of plans that are done; it does so when the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def small_side(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A written table of a few short columns, marked to be broadcast if it has ``most`` rows at most; larger ones are joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- hashing of words -------------------------------------------------------

_R = U64(0x9E3779B97F4A7C15)  # odd
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffers(column: pa.Array):
    """Bytes and offsets of a string column, nulls as empty; no copy of the data."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offs


def spans_of_bytes(offs: np.ndarray, most: int = 1 << 20):
    """Row ranges whose texts hold about ``most`` bytes together, a row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: its 8-byte pieces are mixed one by one with their places, so no two
    texts' hashes are tied by arithmetic alone, and the mixed pieces are added up."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - begin
    out = mix((eight[begin] & _FIRST_BYTES[np.minimum(size, 8)]) + size.astype(U64) * U64(0xD6E8FEB86659FD93))
    longer = np.flatnonzero(size > 8)
    if len(longer):
        more = (size[longer] - 1) >> 3
        first = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        left = np.minimum(np.repeat(size[longer], more) - 8 * place, 8)
        pieces = eight[np.repeat(begin[longer], more) + 8 * place] & _FIRST_BYTES[left]
        out[longer] += np.add.reduceat(mix(pieces ^ mix(place.astype(U64) * _R)), first)
    return mix(out + _R)


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True):
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts, with each word's row."""
    base, end = int(offs[0]), int(offs[-1])
    raw = data[base:end]
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = ~_SEP[raw]
    cut = offs[1:-1] - base
    cut = cut[(cut > 0) & (cut < n)]
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    start[cut] = inside[cut]
    stop[:-1] &= ~inside[1:]
    stop[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return span_hashes(LOWER[raw] if lower else raw, s, e), np.searchsorted(offs - base, s, "right") - 1


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; the caller drops those that cross texts."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = np.full(m, n, U64)
    for k in range(n):
        h = h * _R + words[k : k + m]
    return mix(h)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = 5):
    """Yield (row, sorted distinct shingle hashes); fewer words than ``size`` make one shingle, none make an empty set."""
    for i, j in spans_of_bytes(offs):
        words, rows = word_hashes(data, offs[i : j + 1])
        grams = ngram_hashes(words, size)
        ends = np.searchsorted(rows, np.arange(j - i + 1))
        for r in range(j - i):
            a, b = ends[r], ends[r + 1]
            if b - a >= size:
                got = np.sort(grams[a : b - size + 1])
                keep = np.empty(len(got), bool)
                keep[0] = True
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                yield i + r, got[keep]
            else:
                yield i + r, ngram_hashes(words[a:b], b - a) if b > a else np.zeros(0, U64)


# --- filters of ids -----------------------------------------------------------

#: Bits of a filter of ids: 16 for each of them, between these powers of two.
FILTER_LOG2 = (16, 28)


def _places(ids: np.ndarray, log2: int) -> np.ndarray:
    """Two bits of the filter for each id."""
    h = mix(ids.view(U64) + U64(0x632BE59BD9B4E019))
    return np.stack([h & U64((1 << log2) - 1), h >> U64(64 - log2)]).astype(np.int64)


def _filter_bits(log2: int):
    def run(batches):
        for batch in batches:
            places = _places(batch.column(0).to_numpy(), log2).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array((U64(1) << (places & 63).astype(U64)).view(np.int64))], ["word", "bits"])

    return run


def id_filter(ids: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """Bloom filter of 2**log2 bits over ids, 16 for each as far as FILTER_LOG2 goes; beyond that it is less selective."""
    log2 = min(FILTER_LOG2[1], max(FILTER_LOG2[0], (16 * count).bit_length()))
    rows = ids.mapInArrow(_filter_bits(log2), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << log2 - 6, np.int64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return log2, words


def passes(bloom: tuple[int, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Whether each id may be in the filter; those that are do."""
    log2, words = bloom
    bits = _places(ids, log2)
    return ((words[bits >> 6] >> (bits & 63)) & 1).astype(bool).all(0)
