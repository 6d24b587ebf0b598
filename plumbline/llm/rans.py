"""Token ids in files of a static range asymmetric numeral system.

A segment holds whole documents: their ids, a frequency table that its blocks
share, and blocks of 64 Ki ids that decode apart. A block's ids are dealt to
interleaved lanes; its checkpoint in the segment's directory has the lanes'
states, where its words begin, and a checksum of its ids.

Layout, little-endian: magic ``PLR1``, u32 documents, u64 ids, u32 symbols,
u32 blocks, u64 words; documents' ids (i64), their null flags (u8), their
lengths (u64); symbols (u32), frequencies (u32); of each block u32 ids, u32
crc32, u64 first word, LANES u64 states; the words (u32); u32 crc32 of all that.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, limit_batches, partitions
from .tokens import encoder, text_runs, tokenizer_path

MAGIC, HEAD = b"PLR1", struct.Struct("<4sIQIIQ")
LANES, BLOCK, BITS = 128, 65_536, 20
SEGMENT_IDS = 1 << 20
_LOW, _32 = np.uint64(1 << 31), np.uint64(32)
END_ID = 0


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Integers of sum 2**BITS near the counts' shares, each at least 1."""
    total = 1 << BITS
    if len(counts) > total:
        raise ValueError("more symbols than the table has slots")
    f = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    over = int(f.sum()) - total
    order = np.argsort(-f, kind="stable")
    k = 0
    while over > 0:  # from the most frequent, at most half of each at a time
        take = min(over, int(f[order[k]]) // 2)
        f[order[k]] -= take
        over -= take
        k = (k + 1) % len(order)
    f[order[0]] -= min(over, 0)
    return f.astype(np.uint64)


def _encode(symbols: np.ndarray, f: np.ndarray, c: np.ndarray):
    """symbols: (steps, blocks * LANES). States, and the mask and values of the words by step."""
    x = np.full(symbols.shape[1], _LOW, np.uint64)
    mask, words = np.zeros(symbols.shape, bool), np.zeros(symbols.shape, np.uint32)
    fs, cs = f[symbols], c[symbols]
    most = fs << np.uint64(63 - BITS)
    gap = np.uint64(1 << BITS) - fs
    for t in range(len(symbols) - 1, -1, -1):
        np.greater_equal(x, most[t], out=mask[t])
        words[t] = x
        x >>= np.where(mask[t], _32, np.uint64(0))
        x += (x // fs[t]) * gap[t] + cs[t]  # the quotient moves up by BITS
    return x, mask, words


def _decode(x: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, f, c, slots) -> np.ndarray:
    """x: (blocks, LANES) states; at: first word of each block."""
    out = np.empty((steps, *x.shape), slots.dtype)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    low = np.uint64((1 << BITS) - 1)
    for t in range(steps):
        slot = x & low
        s = out[t] = slots[slot]
        x = f[s] * (x >> np.uint64(BITS)) + slot - c[s]
        need = x < _LOW
        seen = np.cumsum(need, axis=1)
        x = np.where(need, (x << _32) | words[np.minimum(at[:, None] + seen - 1, len(words) - 1)], x)
        at = at + seen[:, -1]
    return out


def write_segment(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> bytes:
    ids = ids.astype(np.uint32)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts, inverse = counts[symbols], (np.cumsum(counts > 0) - 1)[ids] if len(ids) else ids
    heads, streams = [], []
    f = c = np.zeros(0, np.uint64)
    if len(ids):
        f = frequencies(counts)
        c = np.cumsum(f) - f
        first = 0
        for at, n, blocks in _runs(len(ids)):
            part = inverse[at : at + n * blocks]
            steps = -(-n // LANES)
            grid = np.zeros((blocks, steps * LANES), np.int64)
            grid[:, :n] = part.reshape(blocks, n)
            x, mask, words = _encode(np.ascontiguousarray(grid.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1), f, c)
            x, mask, words = x.reshape(blocks, LANES), mask.reshape(steps, blocks, LANES), words.reshape(steps, blocks, LANES)
            for b in range(blocks):
                own = words[:, b][mask[:, b]]
                own_ids = ids[at + b * n : at + (b + 1) * n]
                heads.append(struct.pack("<IIQ", n, zlib.crc32(own_ids.astype("<u4").tobytes()), first) + x[b].astype("<u8").tobytes())
                streams.append(own.astype("<u4").tobytes())
                first += len(own)
    words = b"".join(streams)
    body = b"".join([
        HEAD.pack(MAGIC, len(doc_ids), len(ids), len(symbols), len(heads), len(words) // 4),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), np.asarray(lengths, "<u8").tobytes(),
        symbols.astype("<u4").tobytes(), f.astype("<u4").tobytes(), *heads, words,
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def _runs(n: int):
    """(first id, ids a block, blocks): the full blocks, then the last."""
    if full := n // BLOCK:
        yield 0, BLOCK, full
    if n % BLOCK:
        yield full * BLOCK, n % BLOCK, 1


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids of documents, all token ids, and the documents' lengths; an error if any checksum fails."""
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("segment checksum")
    magic, docs, n, symbols, blocks, words = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    doc_ids, nulls, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
    names, f = take("<u4", symbols), take("<u4", symbols).astype(np.uint64)
    heads = take(np.dtype([("n", "<u4"), ("crc", "<u4"), ("first", "<u8"), ("x", "<u8", LANES)]), blocks)
    stream = take("<u4", words)
    ids = np.empty(n, np.uint32)
    if n:
        c = np.cumsum(f) - f
        slots = np.repeat(np.arange(symbols, dtype=np.uint32), f.astype(np.int64))
        k = 0
        for begin, size, many in _runs(n):
            own = heads[k : k + many]
            steps = -(-size // LANES)
            got = _decode(own["x"].copy(), stream, own["first"].astype(np.int64), steps, f, c, slots)
            got = names[got.transpose(1, 0, 2).reshape(many, -1)[:, :size]]
            for b in range(many):
                if zlib.crc32(got[b].astype("<u4").tobytes()) != own["crc"][b]:
                    raise ValueError(f"checksum of block {k + b}")
            ids[begin : begin + size * many] = got.ravel()
            k += many
    return [None if z else int(d) for d, z in zip(doc_ids, nulls)], ids, lengths


def _segments(path: str, kind: str, end_id: int, segment_ids: int):
    def run(batches):
        coder, shard, seg = encoder(path, kind), TaskContext.get().partitionId(), 0
        docs: list = []
        parts: list[np.ndarray] = []
        lengths: list[int] = []

        def flush():
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([seg], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([write_segment(docs, ids, np.array(lengths))], pa.binary())], ["shard", "segment", "n_docs", "n_tokens", "data"])

        held = 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            for i, j in text_runs(texts):
                ids, counts = coder.encode(texts[i:j])
                for doc_id, own, n in zip(doc_ids[i:j], np.split(ids, np.cumsum(counts)[:-1]), counts.tolist()):
                    docs.append(doc_id)
                    parts.append(np.append(own, np.uint32(end_id)))
                    lengths.append(n + 1)
                    held += n + 1
                    if held >= segment_ids:
                        yield flush()
                        seg, held, docs, parts, lengths = seg + 1, 0, [], [], []
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, folder: str, path: str | None = None, kind: str = "byte", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write every document's ids, each ended by ``end_id``, to segment files under ``folder``.

    They are in ascending order of doc_id (nulls first, equal ids by a hash of
    the text): by shard, then by segment. The segments lie in the ``data``
    column of Parquet files, since only Spark's writers reach every store.
    Null texts count as empty; repeated rows are written each; an empty table
    gives no segment. Other columns are ignored.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = docs.repartitionByRange(partitions(spark), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(_segments(path or tokenizer_path("byte_bpe_50k.json"), kind, end_id, segment_ids), "shard long, segment long, n_docs long, n_tokens long, data binary").write.parquet(folder)


def _digests(batches):
    for batch in batches:
        for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            doc_ids, ids, lengths = read_segment(data.as_py())
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone; segments decode apart."""
    limit_batches(spark)
    files = spark.read.schema("shard long, segment long, n_docs long, n_tokens long, data binary").parquet(folder)
    sizes = files.select("shard", "segment", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("all")).withColumn("base", F.sum("all").over(Window.orderBy("shard")) - F.col("all"))  # a row a shard
    starts = sizes.withColumn("within", F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_tokens")).join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("within")).alias("start"))
    return files.select("shard", "segment", "data").join(starts, ["shard", "segment"]).select("start", "data").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` to the scratch folder and give the digests read back."""
    scratch = Scratch(docs.sparkSession, "rans")
    write_ids(docs, f"{scratch.root}/ids", path)
    return read_digests(docs.sparkSession, f"{scratch.root}/ids")
