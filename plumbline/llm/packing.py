"""Packing of documents into fixed-length sequences: first-fit decreasing with a
tournament tree of bin capacities, run apart in randomised groups of documents."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches
from .tokens import encoder, text_runs, tokenizer_path

SEQUENCE = 2048
GROUP_DOCS = 4096
END_ID = 1
#: Pieces of texts whose ids a Python worker holds, each about 250 bytes. Fewer take more time, but idle workers keep them beside the next stages of a pipeline.
HELD = 150_000


class CapacityTree:
    """Leaves are bins in order; each node has the largest capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """Put ``need`` into the first bin that has room; the bin, and the room it had."""
        tree, k = self.tree, 1
        while k < self.size:
            k *= 2
            if tree[k] < need:
                k += 1
        room, bin_ = tree[k], k - self.size
        tree[k] = room - need
        while k > 1:
            k //= 2
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left > right else right
        return bin_, room


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, all at most ``capacity``; equal sizes in the order given."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = sizes == capacity
    bins[full] = np.arange(full.sum())
    rest = np.flatnonzero(~full)
    rest = rest[np.argsort(-sizes[rest], kind="stable")]
    tree = CapacityTree(len(rest), capacity)
    first = int(full.sum())
    for k, need in zip(rest.tolist(), sizes[rest].tolist()):
        bin_, room = tree.place(need)
        bins[k], offsets[k] = first + bin_, capacity - room
    return bins, offsets


def _pieces(path: str, kind: str, sequence: int, end_id: int, with_ids: bool, held: int):
    """Rows of (doc_id, start, length, ids_crc32, doc_tokens, ids) for each document's pieces."""

    def run(batches):
        coder = encoder(path, kind, held)
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            for i, j in text_runs(all_texts):
                ids, counts = coder.encode(all_texts[i:j])
                ends = np.cumsum(counts)
                out: list[list] = [[], [], [], [], [], [], []]
                for doc_id, end, n in zip(all_ids[i:j], ends.tolist(), counts.tolist()):
                    own = np.append(ids[end - n : end], np.uint32(end_id)).astype("<u4")
                    salt = zlib.crc32(own.tobytes())
                    for at in range(0, n + 1, sequence):
                        piece = own[at : at + sequence].tobytes()
                        for col, x in zip(out, (doc_id, at, len(piece) // 4, zlib.crc32(piece), n + 1, salt, piece if with_ids else None)):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64()] * 6 + [pa.binary()])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "ids"])

    return run


def _pack(sequence: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "salt", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), sequence)
        return rows.assign(sequence_id=bins + (rows["group"].to_numpy() << 24), offset=offsets)[[*(c for c in rows.columns if c not in ("group", "salt")), "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, path: str | None = None, kind: str = "word", sequence: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS, with_ids: bool = False, held: int = HELD) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, packed little-endian) of each piece.

    A document's ids end with ``end_id``. It is cut every ``sequence`` ids; its
    full pieces are sequences, its last piece is packed with those of its group.
    Groups are drawn at random (seeded, so a task that runs again deals alike)
    and hold about as many pieces as ``group_docs`` documents have, so no key,
    source or group of copies fills one.

    A null or empty text has the end id alone. A null doc_id stays null, its
    pieces are packed like others. Repeated rows are packed each. An empty
    table gives no rows. Other columns, of any name, are ignored. ``held`` bounds
    the pieces a worker holds ids of; rows don't depend on it.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    path = path or tokenizer_path("word_bpe_49k.json")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = max(1, -(-docs.count() // group_docs))
    cols = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    tail = ", ids binary" if with_ids else ""
    pieces = docs.mapInArrow(_pieces(path, kind, sequence, end_id, with_ids, held), f"{cols}, salt long, ids binary")
    if not with_ids:
        pieces = pieces.drop("ids")
    pieces = pieces.withColumn("group", F.floor(F.rand(7) * groups).cast("long"))
    return pieces.groupBy("group").applyInPandas(_pack(sequence), f"{cols}{tail}, sequence_id long, offset long")
