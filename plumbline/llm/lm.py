"""Stupid-backoff scores of documents against counts of the whole corpus.

The count tables are partitioned by the n-grams' hashes. Documents are dealt to
batches; a batch's n-grams, with its own counts of them, go to the partitions of
their hashes. A partition adds up what all batches hold and sends each batch the
corpus's counts of its n-grams, which are joined to these in the order of their
hashes. Then the batch's n-grams, with these counts, are summed for each document.

What moves is packed: a batch's hashes for one partition are one row, as sorted
differences, and so are the counts that come back. A frequent n-gram is one entry
of each batch. ``score_exploded`` says the same with a row an n-gram.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, limit_batches, ngram_hashes, partitions, spans_of_bytes, text_buffers, word_hashes

ORDER = 3
ALPHA = 0.4
#: n-grams of two words or more that occur less often count as unseen.
LEAST = 2
#: Bytes of text in a batch, and n-grams in a partition of the counts, on average.
BATCH_BYTES, PART_GRAMS = 12 << 20, 4 << 20


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned longs as compressed differences, bytes of equal weight together."""
    steps = np.diff(values, prepend=U64(0)).astype("<u8")
    return len(values).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=max(8 * n, 1))
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel(), dtype=U64)


def pack_counts(values: np.ndarray) -> bytes:
    """A byte each; 255 stands for what is listed behind."""
    large = values[values >= 255].astype("<u8")
    raw = len(values).to_bytes(8, "little") + np.minimum(values, 255).astype(np.uint8).tobytes() + large.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_counts(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    values = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    values[values == 255] = np.frombuffer(raw, "<u8", offset=8 + n)
    return values


def _grams(texts: pa.Array, order: int):
    """Per text run: row of each word, and for each n the hashes of the n-grams that begin at each word (those that cross texts marked)."""
    data, offs = text_buffers(texts)
    for i, j in spans_of_bytes(offs, 2 << 20):
        words, rows = word_hashes(data, offs[i : j + 1])
        out = []
        for n in range(1, order + 1):
            grams = ngram_hashes(words, n)
            out.append((grams, rows[: len(grams)] == rows[n - 1 :] if len(grams) else np.zeros(0, bool)))
        yield i, j, rows, out


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Partition of sorted hashes, by their high bits."""
    edges = np.array([k * (1 << 64) // parts for k in range(1, parts)], U64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _counted(texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams' hashes in order, and how often each occurs."""
    got = [g[fits] for _, _, _, grams in _grams(texts, order) for g, fits in grams]
    return np.unique(np.concatenate(got) if got else np.zeros(0, U64), return_counts=True)


def _requests(order: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        hashes, counts = _counted(table.column("text"), order)
        at = _part(hashes, parts)
        full = [p for p in range(parts) if at[p] < at[p + 1]]
        return pa.table({
            "batch": pa.array([batch] * len(full), pa.int64()), "part": pa.array(full, pa.int64()),
            "hashes": pa.array([pack_sorted(hashes[at[p] : at[p + 1]]) for p in full], pa.binary()), "counts": pa.array([pack_counts(counts[at[p] : at[p + 1]]) for p in full], pa.binary()),
        })

    return run


def _answers(table: pa.Table) -> pa.Table:
    """The corpus's count of each batch's n-grams, in the order of their hashes."""
    asked = [unpack_sorted(x.as_py()) for x in table.column("hashes")]
    counts = np.concatenate([unpack_counts(x.as_py()) for x in table.column("counts")])
    both = np.concatenate(asked)
    order = np.argsort(both, kind="stable")
    new = np.empty(len(both), bool)
    new[:1] = True
    np.not_equal(both[order[1:]], both[order[:-1]], out=new[1:])
    totals = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(both) else counts
    whole = np.empty(len(both), np.int64)
    whole[order] = totals[np.cumsum(new) - 1]
    ends = np.cumsum([len(a) for a in asked])
    return pa.table({"batch": table.column("batch"), "part": table.column("part"), "counts": pa.array([pack_counts(whole[e - len(a) : e]) for a, e in zip(asked, ends)], pa.binary())})


def log_scores(counts: list[np.ndarray], fits: list[np.ndarray], words: int, alpha: float = ALPHA, least: int = LEAST) -> np.ndarray:
    """log S of each word of a run. counts[n - 1][i]: corpus count of the n-gram that begins at word i; fits: whether it lies in one text."""
    m = len(counts[0])
    room = np.zeros(m, np.int64)  # words of context there are, up to order - 1
    for n in range(2, len(counts) + 1):
        room[n - 1 :][fits[n - 1]] = n - 1
    out = np.log(counts[0]) - np.log(words) + np.log(alpha) * room
    for n in range(2, len(counts) + 1):  # longer n-grams overrule
        have = fits[n - 1] & (counts[n - 1] >= least)
        at = np.flatnonzero(have) + n - 1
        begin = at - n + 1
        out[at] = np.log(counts[n - 1][begin]) - np.log(counts[n - 2][begin]) + np.log(alpha) * (room[at] - (n - 1))
    return out


def _scores(order: int, words: int, alpha: float, least: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        keys = _counted(docs.column("text"), order)[0]  # answers come in their order
        counts = np.concatenate([unpack_counts(x.as_py()) for x in answers.column("counts")] or [np.zeros(0, np.int64)])
        if len(counts) != len(keys):
            raise ValueError("a batch's rows aren't those that were counted")
        n = docs.num_rows
        total, sizes = np.zeros(n), np.zeros(n, np.int64)
        for i, j, rows, grams in _grams(docs.column("text"), order):
            if not len(rows):
                continue
            found, fits = [], []
            for g, fit in grams:
                own = np.ones(len(g), np.int64)
                own[fit] = counts[np.searchsorted(keys, g[fit])]
                found.append(own)
                fits.append(fit)
            got = log_scores(found, fits, words, alpha, least)
            total[i:j] += np.bincount(rows, got, j - i)
            sizes[i:j] += np.bincount(rows, minlength=j - i)
        mean = pa.array(np.divide(total, sizes, out=np.zeros(n), where=sizes > 0), mask=sizes == 0)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(sizes), "log_score": pa.array(total), "mean_log_score": mean})

    return run


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of each row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. log_score sums, over
    the words, the log of the stupid-backoff score: the longest n-gram ending
    there, of ``order`` words at most, that occurs ``least`` times or more in the
    corpus, relative to its first n - 1 words, times ``alpha`` for each word of
    context given up; the last resort is the word's share of all words. The
    corpus is the table itself, all of it.

    A text without words, empty or null has 0 words, score 0 and mean null.
    Repeated rows count and are scored each. An empty table gives no rows.
    Other columns are ignored.
    """
    docs, words, size = _measured(docs)
    batches, parts = max(1, -(-size // BATCH_BYTES)), max(partitions(docs.sparkSession), -(-words * order // PART_GRAMS))
    # By what a row holds, so that a task that runs again deals its rows as before; copies under different ids go apart.
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(batches))).groupBy("batch")
    asked = dealt.applyInArrow(_requests(order, parts), "batch long, part long, hashes binary, counts binary")
    told = asked.groupBy("part").applyInArrow(_answers, "batch long, part long, counts binary")
    return dealt.cogroup(told.groupBy("batch")).applyInArrow(_scores(order, max(1, words), alpha, least), "doc_id long, n_words long, log_score double, mean_log_score double")


def _sizes(batches):
    words = size = 0
    for batch in batches:
        data, offs = text_buffers(batch.column(0))
        words += sum(len(word_hashes(data, offs[i : j + 1])[0]) for i, j in spans_of_bytes(offs))
        size += int(offs[-1] - offs[0])
    yield pa.RecordBatch.from_arrays([pa.array([words]), pa.array([size])], ["words", "size"])


def _measured(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """doc_id and text, and the numbers of words and bytes."""
    limit_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words, size = docs.select("text").mapInArrow(_sizes, "words long, size long").agg(F.sum("words"), F.sum("size")).first()
    return docs, words or 0, size or 0


def _exploded(order: int):
    """A row for each word: its document, and the hashes of the n-grams that end there and of what these begin with."""

    def run(batches):
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for i, _, rows, grams in _grams(batch.column(1), order):
                for n, (hashes, fits) in enumerate(grams, 1):
                    at = np.flatnonzero(fits)
                    place = at + n - 1
                    begins = grams[n - 2][0][at].view(np.int64) if n > 1 else np.zeros(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(uids[i + rows[at]]), pa.array(place + (i << 32)), pa.array(np.full(len(at), n)), pa.array(hashes[at].view(np.int64)), pa.array(begins)], ["uid", "place", "n", "gram", "start"])

    return run


def score_exploded(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """As ``score``, with n-grams as rows: count tables by partial aggregates, joined to the exploded n-grams, summed per document.

    It moves every n-gram of every document three times, where ``score`` moves
    the distinct ones of a batch once, in packed form.
    """
    docs, words, _ = _measured(docs)
    scratch = Scratch(docs.sparkSession, "lm")
    docs = scratch.keep(docs.withColumn("uid", F.monotonically_increasing_id()), "docs")
    grams = docs.select("uid", "text").mapInArrow(_exploded(order), "uid long, place long, n long, gram long, start long")
    counts = grams.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("often")).where(f"n = 1 or often >= {int(least)}")
    begun = counts.select((F.col("n") + 1).alias("n"), F.col("gram").alias("start"), F.col("often").alias("of"))
    known = counts.join(grams, ["n", "gram"]).join(begun, ["n", "start"], "left")
    share = F.log("often") - F.log(F.when(F.col("n") == 1, F.lit(float(max(1, words)))).otherwise(F.col("of")))
    room = grams.groupBy("uid", "place").agg(F.max("n").alias("room"))
    best = known.groupBy("uid", "place").agg(F.max_by(F.struct("n", share.alias("share")), "n").alias("best")).join(room, ["uid", "place"])
    sums = best.groupBy("uid").agg(F.sum(F.col("best.share") + math.log(alpha) * (F.col("room") - F.col("best.n"))).alias("log_score"), F.count(F.lit(1)).alias("n_words"))
    out = docs.select("uid", "doc_id").join(sums, "uid", "left")
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"), (F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
