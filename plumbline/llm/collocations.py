"""Phrases whose words go together, mined by language.

Every n-gram of 1 to ``longest`` words is a row, counted by language in a hash
aggregate. Most n-grams are rare, and an n-gram is no more frequent than its
parts; so a first pass counts hashes of words and pairs, and the second gives
rows with texts only to n-grams whose words and pairs may all be frequent, by a
Bloom filter of those that are. The filter lets others through but keeps none
out, so the counts of whatever reaches the minimum are exact. Tasks add up equal
n-grams of a stretch of texts before they hand them on, and Spark's aggregate the
rest before the shuffle.

Frequent phrases are then cut at each place and joined to the counts of their
two parts, scored in decimals, and dropped where an extension by one word occurs
as often; ranks come from windows, first within parts of a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Scratch, id_filter, limit_batches, mix, ngram_hashes, passes, small_side, span_hashes, spans_of_bytes, text_buffers

#: What ends a piece, besides the text's end; what ends a word within one.
PIECE_END, BLANK = np.zeros(256, bool), np.zeros(256, bool)
PIECE_END[[ord(c) for c in ".,;:!?"] + [*range(10, 14)]] = True
BLANK[[32, 9]] = True
#: Hashes that a task adds up before it hands them on, and bytes of text whose equal n-grams it adds up.
HELD_HASHES, HELD_BYTES = 1 << 21, 1 << 18
#: Parts of a language in which ranks are taken first.
RANK_PARTS = 64


class Words:
    """Words of consecutive texts, lower-cased, one blank behind each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        base, raw = int(offs[0]), LOWER[data[offs[0] : offs[-1]]]
        n = len(raw)
        ends = PIECE_END[raw]
        inside = ~(ends | BLANK[raw])
        cut = offs[1:-1] - base
        cut = cut[(cut > 0) & (cut < n)]
        start, stop = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        start[cut] = inside[cut]
        stop[:-1] &= ~inside[1:]
        stop[cut - 1] = inside[cut - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.rows = np.searchsorted(offs - base, s, "right") - 1
        self.piece = np.cumsum(ends)[s] + self.rows  # grows at each end of a piece and of a text
        size = e - s
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size
        self.text = np.full(int(self.end[-1]) + 1 if len(s) else 0, 32, np.uint8)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.text[np.repeat(self.begin, size) + at] = raw[np.repeat(s, size) + at]
        self.hashes = span_hashes(raw, s, e)

    def fits(self, n: int) -> np.ndarray:
        """Words that begin a phrase of n words."""
        m = max(0, len(self.piece) - n + 1)
        return self.piece[:m] == self.piece[n - 1 :] if m else np.zeros(0, bool)

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """Texts of the phrases of n words that begin at these words."""
        begin, size = self.begin[at], self.end[at + n - 1] - self.begin[at]
        offs = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(offs[-1]) + np.repeat(begin - offs[:-1], size)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(self.text[take]))


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Code of each row's language, the languages, and a hash of each."""
    coded = column.fill_null("und").dictionary_encode()
    names = coded.dictionary
    data, offs = text_buffers(names)
    return coded.indices.to_numpy(), names.to_pylist(), span_hashes(data, offs[:-1], offs[1:])


def _runs(batch, size: int = 1 << 20):
    """Words of texts of about ``size`` bytes at a time, and each word's language."""
    codes, names, marks = _languages(batch.column("lang"))
    data, offs = text_buffers(batch.column("text"))
    for i, j in spans_of_bytes(offs, size):
        words = Words(data, offs[i : j + 1])
        yield words, codes[i:j][words.rows], names, marks


def _keys(words: Words, marks: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that begins at each word, with its language."""
    grams = ngram_hashes(words.hashes, n)
    return mix(grams ^ marks[: len(grams)])


def _hashed(batches):
    """Hashes of words and pairs, added up for a while."""
    held, size = [], 0

    def flush():
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        for i in range(0, len(keys), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 65_536].view(np.int64)), pa.array(counts[i : i + 65_536])], ["gram", "n"])

    for batch in batches:
        for words, code, _, marks in _runs(batch):
            for n in (1, 2):
                held.append(_keys(words, marks[code], n)[words.fits(n)])
                size += len(held[-1])
            if size >= HELD_HASHES:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def _exploded(shared, longest: int):
    """Rows of language, words, phrase and count: the n-grams that the filter leaves, equal ones of a run of texts as one, and each language's words together as the phrase '' of 0 words."""

    def rows(lang: str, n: int, phrases: pa.Array, counts: pa.Array):
        for i in range(0, len(phrases), 8192):
            part = phrases[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([n] * len(part), pa.int32()), part.cast(pa.string()), counts[i : i + 8192]], ["lang", "words", "phrase", "n"])

    def run(batches):
        totals: dict[str, int] = {}
        for batch in batches:
            for words, code, names, marks in _runs(batch, HELD_BYTES):
                for c, many in enumerate(np.bincount(code, minlength=len(names)).tolist()):
                    totals[names[c]] = totals.get(names[c], 0) + many
                single = passes(shared.value, _keys(words, marks[code], 1).view(np.int64))
                pair = passes(shared.value, _keys(words, marks[code], 2).view(np.int64)) & words.fits(2) & single[:-1] & single[1:]
                for n in range(1, longest + 1):
                    ok = single if n == 1 else pair[: max(0, len(single) - n + 1)].copy()
                    for k in range(1, n - 1):  # all pairs of the n-gram
                        ok &= pair[k : k + len(ok)]
                    at = np.flatnonzero(ok)
                    for c in np.unique(code[at]).tolist():
                        found = pc.value_counts(words.phrases(at[code[at] == c], n))
                        yield from rows(names[c], n, found.field("values"), found.field("counts"))
        for lang, many in totals.items():
            if many:
                yield from rows(lang, 0, pa.array([""]), pa.array([many], pa.int64()))

    return run


def counted(docs: DataFrame, least: int, longest: int, scratch: Scratch) -> DataFrame:
    """lang, words, phrase, n: every n-gram that occurs ``least`` times or more, and each language's number of words as the phrase '' of 0 words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashes = texts.mapInArrow(_hashed, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    frequent = scratch.keep(hashes.select("gram"), "frequent")
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(frequent, frequent.count()))  # 2**28 bits at most
    grams = texts.mapInArrow(_exploded(shared, longest), "lang string, words int, phrase string, n long")
    table = scratch.keep(grams.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0)), "counts")
    scratch.drop("frequent")
    return table


def mine(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, covered: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    Texts have A-Z lower-cased and are split into pieces at ``[.,;:!?\\x0A-\\x0D]``,
    these into words ``[^\\x20\\x09]+``. n is the number of the language's words, a
    how often the phrase occurs in pieces, overlaps included, ``least`` times at
    the fewest. Cut after its first k words it has parts that occur l and r times
    and the score floor(1000 * a * n / (l * r)); the lowest cut counts, the first
    of equal ones. A phrase goes if its words lie inside a longer one that occurs
    ``covered`` per cent as often or more; an extension by one word tells, as
    those between occur no less often than the longer one. Order is by score and a, descending, then by phrase
    in the order of UTF-8 bytes.

    A null lang is ``und``, a null text empty. Repeated rows count each. Texts
    without words and tables without rows give nothing. Other columns are
    ignored. Arithmetic is exact to 38 digits.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    scratch = Scratch(spark, "collocations")
    table = counted(docs, least, longest, scratch)
    phrases = table.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    parts = F.split("phrase", " ")
    cuts = phrases.select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    known = lambda name, count: table.where("words > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    total = table.where("words = 0").select("lang", "n")  # a row a language
    cuts = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).join(small_side(total), "lang")
    dec = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (dec("a") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)") * dec("n"), (dec("l") * dec("r")).cast("decimal(38,0)")).cast("long")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = phrases.where("words > 2").select("lang", F.col("a").alias("whole"), F.explode(F.array(F.array_join(F.slice(parts, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(parts, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("whole").isNull() | (100 * F.col("whole") < covered * F.col("a")))
    left = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
