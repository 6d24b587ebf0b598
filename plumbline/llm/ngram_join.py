"""N-gram Jaccard join on word shingles with count-vector R-trees.

A document's distinct shingles are hashed into groups; the counts of the groups
are its point. Two sets share at most the sum of the coordinates' minima of
their points, so for Jaccard >= 3/4 that sum must reach 3/7 of both sizes. A
packed R-tree over points applies the bound to whole nodes (by the maxima of
their boxes), then to points; the pairs that are left are verified on their
sets. Trees hold coarse points of COARSE counts, so that a row is small
whatever the text's length; a pair that they leave meets its fine points once.

One tree over all documents prunes little, so the trees are built over blocks
that any linked pair shares: a set of n shingles has the first n - ceil(3n/4) + 1
of them, in one order for all, as its keys, and two linked sets share one of
these. The order puts the corpus's most frequent shingles last. Where the first
key that two sets share is the i-th of one and the j-th of the other, they share
min(n - i, m - j) at most; some block holds the pair with its first shared key,
so pairs that break this bound in a block are left to others. Blocks of up to
SMALL rows are trees of one node, whose pairs meet the fine points at once.

Equal sets are one class before all this. A first round compares each class
with one other that it shares most keys with, so that a large group of near
copies becomes one component; the blocks then look only for links between
different components. Where a large block would give many pairs a row, each set
is first compared with the one of another component that may share most with
it, round after round while that finds links; what is left is compared with all.
A block of many rows is split into parts, and every pair of parts is joined.

Keys that no other set has can't be shared, so a set's size less these bounds
every overlap as well.
"""

from __future__ import annotations

import itertools
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, id_filter, limit_batches, partitions, passes, shingle_sets, small_side, text_buffers
from .graph import components

#: Blocks are split into parts of about so many rows.
PART_ROWS = 4096
#: The list of frequent shingles: at most so many, of documents whose id hashes to one residue of SAMPLE.
FREQUENT, SAMPLE = 65_536, 64
#: A large block that would give more pairs a row gives the best of each row instead, for another round.
PAIRS_A_ROW = 8
#: Fine counts from here on are kept as this.
FULL = 255
#: Blocks of up to so many rows are one node.
SMALL = 32
#: log2 of the counts of a coarse point.
COARSE = 6
#: A key row's number: rare keys of its set (saturating), the set's size, the key's place (saturating).
SIZE_BITS, PLACE_BITS, RARE_MOST = 30, 18, (1 << 15) - 1


def levels_of(sizes: np.ndarray) -> np.ndarray:
    """log2 of the number of groups for sets of these sizes."""
    return np.clip(np.ceil(np.log2(np.maximum(sizes, 1) / 3)), 4, 14).astype(np.int64)


def level_of(n: int) -> int:
    return int(levels_of(np.array([n]))[0])


def count_vector(hashes: np.ndarray) -> bytes:
    level = level_of(len(hashes))
    groups = ((hashes * U64(0xC2B2AE3D27D4EB4F)) >> U64(64 - level)).astype(np.int64)
    return np.minimum(np.bincount(groups, minlength=1 << level), FULL).astype(np.uint8).tobytes()


def coarse_vector(hashes: np.ndarray) -> bytes:
    """2**COARSE counts, a byte each where that is enough, else four."""
    counts = np.bincount((hashes >> U64(64 - COARSE)).astype(np.int64), minlength=1 << COARSE)
    return counts.astype("<u4" if counts.max() > 255 else np.uint8).tobytes()


def coarse_points(column: pa.Array) -> np.ndarray:
    """(rows, 2**COARSE) counts from their bytes."""
    data, at = text_buffers(column)
    out = np.empty((len(at) - 1, 1 << COARSE), np.int32)
    wide = np.diff(at) > 1 << COARSE
    out[~wide] = data[at[:-1][~wide][:, None] + np.arange(1 << COARSE)]
    for k in np.flatnonzero(wide):
        out[k] = np.frombuffer(data[at[k] : at[k + 1]].tobytes(), "<u4")
    return out


def read_counts(data: np.ndarray) -> np.ndarray:
    """Counts from their bytes; a full one may be any number, and so bounds nothing."""
    counts = data.astype(np.int32)
    counts[data == FULL] = 1 << 20
    return counts


def fold(points: np.ndarray) -> np.ndarray:
    """The same counts in half as many groups."""
    return points.reshape(*points.shape[:-1], -1, 2).sum(-1)


def may_link(bound, size_a, size_b):
    return 7 * bound.astype(np.int64) >= 3 * (size_a + size_b)


class CountTree:
    """Packed R-tree over count vectors, filled in order of set size."""

    FAN, CHUNK = 32, 1 << 21

    def __init__(self, sizes: np.ndarray, reach: np.ndarray, points: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort((labels, sizes))
        sizes, reach, points = sizes[self.order], reach[self.order], points[self.order]
        self.labels = labels[self.order]
        self.levels = [(points, sizes, sizes, reach)]
        while len(self.levels[-1][0]) > self.FAN:
            top, low, high, far = self.levels[-1]
            at = np.arange(0, len(top), self.FAN)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(far, at)))

    def pairs(self):
        """Yield arrays (i, j, bound) of points of different labels whose bound lets them link."""
        n = len(self.levels[-1][0])
        i, j = np.triu_indices(n, 1 if len(self.levels) == 1 else 0)
        stack = [(len(self.levels) - 1, i, j)]
        while stack:
            depth, i, j = stack.pop()
            top, low, high, far = self.levels[depth]
            step = max(1, self.CHUNK // top.shape[1])
            if len(i) > step:
                stack += [(depth, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
                continue
            near = (4 * high[i] >= 3 * low[j]) & may_link(np.minimum(far[i], far[j]), low[i], low[j])
            if not depth:
                near &= self.labels[i] != self.labels[j]
            i, j = i[near], j[near]
            bound = np.minimum(top[i], top[j]).sum(1)
            near = may_link(bound, low[i], low[j])
            i, j = i[near], j[near]
            if not len(i):
                continue
            if not depth:
                yield self.order[i], self.order[j], bound[near]
                continue
            size = len(self.levels[depth - 1][0])
            a, b = np.divmod(np.arange(self.FAN**2), self.FAN)
            i, j = (i[:, None] * self.FAN + a).ravel(), (j[:, None] * self.FAN + b).ravel()
            fits = (i < size) & (j < size) & (i < j if depth == 1 else i <= j)
            stack.append((depth - 1, i[fits], j[fits]))


def read_info(info: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and key's place of key rows."""
    return info >> PLACE_BITS & (1 << SIZE_BITS) - 1, info & (1 << PLACE_BITS) - 1


def _few(starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, info: np.ndarray, reach: np.ndarray, comp: np.ndarray):
    """Pairs (i, j) of rows of many blocks of a node each that components, sizes and places let link."""
    sizes, places = read_info(info)
    left = np.minimum(sizes - places, reach)
    for m in np.unique(lengths).tolist():
        own = starts[lengths == m]
        x, y = np.triu_indices(m, 1)
        step = max(1, (1 << 20) // len(x))
        for k in range(0, len(own), step):
            i, j = (own[k : k + step, None] + x).ravel(), (own[k : k + step, None] + y).ravel()
            near = (comp[i] != comp[j]) & may_link(np.minimum(left[i], left[j]), sizes[i], sizes[j])
            yield ids[i[near]], ids[j[near]]


def _small(batches):
    """From key rows in order of key: pairs (a, b) of small blocks, once a batch, and the rows of large ones, with their key."""
    names = ("key", "rep", "info", "reach", "comp")
    held = [np.zeros(0, np.int64)] * 5  # of the last key, while it may be small
    large = None  # the last key, if it isn't

    def rows(table):
        none = pa.nulls(len(table[0]), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *map(pa.array, table)], ["a", "b", *names])

    def done(table, starts, lengths):
        many = np.repeat(lengths > SMALL, lengths)
        few = (lengths > 1) & (lengths <= SMALL)
        if many.any():
            yield rows([c[many] for c in table])
        got = list(_few(starts[few], lengths[few], *table[1:]))
        if got:
            i, j = (np.concatenate(x) for x in zip(*got))
            pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
            none = pa.nulls(pairs.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *[none] * 5], ["a", "b", *names])

    for batch in batches:
        table = [c.to_numpy() for c in batch.columns]
        if large is not None and len(table[0]):
            n = int(np.searchsorted(table[0] != large, True)) if table[0][-1] != large else len(table[0])
            if n:
                yield rows([c[:n] for c in table])
                table = [c[n:] for c in table]
        if not len(table[0]):
            continue
        large = None
        table = [np.concatenate(p) for p in zip(held, table)]
        cuts = np.concatenate([[0], np.flatnonzero(table[0][1:] != table[0][:-1]) + 1, [len(table[0])]])
        if cuts[-1] - cuts[-2] > SMALL:
            large, last = int(table[0][-1]), len(cuts)
        else:
            last = len(cuts) - 1
        end = int(cuts[last - 1])
        held = [c[end:] for c in table]
        if end:
            yield from done([c[:end] for c in table], cuts[: last - 1], np.diff(cuts[:last]))
    if len(held[0]):
        yield from done(held, np.array([0]), np.array([len(held[0])]))


class Rows:
    """Rows of large blocks: ids, sizes, most that can be shared, components, parts, and coarse points."""

    def __init__(self, table: pa.Table):
        self.ids, info, self.reach, self.labels, self.parts = (table.column(c).to_numpy() for c in ("rep", "info", "reach", "comp", "part"))
        self.sizes, places = read_info(info)
        self.reach = np.minimum(self.reach, self.sizes - places)
        self.points = coarse_points(table.column("coarse"))

    def block(self, begin: int, end: int, crossed: bool, limited: bool):
        """Yield pairs of one block that its tree leaves; crossed: only between parts. limited: at most PAIRS_A_ROW a row; where there are more, (None, None), then of each row the pair of largest bound."""
        own = slice(begin, end)
        sizes, parts, points = self.sizes[own], self.parts[own], self.points[own]
        top, mate = np.full(end - begin, -1.0), np.full(end - begin, -1)
        found, count, most = [], 0, PAIRS_A_ROW * (end - begin)
        for i, j, bound in CountTree(sizes, self.reach[own], points, self.labels[own]).pairs():
            if crossed:
                keep = parts[i] != parts[j]
                i, j, bound = i[keep], j[keep], bound[keep]
            if not limited:
                yield begin + i, begin + j
                continue
            count += len(i)
            if count <= most:
                found.append((begin + i, begin + j))
            share = bound / (sizes[i] + sizes[j])
            for x, y in ((i, j), (j, i)):
                order = np.lexsort((y, -share, x))
                x, y, z = x[order], y[order], share[order]
                first = np.flatnonzero(np.diff(x, prepend=-1))
                x, y, z = x[first], y[first], z[first]
                more = z > top[x]
                top[x[more]], mate[x[more]] = z[more], y[more]
        if limited and count > most:
            yield None, None
            x = np.flatnonzero(mate >= 0)
            found = [(begin + x, begin + mate[x])]
        yield from found


def _sets(frequent: np.ndarray):
    """Sizes, fingerprints, points and keys; those of equal sets once in a task, as far as memory of fixed size goes. Columns after the text go along."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            n = batch.num_rows
            sizes, prints, points, coarse, keys = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), [None] * n, [None] * n, [None] * n
            rare = np.zeros(n, np.int64)
            for row, got in shingle_sets(*text_buffers(batch.column(2))):
                if not (size := len(got)):
                    continue
                sizes[row] = size
                prints[row] = np.frombuffer(mark := blake2b(got.tobytes(), digest_size=16).digest(), "<i8")
                if mark in seen:
                    continue
                if len(seen) >= 50_000:
                    seen.clear()
                seen.add(mark)
                points[row], coarse[row] = count_vector(got), coarse_vector(got)
                first = size - (3 * size + 3) // 4 + 1
                if len(frequent):
                    hot = frequent[np.minimum(np.searchsorted(frequent, got), len(frequent) - 1)] == got
                    got = np.concatenate([got[~hot], got[hot]])
                    rare[row] = min(first, size - int(hot.sum()))
                keys[row] = got[:first].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(points, pa.binary()), pa.array(coarse, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(rare), *batch.columns[3:]],
                ["uid", "doc_id", "n", "f1", "f2", "point", "coarse", "keys", "rare", *batch.schema.names[3:]],
            )

    return run


def _all_shingles(batches):
    for batch in batches:
        got = [h for _, h in shingle_sets(*text_buffers(batch.column(0)))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64))], ["h"])


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """At most FREQUENT shingles, of those in most sampled documents. They only set the order of keys, so any list gives the same links."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_all_shingles, "h long")
    rows = some.groupBy("h").count().where("count >= 4").orderBy(F.desc("count"), "h").limit(FREQUENT).select("h").toArrow()
    return np.sort(rows.column(0).to_numpy().view(U64)) if rows.num_rows else np.zeros(0, U64)


def _shared(batches):
    """From rows sorted by key: those of keys of two rows or more, each with its key's first uid, where sizes and places let it link with that, else none."""
    held = None  # of the last key: key, first uid, its number, whether it is out

    def out(key, uid, info, leader):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(uid, pa.int64()), pa.array(info, pa.int64()), leader], ["key", "uid", "info", "leader"])

    for batch in batches:
        key, uid, info = (c.to_numpy() for c in batch.columns)
        if not len(key):
            continue
        new = np.empty(len(key), bool)
        new[0] = held is None or key[0] != held[0]
        np.not_equal(key[1:], key[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1 + (0 if new[0] else 1)
        leader = np.concatenate([[] if new[0] else [held[1]], uid[starts]]).astype(np.int64)[run]
        size, place = read_info(info)
        first_size, first_place = read_info(np.concatenate([[] if new[0] else [held[2]], info[starts]]).astype(np.int64)[run])
        fits = (leader != uid) & may_link(np.minimum(size - place, first_size - first_place), size, first_size)
        again = ~new
        keep = again.copy()
        keep[:-1] |= again[1:]
        if not new[0] and not held[3]:
            yield out([held[0]], [held[1]], [held[2]], pa.nulls(1, pa.int64()))
        held = int(key[-1]), int(leader[-1]), int(info[starts[-1]]) if len(starts) else held[2], bool(keep[-1])
        yield out(key[keep], uid[keep], info[keep], pa.array(leader[keep], mask=~fits[keep]))


def _bounded(batches):
    """Pairs whose points let them link; all columns but sizes and points go on."""
    for batch in batches:
        x, m, y, n = (batch.column(c).to_pylist() for c in ("x", "m", "y", "n"))
        at = pa.array([k for k, own in enumerate(zip(x, m, y, n)) if _pair_bound(*own)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in PAIR], PAIR)


#: A pair's classes with their doc_ids and fingerprints.
PAIR = ["a", "b", "a_doc", "b_doc", "a1", "a2", "b1", "b2"]


def _pair_bound(x: bytes, m: int, y: bytes, n: int) -> bool:
    if 4 * min(m, n) < 3 * max(m, n):
        return False
    x, y = (read_counts(np.frombuffer(b, np.uint8)) for b in (x, y))
    while len(x) != len(y):
        x, y = (fold(x), y) if len(x) > len(y) else (x, fold(y))
    return 7 * int(np.minimum(x, y).sum()) >= 3 * (m + n)


def _blocks(limited: bool):
    """Joins blocks that arrive in order of (key, x, y). A row of -1 and a key tells of a block that isn't done."""

    def joined(table: pa.Table, cuts: np.ndarray):
        rows, x, y = Rows(table), table.column("x").to_numpy(), table.column("y").to_numpy()
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for i, j in rows.block(begin, end, bool(x[begin] != y[begin]), limited):
                if i is None:
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), table.column("key")[begin : begin + 1].combine_chunks()], ["a", "b"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rows.ids[i], rows.ids[j])), pa.array(np.maximum(rows.ids[i], rows.ids[j]))], ["a", "b"])

    def run(batches):
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ident = np.stack([batch[c].to_numpy() for c in ("key", "x", "y")])
            cuts = np.flatnonzero((ident[:, 1:] != ident[:, :-1]).any(0)) + 1
            if last is not None and tuple(ident[:, 0]) != last:
                cuts = np.concatenate([[0], cuts])
            last = tuple(ident[:, -1])
            table = pa.Table.from_batches([batch])
            if not len(cuts):
                held.append(table)
                continue
            before = sum(t.num_rows for t in held)
            done = pa.concat_tables([*held, table.slice(0, cuts[-1])])
            yield from joined(done, np.unique(np.concatenate([[0], cuts + before])))
            held = [table.slice(cuts[-1])]
        if held:
            done = pa.concat_tables(held)
            yield from joined(done, np.array([0, done.num_rows]))

    return run


def _full_sets(wanted):
    """Whole sets of the rows whose id passes the filter; null ids all do."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            keep = passes(wanted.value, ids) | ~batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            yield from _sets_of(batch.column(1).take(pa.array(np.flatnonzero(keep))))

    return run


def _sets_of(texts):
    if len(texts):
        prints, blobs = [], []
        for _, got in shingle_sets(*text_buffers(texts)):
            if len(got):
                prints.append(np.frombuffer(blake2b(blob := got.tobytes(), digest_size=16).digest(), "<i8"))
                blobs.append(blob)
        prints = np.array(prints, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(blobs, pa.binary())], ["f1", "f2", "shingles"])


def _verified(batches):
    for batch in batches:
        at = []
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            if 7 * int((both[1:] == both[:-1]).sum()) >= 3 * len(both):
                at.append(k)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64()))], ["a", "b"])


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) of the pairs that link, by their whole sets; classes meet their sets by fingerprint."""
    ids = pairs.select(F.explode(F.array("a_doc", "b_doc")).alias("doc_id")).where("doc_id is not null")
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(ids, 2 * pairs.count()))  # 2**28 bits at most
    sets = docs.select("doc_id", "text").mapInArrow(_full_sets(wanted), "f1 long, f2 long, shingles binary").dropDuplicates(["f1", "f2"])
    both = pairs.join(sets.toDF("a1", "a2", "x"), ["a1", "a2"]).join(sets.toDF("b1", "b2", "y"), ["b1", "b2"])
    return both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, uid for each row of ``docs(doc_id, text, ...)``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set holds the
    distinct 5-word shingles, or the whole sequence when it is shorter. Rows
    link when Jaccard >= 0.75. component_id is the least doc_id reachable.

    Null, empty or blank texts have no set and are their own component (a null
    doc_id stays null). Repeated rows are rows of one component. Rows of null
    doc_id in a component with others get the least doc_id that isn't null. An
    empty table gives no rows. Other columns, of any name, are ignored.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    named, empty = _linked(docs, scratch)
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "uid")
    out = scratch.keep(out.union(empty.select("doc_id", "n", "doc_id", "uid")), "out")
    scratch.drop("empty", "named")
    return out


def _digest(text):
    """What tells texts of one doc_id apart."""
    return F.unhex(F.sha2(text, 256))


def _linked(docs: DataFrame, scratch: Scratch, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that have a set, (uid, doc_id, n, comp) and with ``digest`` that of the text, and rows that have none, (doc_id, n, uid). comp is the component's least uid of a class."""
    spark = docs.sparkSession
    limit_batches(spark)
    width = partitions(spark)
    also = ["digest"] if digest else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs))  # FREQUENT longs at most
    rows = scratch.keep(
        docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", *[_digest("text").alias(c) for c in also]).mapInArrow(
            lambda it: _sets(frequent.value)(it), ", ".join(["uid long, doc_id long, n long, f1 long, f2 long, point binary, coarse binary, keys array<long>, rare long", *[f"{c} binary" for c in also]])
        ),
        "rows",
    )
    full = rows.where("n > 0")
    reps = scratch.keep(full.groupBy("f1", "f2").agg(F.min("uid").alias("rep")), "reps")  # written, so that a join with a large group of copies can be split
    ident = scratch.keep(full.select("uid", "doc_id", "n", "f1", "f2", *also).join(reps, ["f1", "f2"]).select("uid", "rep", "doc_id", "n", *also), "ident")
    empty = scratch.keep(rows.where("n = 0").select("doc_id", "n", "uid"), "empty")
    # A class's least uid is the first of its task, and so has points and keys.
    points = scratch.keep(full.where("point is not null").join(reps.select(F.col("rep").alias("uid")), "uid").select(F.col("uid").alias("rep"), "doc_id", "n", "f1", "f2", "point", "coarse"), "points")

    info = (F.least("rare", F.lit(RARE_MOST)) * (1 << SIZE_BITS + PLACE_BITS) + F.col("n") * (1 << PLACE_BITS) + F.least("place", F.lit((1 << PLACE_BITS) - 1))).alias("info")
    keyed = full.where("keys is not null").select("uid", "n", "rare", F.posexplode("keys").alias("place", "key")).select("key", "uid", info)
    # The first row of a key is the one of fewest rare keys: of a large group of near copies, what they are copies of.
    shared = scratch.keep(keyed.repartition(width, "key").sortWithinPartitions("key", "info", "uid").mapInArrow(_shared, "key long, uid long, info long, leader long"), "shared")
    scratch.drop("rows", "reps")
    scratch.release()

    def distinct_pairs(df: DataFrame) -> DataFrame:
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    fine = points.select("rep", "n", "point", "doc_id", "f1", "f2")

    def links_of(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by fine points, then by whole sets."""
        name = f"near-{next(number)}"
        near = pairs.join(fine.toDF("a", "m", "x", "a_doc", "a1", "a2"), "a").join(fine.toDF("b", "n", "y", "b_doc", "b1", "b2"), "b")
        near = scratch.keep(near.mapInArrow(_bounded, ", ".join(f"{c} long" for c in PAIR)), name)
        out = scratch.keep(_verify(near, docs), f"links-{next(number)}")
        scratch.drop(name)
        scratch.release()
        return out

    def joined(links: DataFrame, found: DataFrame | None = None) -> DataFrame:
        return components(links if found is None else links.union(found.where("v <> comp").select("v", "comp")), scratch, f"found-{next(number)}")

    # First round: of each row, the first row of the keys that most of its keys lead to.
    number = itertools.count()
    leads = shared.where("leader is not null").groupBy("uid", "leader").count().groupBy("uid").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    leads = leads.join(ident.select("uid", F.col("rep").alias("a")), "uid").join(ident.select(F.col("uid").alias("leader"), F.col("rep").alias("b")), "leader").where("a <> b")
    found = joined(links_of(scratch.keep(distinct_pairs(leads), "leads")))
    scratch.drop("leads")

    # What each class can share at most: its size without the keys that it has alone.
    size = F.shiftright(F.first("info"), PLACE_BITS).bitwiseAND((1 << SIZE_BITS) - 1)
    alive = shared.groupBy(F.col("uid").alias("rep")).agg(F.count(F.lit(1)).alias("with"), size.alias("n"))
    alive = alive.select("rep", "n", (F.ceil(3 * F.col("n") / 4) - 1 + F.col("with")).cast("long").alias("reach")).where("4 * reach >= 3 * n")
    alive = scratch.keep(alive.join(points.select("rep"), "rep", "left_semi").drop("n"), "alive")

    def compared(blocks: DataFrame, limited: bool) -> tuple[DataFrame, DataFrame]:
        """Pairs of classes of different components that blocks, sizes, places and coarse points let link, and keys where more are to come."""
        place = alive.join(found.withColumnRenamed("v", "rep"), "rep", "left").select("rep", "reach", F.coalesce("comp", "rep").alias("comp"))
        block = blocks.select("key", F.col("uid").alias("rep"), "info").join(place, "rep").select("key", "rep", "info", "reach", "comp")
        block = block.repartition(width, "key").sortWithinPartitions("key", "rep")
        told = scratch.keep(block.mapInArrow(_small, "a long, b long, key long, rep long, info long, reach long, comp long"), told_name := f"told-{next(number)}")
        large = told.where("key is not null").drop("a", "b")
        mixed = large.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi")
        mixed = mixed.select("key", F.ceil(F.col("rows") / PART_ROWS).cast("long").alias("parts"))
        large = large.join(mixed, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
        large = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        large = large.select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "rep", "info", "reach", "comp").join(points.select("rep", "coarse"), "rep")
        trees = large.repartition(width, "key", "x", "y").sortWithinPartitions("key", "x", "y", "rep").mapInArrow(_blocks(limited), "a long, b long")
        trees = scratch.keep(trees, trees_name := f"trees-{next(number)}")
        pairs = scratch.keep(told.where("key is null").select("a", "b").union(trees.where("a >= 0")).distinct(), f"pairs-{next(number)}")
        undone = scratch.keep(trees.where("a < 0").select(F.col("b").alias("key")).distinct(), f"undone-{next(number)}")
        scratch.drop(told_name, trees_name)
        scratch.release()
        return pairs, undone

    # Then between the components of each block.
    limited, blocks = True, shared
    while True:
        pairs, undone = compared(blocks, limited)
        more = not undone.isEmpty()
        links = links_of(pairs)
        if not links.isEmpty():
            found = joined(links, found)
        elif more:
            limited = False  # the best of each row don't link: compare all
        if not more:
            break
        blocks = shared.join(undone, "key", "left_semi")  # the others are done
    named = ident.join(found.withColumnRenamed("v", "rep"), "rep", "left").select("uid", "doc_id", "n", F.coalesce("comp", "rep").alias("comp"), *also)
    named = scratch.keep(named, "named")
    scratch.drop("ident", "points", "shared", "alive", *[f"{kind}-{k}" for kind in ("links", "found", "pairs", "undone") for k in range(next(number))])
    return named, empty


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that of its least doc_id.

    Each row is judged by its own component, whatever other rows have its
    doc_id. Of rows of the least doc_id that of the least text digest stays, of
    those of one text that whose other columns come first as JSON. Null doc_ids
    come after all others, so a component of null doc_ids keeps one row too.
    Rows without a set are their own components and all stay.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    named, _ = _linked(docs, scratch, digest=True)
    # Rows of one doc_id and text are in one component, so these two are a key that any reading of docs gives again.
    keys = named.groupBy("comp", "doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")).withColumn("rank", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest"))
    best = keys.groupBy("comp").agg(F.min("rank").alias("best"))
    judged = keys.join(best, "comp").select(F.col("doc_id").alias("__doc_id"), F.col("digest").alias("__digest"), F.col("rank").eqNullSafe(F.col("best")).alias("__stays"), "rows")
    judged = scratch.keep(judged.where("not __stays or rows > 1").drop("rows"), "judged")
    scratch.drop("empty", "named")
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    ident = F.col(doc_id).cast("long").eqNullSafe(F.col("__doc_id")) & (_digest(F.col(text).cast("string")) == F.col("__digest"))
    kept = inner.join(small_side(judged.where("not __stays")), ident, "left_anti")
    twice = judged.where("__stays")
    if twice.isEmpty():
        return kept.toDF(*names)
    others = F.to_json(F.struct(F.lit(0).alias("__"), *[F.col(c) for c in inner.columns if c not in (doc_id, text)]))
    first = Window.partitionBy("__doc_id", "__digest").orderBy("__others")
    again = inner.withColumn("__others", others).join(small_side(twice), ident).withColumn("__row", F.row_number().over(first)).where("__row = 1")
    return kept.join(small_side(twice), ident, "left_anti").union(again.select(*inner.columns)).toDF(*names)
