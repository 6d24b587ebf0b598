"""Collocations, mixing and clustering against plain rules, and the defined results of odd rows; hashes of words."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import clustering, collocations, common, lm, mixing, ngram_join


# --- hashes of words


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_word_hashes():
    """Words that a sum of powers modulo 2**64 can't tell apart, and words that differ in length, place or one byte alone."""
    words = [*thue_morse(1024), *thue_morse(2048), *("a" * n for n in range(1, 40)), "x\x00", "x\x00\x00", "abcdefgh" + "ABCDEFGH".lower()[::-1], "12345678" * 3, "12345678" * 2 + "12345679", "é" * 9, "é" * 8 + "è"]
    data, offs = common.text_buffers(pa.array([" ".join(words), "", words[0] + "\t" + words[-1].upper()]))
    hashes, rows = common.word_hashes(data, offs)
    assert len(set(hashes[: len(words)].tolist())) == len(set(words)) and rows.tolist() == [0] * len(words) + [2, 2]
    assert hashes[len(words)] == hashes[0]
    assert common.word_hashes(*common.text_buffers(pa.array(["AbC abc"])))[0].tolist()[0] == common.word_hashes(*common.text_buffers(pa.array(["abc"])))[0][0]


def test_words_that_collided(spark):
    """Two words of one arithmetic hash are two documents, and two words to a language model."""
    one, other = thue_morse(1024)
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    scores = {r.doc_id: r.log_score for r in lm.score(docs).collect()}
    assert scores[1] == pytest.approx(math.log(2 / 3)) and scores[2] == pytest.approx(math.log(1 / 3))


# --- collocations


def plain_collocations(rows, least, longest=5, top=2000, covered=100):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", small):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        phrases = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in phrases.items():
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in phrases.items())
            if not inside:
                cuts = [(1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in collocations.mine(df, **options).collect())


@pytest.mark.parametrize("options", [{"least": 2}, {"least": 3, "longest": 3, "top": 4}, {"least": 2, "covered": 60}])
def test_collocations(docs, options):
    df = docs.limit(60).select("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("lang")).alias("lang"), "text")
    rows = [(r.lang, r.text) for r in df.collect()]
    assert mined(df, **options) == plain_collocations(rows, **options) != []


def test_collocations_odd(odd, spark):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert mined(odd, least=2) == plain_collocations(rows, 2)
    assert mined(odd.withColumn("phrase", F.lit(1)).withColumn("n", F.lit(2)), least=2) == plain_collocations(rows, 2)
    assert mined(odd.limit(0), least=1) == []
    texts = [("a b a b a b, a\tb  A B.\x0bb a", "xx"), ("é È é È\x0cÀ", None), ("und und", "und"), (None, None), ("", "xx"), ("one", "yy"), ("a\x00b a\x00b", "xx"), ("w" * 9000 + " v", "xx"), ("w" * 9000 + " v", "xx")]
    df = spark.createDataFrame(texts, "text string, lang string")
    assert mined(df, least=1) == plain_collocations([(b, a) for a, b in texts], 1)


def test_collocations_of_a_long_text(spark):
    """One text of millions of words, beyond what tasks hold at once."""
    df = spark.range(1).select(F.lit("en").alias("lang"), F.concat(F.repeat(F.lit("the big red dog "), 300_000), F.lit(". the red dog")).alias("text"))
    got = {r.phrase: r for r in collocations.mine(df).collect()}
    n = 1_200_003
    assert got["big red"].a == 300_000 if "big red" in got else True
    assert got["the big red dog the"].a == 299_999 and got["the big red dog the"].n == n
    assert mined(df) == mined(df.repartition(3))


def test_collocations_with_full_filter(docs, monkeypatch):
    """A filter that lets everything through changes nothing."""
    df = docs.limit(20)
    want = mined(df, least=3)
    monkeypatch.setattr(common, "FILTER_LOG2", (6, 6))
    assert mined(df, least=3) == want


# --- mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, active = sum(sizes.values()), {}, set(sizes)
    while active:
        left = total - sum(target.values())
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in active)) for s in active}
        over = {s for s in active if share[s] > most * sizes[s]}
        target |= {s: Fraction(most * sizes[s]) for s in over} if over else share
        active = active - over if over else set()
    return target


def check_mix(df, **options):
    rows = mixing.mix(df, **options).collect()
    source = Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))) for r in df.select("doc_id", "source", "text").collect())
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == source
    sizes = defaultdict(int)
    for (_, s, n), k in source.items():
        sizes[s] += n * k
    targets, taken = plain_targets(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(targets[r.source]))
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.epochs * r["size"] + r.part and 0 <= r.part <= r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    for s in sizes:  # first documents by key, one of them cut
        own = sorted((hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r["size"], -r.part) for r in rows if r.source == s and r["size"])
        parts = [(-p, n) for _, n, p in own]
        cut = next((k for k, (p, n) in enumerate(parts) if p < n), len(parts))
        assert all(p == 0 for p, _ in parts[cut + 1 :])
    return rows


def test_mixing(docs):
    rows = check_mix(docs)
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_mixing_odd(odd, spark):
    check_mix(odd)
    assert sorted(map(str, check_mix(odd.withColumn("size", F.lit(9)).withColumn("target", F.lit(1)).withColumn("_task", F.lit(0))))) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.mix(odd.limit(0)).count() == 0
    few = [(1, "a b c", "s"), (2, "", "t"), (3, None, "u"), (4, "x", None), (5, "y y", ""), (6, " ".join("w" * 5000), "é"), (7, "z", "\U0001f600"), (8, "z", "￿")]
    check_mix(spark.createDataFrame(few, "doc_id long, text string, source string"))
    none = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(none).collect()] == [(0, 0.0)] * 2


def test_targets_of_many_sources(spark):
    """Sources stop one after the other, as what is over goes to the rest."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("w" * int(rng.integers(0, 400) ** 2 // 400)), f"s{i % 23:02}") for i in range(150)]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_mixed_texts(odd):
    rows, texts = mixing.mix(odd).collect(), mixing.mixed_texts(odd).collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0d]+", r.text)) for r in texts) == sum(r.taken for r in rows)
    whole = {r.text for r in odd.collect()}
    cut = [r for r in texts if r.text not in whole]
    assert len(cut) <= len({r.source for r in rows}) and all(any(w and w.startswith(r.text) for w in whole) for r in cut)
    assert Counter((r.doc_id, r.source) for r in texts) == sum((Counter({(r.doc_id, r.source): r.epochs + (r.part > 0)}) for r in rows if r["size"]), Counter())


# --- clustering


def plain_clusters(rows, k, rounds, n, seed="2"):
    kept = [(i, [clip(math.floor(256 * Fraction(v))) for v in x]) for i, x in rows if x is not None and len(x) == n and all(v is not None and math.isfinite(v) for v in x)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    cents = [x for _, x in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for at in range(rounds + 1):
        own = [min(range(len(cents)), key=lambda c: (far(x, cents[c]), c)) for _, x in kept]
        if at < rounds:
            for c in range(len(cents)):
                members = [x for (_, x), o in zip(kept, own) if o == c]
                if members:
                    cents[c] = [sum(v) // len(members) for v in zip(*members)]
    d = [far(x, cents[o]) for (_, x), o in zip(kept, own)]
    short = lambda v: min(v, (1 << 63) - 1)
    inertia = [short(sum(v for v, o in zip(d, own) if o == c)) for c in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((-1 if i is None else i), o, short(v), inertia[o], short(sum(d)), sha[o]) for (i, _), o, v in zip(kept, own, d))


def clip(v):
    return max(-(1 << 62), min(1 << 62, v))


def clustered(df, **options):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, clustering.cluster(df, **options).collect()))


@pytest.mark.parametrize("k,rounds", [(40, 5), (7, 9), (1, 2), (3, 0)])
def test_clustering(spark, data, k, rounds):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert clustered(df, k=k, rounds=rounds) == plain_clusters(rows, k, rounds, 64)


def test_clustering_odd(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).round(1).tolist(), "c", 1) for i in range(60)] + [(i, [0.5, 0.5, 0.5], None, 2) for i in range(60, 90)]
    rows += [(1, [1.0, 2.0], "", 3), (2, None, "", 3), (3, [], "", 3), (4, [1.0, None, 2.0], "", 3), (5, [1.0, math.nan, 2.0], "", 3), (6, [1.0, math.inf, 2.0], "", 3), (None, [9.0, 9.0, 9.0], "", 3), (None, [9.0, 9.0, 8.0], "", 3), (7, rows[7][1], "x", 4), (7, [5.0, 5.0, 5.0], "x", 4)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType()), T.StructField("distance", T.LongType())])
    df = spark.createDataFrame(rows, schema).repartition(4)
    for k in (4, 200):
        assert clustered(df, k=k, dimensions=3, rounds=6) == plain_clusters([(a, b) for a, b, *_ in rows], k, 6, 3)
    assert clustered(df.limit(0), dimensions=3) == [] and clustered(df, dimensions=17) == []
    large = [(i, [float(x) for x in rng.integers(-9, 9, 2) * 10.0 ** (4 * (i % 5))]) for i in range(40)] + [(50, [1e300, -1e308]), (51, [2.0**53, 3.0]), (52, [2.0**54, -(2.0**54)])]
    assert clustered(spark.createDataFrame(large, "vec_id long, embedding array<double>"), k=5, dimensions=2) == plain_clusters(large, 5, 5, 2)


def test_bounds_spare_scans(spark):
    """With clusters that lie apart, most vectors of a later round meet their own centroid at most."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(2000, 16)) * 10 + rng.integers(-20, 20, (20, 16))[rng.integers(0, 20, 2000)] * 100).astype(np.int64)
    points = [p.tolist() for p in x[:20]]
    cluster, upper, lower, scanned, before = np.full(2000, -1, np.int32), np.full(2000, np.inf), np.full(2000, -np.inf), [], None
    for _ in range(6):
        cent = clustering.Centroids(points, before)
        cluster, upper, lower, n = clustering.step(x, np.array(points), cent, cluster, upper, lower)
        far = clustering.all_distances(x, np.array(points))
        assert (cluster == far.argmin(1)).all() and (upper**2 >= far.min(1) * (1 - 1e-9)).all()
        scanned.append(n)
        before, points = points, [(x[cluster == c].sum(0) // (cluster == c).sum()).tolist() if (cluster == c).any() else points[c] for c in range(20)]
    assert scanned[0] == 2000 and scanned[-1] < 400
