import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import ngram_join as N


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = word_list(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """rows: (doc_id, text); by place: size and component's least id."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                shared[b, a] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), len(s), str(least.get(root(k)))) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in N.near_duplicates(df).collect())


def test_documents(docs, texts):
    assert result(docs) == brute(list(texts.items()))


def test_odd_rows(odd):
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_empty(odd):
    assert N.near_duplicates(odd.limit(0)).count() == 0
    assert N.keep_one(odd.limit(0)).count() == 0


def test_groups_without_a_centre(spark, monkeypatch):
    """Near copies of which many pairs don't link; small blocks and parts, so that all ways are taken."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5, 6, 9])):
            own[k] = f"e{rng.randrange(400)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base[:60] + [f"{i}-{k}" for k in range(60)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(N, "PART_ROWS", 50)
    assert result(df) == brute(rows)


def test_keep_one(odd):
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 4 in ids and 3 in ids


def test_keep_one_by_row(spark, odd):
    """Null and repeated ids with unlike texts: one row of each component stays, and nothing else goes."""
    kept = [(r.doc_id, r.text) for r in N.keep_one(odd).collect()]
    assert (None, None) in kept and (None, "short text") not in kept and (-9, "short text") in kept
    assert [i for i, _ in kept].count(3) == 1 and 4 in [i for i, _ in kept] and 7 in [i for i, _ in kept]
    a, b, c, d, e, f = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcdef")
    rows = [
        (1, a, "x"), (2, a + " more", "x"), (1, b, "x"), (3, b + " more", "x"),  # one id heads two components
        (2, c, "x"), (None, c + " more", "x"),  # 2 goes above, and stays here
        (None, d, "x"), (None, d + " more", "x"), (None, e, "x"),  # null ids only
        (9, f, "z"), (9, f, "y"), (9, f + " more", "y"), (9, "", "x"), (9, None, "x"), (None, " ", "x"),
    ]
    for parts in (1, 4):
        got = [tuple(r) for r in N.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)).collect()]
        heads = sorted((str(i), t[0]) for i, t, _ in got if t and t.strip())
        assert heads == [("1", "a"), ("1", "b"), ("2", "c"), ("9", "f"), ("None", "d"), ("None", "e")]
        assert (1, a, "x") in got and (1, b, "x") in got and (2, c, "x") in got and (9, f, "z") not in got
        assert [t for _, t, _ in got if not (t and t.strip())].count(None) == 1 and len(got) == 9


def test_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64)]))
        if len(np.intersect1d(a, b)) * 7 >= 3 * (len(a) + len(b)):
            assert N._pair_bound(N.count_vector(a), len(a), N.count_vector(b), len(b))


def test_tree_finds_what_all_pairs_do():
    rng = np.random.default_rng(2)
    sizes = rng.integers(60, 120, 300)
    points = np.stack([rng.multinomial(n, np.ones(16) / 16) for n in sizes])
    points[1::2] = points[::2]
    sizes[1::2] = sizes[::2]
    labels = np.arange(300)
    got = {frozenset(p) for i, j, _ in N.CountTree(sizes, sizes, points, labels).pairs() for p in zip(i.tolist(), j.tolist())}
    want = {frozenset((i, j)) for i in range(300) for j in range(i) if 4 * min(sizes[i], sizes[j]) >= 3 * max(sizes[i], sizes[j]) and 7 * np.minimum(points[i], points[j]).sum() >= 3 * (sizes[i] + sizes[j])}
    assert got == want
