"""Group metrics on made groups, against a model in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics as M


def model(rows):
    """rows: (key, ok) in order."""
    first = [r for r in rows if r[0].split(":")[1] == "original"]
    rest = [r for r in rows if r[0].split(":")[1] != "original"]
    groups = {b: {} for b in ("all", "original", *M.KINDS)}
    for key, ok in first + rest:
        root, kind = key.split(":")[:2]
        for b in ("all", "original", *M.KINDS) if kind == "original" else [x for x in ("all", kind) if x in ("all", "original", *M.KINDS)]:
            groups[b].setdefault(root, []).append(ok)

    def share(b, f):
        return sum(map(f, groups[b].values())) / len(groups[b]) if groups[b] else None

    out = {"reliable_at_k_all": share("all", lambda g: sum(g) == 10), "reliable_at_k_original": share("original", lambda g: sum(g) == 1)}
    for b in M.KINDS:
        for k in (2, 4):
            out[f"{b}_at_{k}"] = share(b, lambda g: sum(g[:k]) == k)
    return out


def made(seed, roots=40):
    rng = random.Random(seed)
    rows = []
    for root in range(roots):
        keys = [f"{root}:original"] + [f"{root}:{k}:{i}" for k in M.KINDS for i in range(1, 4)]
        if root % 7 == 0:
            keys = keys[1:]
        if root % 5 == 0:
            keys.append(f"{root}:strange:1")
        if root % 11 == 0:
            keys.append(f"{root}:original:2")
        rows += [(k, rng.random() < (1 if root % 3 else 0.8)) for k in keys]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_reliable(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(p, k, ok) for p, (k, ok) in enumerate(rows)], "pos long, key string, ok boolean").repartition(3)
    got = {r.metric: r.value for r in M.reliable_at_k(df).collect()}
    assert got == pytest.approx(model(rows))


def test_exactly_ten(spark):
    rows = [(p, f"{g}:rephrasing:{p}", True) for g, n in enumerate((9, 10, 11)) for p in range(n)]
    df = spark.createDataFrame(rows, "pos long, key string, ok boolean")
    got = {r.metric: r.value for r in M.reliable_at_k(df, mode="flag").collect()}
    assert got["reliable_at_k_all"] == pytest.approx(1 / 3) and got["reliable_at_k_original"] is None
    with pytest.raises(Exception):
        M.reliable_at_k(df).collect()
    with pytest.raises(Exception):
        M.reliable_at_k(df.withColumn("key", F.lit("7"))).collect()


def test_sampled(spark):
    rng = random.Random(4)
    rows = [(k, f"x--kk--{i}", ok) for i in range(3) for k, ok in made(7)]
    rng.shuffle(rows)
    rows = [(p, k, prompt, rng.random() < 0.7) for p, (k, prompt, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "pos long, key string, prompt string, ok boolean").repartition(3)
    got = {(r.n, r.metric): r.value for r in M.sampled_reliability(df).collect()}
    seen = {}
    for _, k, _, ok in rows:
        seen.setdefault(k, []).append(ok)
    for n in range(1, 4):
        want = model([(k, any(v[:n])) for k, v in seen.items()])
        assert {m: v for (x, m), v in got.items() if x == n} == pytest.approx(want)


def test_sampled_beyond_the_samples(spark):
    """Numbers that run past the samples, keys with more samples than the numbers, and groups that stop counting."""
    rng = random.Random(9)
    rows = [(k, f"x--kk--{n}", rng.random() < 0.3) for k, _ in made(8, 12) for n in range(rng.choice((1, 2, 5)))]
    rows += [(f"{r}:rephrasing:{i}", "x--kk--0", False) for r in range(3) for i in range(9, 12)]
    rows = [(p, *r) for p, r in enumerate(rows)] + [(len(rows), "0:original", "x--kk--6", True)]
    df = spark.createDataFrame(rows, "pos long, key string, prompt string, ok boolean").repartition(3)
    got = {(r.n, r.metric): r.value for r in M.sampled_reliability(df).collect()}
    seen = {}
    for _, k, _, ok in rows:
        seen.setdefault(k, []).append(ok)
    assert {n for n, _ in got} == set(range(1, 8))
    for n in range(1, 8):
        want = model([(k, any(v[:n])) for k, v in seen.items()])
        assert {m: v for (x, m), v in got.items() if x == n} == pytest.approx(want)
    assert M._logged(M.sampled_steps(df).collect()) == {n: {m: pytest.approx(v) for (x, m), v in got.items() if x == n} for n in range(1, 8)}


def test_sampled_with_a_large_number(spark):
    """One odd number in a prompt makes rows to write, not work for each key."""
    rows = [(i, f"{i}:{kind}", f"x--kk--{3_000_000 if i == 5 else 0}", i % 2 == 0) for i, kind in enumerate(("original", "rephrasing", "distractor", "ct_alteration") * 50)]
    df = spark.createDataFrame(rows, "pos long, key string, prompt string, ok boolean")
    steps = M.sampled_steps(df).collect()
    assert {r["stop"] for r in steps} == {3_000_002} and len(steps) == 8
    assert M._logged(steps)[3_000_001] == M._logged(steps)[1]
    assert M.sampled_reliability(df).count() == 8 * 3_000_001


def test_drop(spark):
    df = spark.createDataFrame([("reliable_at_k_all", 0.3), ("reliable_at_k_original", 0.6)], "metric string, value double")
    assert M.relative_drop(df).first()[0] == pytest.approx(0.5)
    assert M.relative_drop(df.withColumn("value", F.lit(0.0))).first()[0] is None
