"""Accuracy of prompts, instructions and categories, and reliability over groups of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key_root, key_type, sampling_id

#: Labels of variants in keys.
KINDS = ("ct_alteration", "rephrasing", "distractor")
#: Flags that are true in a group that counts as reliable as a whole: the original, and three variants of each kind.
WHOLE = 10


def flags(outputs: DataFrame) -> DataFrame:
    """instruction_id, ok of each instruction; the shorter list decides."""
    pairs = F.arrays_zip(F.col("instruction_id_list").alias("id"), F.col("follow_instruction_list").alias("ok"))
    df = outputs.select(F.posexplode(pairs).alias("i", "x"), F.least(F.size("instruction_id_list"), F.size("follow_instruction_list")).alias("n")).where("i < n")
    return df.select(F.col("x.id").alias("instruction_id"), F.col("x.ok").alias("ok"))


def share(ok: Column | str) -> Column:
    return F.avg((F.col(ok) if isinstance(ok, str) else ok).cast("int"))


def prompt_accuracy(outputs: DataFrame) -> DataFrame:
    return outputs.agg(share(F.forall("follow_instruction_list", lambda x: x)).alias("accuracy"))


def instruction_accuracy(outputs: DataFrame) -> DataFrame:
    return flags(outputs).agg(share("ok").alias("accuracy"))


def category_accuracy(outputs: DataFrame) -> DataFrame:
    """By what stands before the colon of an id, in order of name."""
    return flags(outputs).groupBy(F.split_part("instruction_id", F.lit(":"), F.lit(1)).alias("category")).agg(share("ok").alias("accuracy")).orderBy("category")


def id_accuracy(outputs: DataFrame) -> DataFrame:
    return flags(outputs).groupBy("instruction_id").agg(share("ok").alias("accuracy")).orderBy("instruction_id")


def _placed(rows: DataFrame, kinds: tuple[str, ...], *columns: str) -> DataFrame:
    """``columns`` of rows(pos, root, type) with each bucket that a row counts in, and its place ``rn`` in its group: originals first, then the order of the input."""
    every = F.array(*map(F.lit, ("all", "original", *kinds)))
    buckets = F.array_intersect(F.when(F.col("type") == "original", every).otherwise(F.array(F.lit("all"), F.col("type"))), every)
    order = Window.partitionBy("bucket", "root").orderBy((F.col("type") != "original").cast("int"), "pos")
    return rows.select("pos", "root", "type", *columns, F.explode(buckets).alias("bucket")).select("bucket", "root", *columns, F.row_number().over(order).alias("rn"))


def _reliable(rows: DataFrame, kinds: tuple[str, ...], whole_group: int) -> DataFrame:
    """metric, value from rows(pos, root, type, ok). A bucket without groups has no rows."""
    yes = F.col("ok").cast("int")
    groups = _placed(rows, kinds, "ok").groupBy("bucket", "root").agg(F.sum(yes).alias("total"), *[F.sum(F.when(F.col("rn") <= k, yes).otherwise(0)).alias(f"n{k}") for k in (2, 4)])
    whole = F.when(F.col("bucket") == "all", F.col("total") == whole_group).otherwise(F.col("total") == 1)
    shares = groups.groupBy("bucket").agg(share(whole).alias("whole"), share(F.col("n2") == 2).alias("at_2"), share(F.col("n4") == 4).alias("at_4"))
    return shares.select(F.inline(_by_metric("whole", "at_2", "at_4", "value")))


def _by_metric(whole: str, at_2: str, at_4: str, name: str) -> Column:
    """An array of (metric, value) of a bucket."""
    one = lambda metric, value: F.struct(metric.alias("metric"), F.col(value).alias(name))
    ends = F.array(*[one(F.concat("bucket", F.lit(f"_at_{k}")), c) for k, c in ((2, at_2), (4, at_4))])
    of = lambda bucket: F.array(one(F.lit(f"reliable_at_k_{bucket}"), whole))
    return F.when(F.col("bucket") == "all", of("all")).when(F.col("bucket") == "original", of("original")).otherwise(ends)


def _steps(keys: DataFrame, kinds: tuple[str, ...], whole_group: int, top: int) -> DataFrame:
    """metric, n, stop, value: each metric as a step function of the number of samples, from rows(pos, root, type, first), first being the sample from which a row follows.

    A group's metric holds in one range of n, from one row's first to another's;
    so each group gives two changes, and the running sums of all changes are the steps.
    """
    never = top + 2
    rows = _placed(keys, kinds, "first")
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "root").orderBy("first")))
    wanted = F.when(F.col("bucket") == "all", whole_group).otherwise(1)

    def until(k: int) -> Column:
        """The sample from which the group's first k rows all follow."""
        own = F.col("rn") <= k
        return F.when(F.count(F.when(own, 1)) == k, F.max(F.when(own, F.col("first")))).otherwise(F.lit(never).cast("long"))

    at = lambda place: F.coalesce(F.max(F.when(F.col("nth") == place, F.col("first"))), F.lit(never))
    groups = ranked.groupBy("bucket", "root").agg(F.struct(at(wanted).alias("from"), at(wanted + 1).alias("to")).alias("whole"), *[F.struct(until(k).alias("from"), F.lit(never).cast("long").alias("to")).alias(f"at_{k}") for k in (2, 4)])
    spans = groups.select(F.inline(_by_metric("whole", "at_2", "at_4", "span")))
    change = lambda n, by: F.struct(n.cast("long").alias("n"), F.lit(by).alias("by"), F.lit(by == 0).cast("int").alias("group"))
    changes = spans.select("metric", F.inline(F.array(change(F.lit(1), 0), change(F.col("span.from"), 1), change(F.col("span.to"), -1)))).where(F.col("n") < never)
    points = changes.groupBy("metric", "n").agg(F.sum("by").alias("by"), F.sum("group").alias("groups"))  # as many as samples of one key, at most, a metric
    order = Window.partitionBy("metric").orderBy("n")
    holds, groups = F.sum("by").over(order), F.max("groups").over(Window.partitionBy("metric"))
    return points.select("metric", "n", F.coalesce(F.lead("n").over(order), F.lit(never)).alias("stop"), (holds / groups).alias("value"))


#: Numbers of samples that one row of a step is spread to at once.
SPREAD = 10_000


def metric_names(kinds: tuple[str, ...] = KINDS) -> list[str]:
    return ["reliable_at_k_all", "reliable_at_k_original", *[f"{k}_at_{n}" for k in kinds for n in (2, 4)]]


def _typed(rows: DataFrame, mode: str) -> DataFrame:
    kind = key_type(F.col("key"))
    if mode == "failfast":
        kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("no type in key "), "key")))
    return rows.withColumn("root", key_root(F.col("key"))).withColumn("type", F.coalesce(kind, F.lit("")))


def reliable_at_k(rows: DataFrame, mode: str = "failfast", kinds: tuple[str, ...] = KINDS, whole: int = WHOLE) -> DataFrame:
    """metric, value of rows(pos, key, ok). A metric without groups is null; failfast: an error.

    ``kinds``: the labels of variants that get metrics of their own. ``whole``:
    how many rows of a group must follow for the group to count.
    """
    found = _reliable(_typed(rows, mode), kinds, whole)
    every = rows.sparkSession.createDataFrame([(m,) for m in metric_names(kinds)], "metric string")
    out = every.join(found, "metric", "left")
    if mode == "failfast":
        out = out.withColumn("value", F.coalesce("value", F.raise_error(F.concat(F.lit("no groups for "), "metric")).cast("double")))
    return out


def sampled_steps(rows: DataFrame, mode: str = "failfast") -> DataFrame:
    """metric, n, stop, value of rows(pos, key, prompt, ok): reliability when a key counts as followed if any of its first n samples is.

    A row holds from n on, up to but not with stop. n runs to the largest
    sampling number in a prompt plus one. Without originals their metric is 0;
    others without groups are null, with failfast an error. The work grows with
    the samples, whatever numbers the prompts have.
    """
    top = rows.agg(F.max(sampling_id(F.col("prompt")))).first()[0]  # one number
    if top is None:
        if mode == "failfast":
            raise ValueError("no sampling numbers in the prompts")
        top = 0
    samples = rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("pos")))
    keys = samples.groupBy("key").agg(F.min("pos").alias("pos"), F.coalesce(F.min(F.when(F.col("ok"), F.col("rn"))), F.lit(top + 2)).cast("long").alias("first"))
    steps = _steps(_typed(keys, mode), KINDS, WHOLE, top)
    every = rows.sparkSession.createDataFrame([(m,) for m in metric_names()], "metric string")
    out = every.join(steps, "metric", "left").select("metric", F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.coalesce("stop", F.lit(top + 2).cast("long")).alias("stop"), "value")
    out = out.withColumn("value", F.when(F.col("metric") == "reliable_at_k_original", F.coalesce("value", F.lit(0.0))).otherwise(F.col("value")))
    if mode == "failfast":
        out = out.withColumn("value", F.coalesce("value", F.raise_error(F.concat(F.lit("no groups for "), "metric")).cast("double")))
    return out


def sampled_reliability(rows: DataFrame, mode: str = "failfast") -> DataFrame:
    """n, metric, value: the steps of ``sampled_steps`` with a row for every n."""
    parts = sampled_steps(rows, mode).select("metric", "value", "stop", F.explode(F.sequence(F.col("n"), F.col("stop") - 1, F.lit(SPREAD).cast("long"))).alias("begin"))
    return parts.repartition("metric", "begin").select(F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + SPREAD, F.col("stop")) - 1)).alias("n"), "metric", "value").withColumn("n", F.col("n").cast("int"))


def relative_drop(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """1 - all / original; null where original is 0."""
    by = by or []
    of = [F.max(F.when(F.col("metric") == m, F.col("value"))) for m in metric_names()[:2]]
    return metrics.groupBy(*by).agg((1 - F.try_divide(of[0], of[1])).alias("relative_drop"))


def _logged(steps: list) -> dict:
    """Each metric for every number of samples; beyond SPREAD of them, for those at which one changes, and the last."""
    last = max(r["stop"] for r in steps) - 1
    numbers = range(1, last + 1) if last <= SPREAD else sorted({r["n"] for r in steps} | {last})
    at = {n: k for k, n in enumerate(numbers)}
    out: dict = {n: {} for n in numbers}
    for r in steps:
        for n in numbers[at[r["n"]] : at.get(r["stop"], len(numbers))]:
            out[n][r["metric"]] = r["value"]
    return out


def report(outputs: DataFrame, mode: str = "auto") -> dict:
    """The log of an evaluation: a few numbers, gathered from aggregates.

    mode: "sampling", "reliable" or "none" choose the group metrics; "auto"
    takes the first of these that the keys and prompts allow.
    """
    outputs = outputs.select("pos", "key", "prompt" if mode in ("auto", "sampling") else F.lit("").alias("prompt"), "instruction_id_list", "follow_all_instructions", "follow_instruction_list").persist()
    try:
        out = {
            "prompt_level_accuracy": prompt_accuracy(outputs).first()[0],
            "instruction_level_accuracy": instruction_accuracy(outputs).first()[0],
            "tier0": {r[0]: r[1] for r in category_accuracy(outputs).collect()},
            "tier1": {r[0]: r[1] for r in id_accuracy(outputs).collect()},
        }
        rows = outputs.select("pos", "key", "prompt", F.col("follow_all_instructions").alias("ok"))
        for kind in {"auto": ("sampling", "reliable")}.get(mode, (mode,)):
            if kind == "none":
                break
            try:
                if kind == "sampling":
                    found = _logged(sampled_steps(rows).collect())
                else:
                    found = {r["metric"]: r["value"] for r in reliable_at_k(rows).collect()}
            except Exception:
                if mode != "auto":
                    raise
                continue
            out["reliable_at_k"] = found
            break
        return out
    finally:
        outputs.unpersist()


def formatted(log: dict) -> str:
    """The report as text."""
    lines = [f"prompt-level: {log['prompt_level_accuracy']}", f"instruction-level: {log['instruction_level_accuracy']}", ""]
    for tier in ("tier0", "tier1"):
        lines += [f"{k} {v}" for k, v in sorted(log[tier].items())] + [""]
    return "\n".join(lines)
