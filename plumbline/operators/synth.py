"""Variants of prompts and responses by an injected client; judging, filtering and resuming.

A client is any callable from a list of requests (a list of messages each) to a
list of replies, or None for a reply that failed. It runs on the executors, a
batch of a partition at a time; ``offline_client`` stands in for one.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import key_root
from ..sources import jsonl
from ..sources.jsonl import JUDGEMENT
from .checkers import DESCRIPTIONS, kwargs_schema
from .durable import BATCH_ROWS, in_batches

Client = Callable[[list[list[dict]]], list[str | None]]

#: kind: (label in keys, variants, how many a request asks for, what it asks)
KINDS = {
    "rephrasing": ("rephrasing", 24, 8, "Word the request below anew. What it wants done stays the same, and so does each of its constraints, argument for argument; change vocabulary, order and tone, and let no two versions read alike. Answer with a JSON array of strings."),
    "distractor": ("distractor", 8, 8, "Add one more constraint to the request below, of a kind that it doesn't have. It must be easy to meet, must not contradict or replace the constraints that are there, and must leave the task as it is. Answer with a JSON array of strings, each a whole request."),
    "task": ("ct_alteration", 8, 8, "Put another task in place of the one below: another topic or kind of text. Keep each constraint with its arguments, in words that fit the new task, and make sure that the two go together. Answer with a JSON array of strings, each a whole request."),
    "fillin": ("ct_alteration", 8, 8, "Give the constraints below other arguments, of the same types and just as hard, and change the request's words to match. The task stays. Answer with JSON: an object whose outputs each have random_seed, reasoning, revised_prompt, revised_instruction_id_list and revised_kwargs, the last as a JSON string."),
}
#: Kinds whose variants take the place of what a target holds; others are added to it.
REPLACED = ("distractor",)
JUDGE = 'Read the request below with its constraints. Decide whether one response can do the task and meet every constraint at once, and whether the words of the request say just these constraints. Answer with JSON: {"reasoning": ..., "is_valid": ...}'
REVISED = "array<struct<random_seed:string,reasoning:string,revised_prompt:string,revised_instruction_id_list:array<string>,revised_kwargs:string>>"
VERDICT = "struct<reasoning:string,is_valid:boolean>"
FAILED = "judge failed"


def offline_client(requests: list[list[dict]]) -> list[str | None]:
    """A reply that depends on the request alone."""
    return [blake2b(r[-1]["content"].encode(), digest_size=8).hexdigest() for r in requests]


def messages(content: Column, system: str | None = None) -> Column:
    """A user's turn, after a system's where there is one."""

    def turn(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    own = turn("user", content)
    return F.array(turn("system", F.lit(system)), own) if system else F.array(own)


def parse_model(name: str) -> tuple[str, bool]:
    """(model, whether it may think) of a model's name."""
    return (name.replace("-no-think", ""), False) if "-no-think" in name else (name, True)


class ChatClient:
    """A client for servers with a chat-completions interface; ``workers`` requests of a batch at a time.

    ``choices`` replies to a request are given as one JSON array. A request that
    fails is None.
    """

    def __init__(self, model: str, base_url: str, api_key: str = "EMPTY", temperature: float = 0.0, effort: str | None = None, choices: int = 1, schema: dict | None = None, workers: int = 16, timeout: float = 600.0):
        name, thinks = parse_model(model)
        self.body: dict = {"model": name, "temperature": temperature}
        if effort:
            self.body["reasoning_effort"] = effort
        if not thinks:
            self.body["chat_template_kwargs"] = {"enable_thinking": False}
        if choices > 1:
            self.body["n"] = choices
        if schema:
            self.body["response_format"] = {"type": "json_schema", "json_schema": {"name": "reply", "schema": schema}}
        self.url, self.api_key, self.workers, self.timeout = f"{base_url.rstrip('/')}/chat/completions", api_key, workers, timeout

    def one(self, messages: list[dict]) -> str | None:
        data = json.dumps(self.body | {"messages": messages}).encode()
        request = urllib.request.Request(self.url, data, {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                texts = [(c["message"].get("content") or "").strip() for c in json.load(reply)["choices"]]
        except (OSError, ValueError, KeyError, TypeError):
            return None
        return json.dumps(texts, ensure_ascii=False) if self.body.get("n") else texts[0] if texts else None

    def __call__(self, requests: list[list[dict]]) -> list[str | None]:
        with ThreadPoolExecutor(self.workers) as pool:
            return list(pool.map(self.one, requests))


def client_from_env(model: str, kind: str = "vllm", port: int = 8102, **options) -> ChatClient:
    """A client by the usual environment variables: a server of one's own, or with "oai" a hosted one, which needs a key."""
    if kind == "vllm":
        return ChatClient(model, os.environ.get("VLLM_BASE_URL", f"http://localhost:{port}/v1"), os.environ.get("VLLM_API_KEY", "EMPTY"), **options)
    if kind != "oai":
        raise ValueError(f"unknown kind of client {kind!r}")
    key = os.environ.get("OPENAI_API_KEY") or os.environ.get("OAI_API_KEY")
    if not key:
        raise ValueError("OPENAI_API_KEY or OAI_API_KEY must be set")
    return ChatClient(model, os.environ.get("OAI_BASE_URL", "https://api.openai.com/v1"), key, **options)


#: Requests that a client gets together; one that raises has failed for these alone.
TOGETHER = 64


def complete(df: DataFrame, client: Client, messages_col: str = "messages", reply_col: str = "reply", retries: int = 0, workers: int | None = None) -> DataFrame:
    """``df`` with a reply to each row's messages; null where the client failed, after ``retries`` more tries."""
    if workers:
        df = df.repartition(workers)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != messages_col), f"`{reply_col}` string"])

    def asked(requests: list) -> list[str | None]:
        replies: list[str | None] = [None] * len(requests)
        for _ in range(retries + 1):
            left = [k for k, r in enumerate(replies) if r is None]
            if not left:
                break
            try:
                got = client([requests[k] for k in left])
            except Exception:  # a client that raises has failed for these
                continue
            for k, r in zip(left, got):
                replies[k] = r
        return replies

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            requests = [[dict(m) if isinstance(m, dict) else m.asDict() for m in own] for own in rows[messages_col]]
            replies = [r for k in range(0, len(requests), TOGETHER) for r in asked(requests[k : k + TOGETHER])]
            yield rows.drop(columns=[messages_col]).assign(**{reply_col: replies})

    return df.mapInPandas(run, schema)


def resume(prompts: DataFrame, done: DataFrame) -> DataFrame:
    """Prompts whose key isn't among those completed."""
    return prompts.join(done.select("key").distinct(), "key", "left_anti")


def generate(prompts: DataFrame, client: Client, done: DataFrame | None = None, system: str | None = None, retries: int = 0, workers: int | None = None) -> DataFrame:
    """key, prompt, response for prompts that aren't done; failed ones are left out, to be tried by the next run."""
    rows = resume(prompts, done) if done is not None else prompts
    rows = rows.select("key", "prompt", messages(F.col("prompt"), system).alias("messages"))
    return complete(rows, client, reply_col="response", retries=retries, workers=workers).where("response is not null")


def describe(ids: Column, kwargs: Column) -> Column:
    """The constraints of a prompt as text: a description and the arguments of each."""
    known = F.create_map(*[x for k, v in DESCRIPTIONS.items() for x in (F.lit(k), F.lit(v.split("\n")[0]))])
    lines = F.transform(F.arrays_zip(ids.alias("id"), kwargs.alias("args")), lambda x: F.concat_ws(" ", F.lit("-"), x["id"], F.coalesce(F.try_element_at(known, x["id"]), F.lit("")), F.to_json(x["args"])))
    return F.array_join(lines, "\n")


def render(kind: str, prompt: Column, ids: Column, kwargs: Column, count: int) -> Column:
    return F.concat(F.lit(f"{KINDS[kind][3]} Give {count} versions.\n\nConstraints:\n"), describe(ids, kwargs), F.lit("\n\nRequest:\n"), prompt)


def variant_key(key: Column, label: str | Column, index: Column) -> Column:
    return F.concat_ws(":", key.cast("string"), F.lit(label) if isinstance(label, str) else label, index.cast("string"))


def keyed_variants(df: DataFrame, variants: str, label: str) -> DataFrame:
    """A row for each entry of an array of prompts: keys numbered from 1, and the prompt they come from."""
    df = df.select("*", F.posexplode(variants).alias("__i", "__v")).drop(variants)
    return df.withColumn("original_prompt", F.col("prompt")).withColumn("key", variant_key(F.col("key"), label, F.col("__i") + 1)).withColumn("prompt", F.col("__v")).drop("__i", "__v")


def generate_into(prompts: DataFrame, client: Client, out: str, system: str | None = None, retries: int = 0, tasks: int = 8, batch_rows: int = BATCH_ROWS) -> None:
    """Append responses to the prompts that ``out`` has none for, batch by batch: a run that is stopped keeps the batches before."""
    spark = prompts.sparkSession
    todo = resume(prompts, jsonl.completed_keys(spark, out)) if jsonl.exists(spark, out) else prompts
    in_batches(todo.select("key", "prompt"), lambda part: generate(part, client, system=system, retries=retries), out, tasks, batch_rows)


def synthesise_into(prompts: DataFrame, kind: str, client: Client, out: str, keep: bool = False, retries: int = 3, tasks: int = 8, batch_rows: int = BATCH_ROWS) -> None:
    """Append variants of ``prompts`` to ``out``, batch by batch; distractors take the place of what is there.

    ``keep``: go on with a run that was stopped; nothing is removed, and
    variants that are there aren't asked for.
    """
    spark = prompts.sparkSession
    if not keep and kind in REPLACED:
        jsonl.remove(spark, out)
    asked = requests_for(prompts, kind)
    if keep and jsonl.exists(spark, out):
        first = variant_key(F.col("key"), KINDS[kind][0], F.col("__batch") + 1)
        asked = asked.withColumn("__first", first).join(jsonl.completed_keys(spark, out).select(F.col("key").alias("__first")), "__first", "left_anti").drop("__first")
    in_batches(asked, lambda part: variants_of(part, kind, client, retries), out, tasks, batch_rows)


def judge_into(prompts: DataFrame, client: Client, annotated: str, valid: str, keep: bool = False, retries: int = 0, tasks: int = 8, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``prompts`` with their verdicts to ``annotated``, batch by batch, and the valid ones to ``valid``; root, valid of what was kept.

    ``keep``: go on with a run that was stopped, without judging again what is
    annotated; otherwise both places are written anew.
    """
    spark = prompts.sparkSession
    if not keep:
        jsonl.remove(spark, annotated)
    todo = resume(prompts, jsonl.completed_keys(spark, annotated)) if jsonl.exists(spark, annotated) else prompts
    in_batches(todo, lambda part: judge(part, client, retries), annotated, tasks, batch_rows)
    schema = T.StructType([*prompts.schema.fields, T.StructField(JUDGEMENT, T._parse_datatype_string(VERDICT))])
    judged = spark.read.schema(schema).json(annotated) if jsonl.exists(spark, annotated) else spark.createDataFrame([], schema)
    valid_rows(judged).write.mode("overwrite").json(valid)
    return valid_by_root(judged)


def requests_for(prompts: DataFrame, kind: str) -> DataFrame:
    """``prompts`` with a row for each request, whose first variant is number ``__batch`` + 1."""
    _, total, step, _ = KINDS[kind]
    return prompts.select("*", F.explode(F.sequence(F.lit(0), F.lit(total - 1), F.lit(step))).alias("__batch"))


def synthesise(prompts: DataFrame, kind: str, client: Client, retries: int = 3) -> DataFrame:
    """Variants of each prompt by one of KINDS: replies are JSON arrays of prompts, typed ones for "fillin".

    A prompt is asked for in batches; variants are numbered through them. A
    reply with fewer than asked for is asked for again. What fails after
    ``retries`` more tries is missing.
    """
    return variants_of(requests_for(prompts, kind), kind, client, retries)


def variants_of(asked: DataFrame, kind: str, client: Client, retries: int = 3) -> DataFrame:
    """The variants that rows of ``requests_for`` ask for."""
    label, _, step, _ = KINDS[kind]
    if kind == "fillin":
        return synthesise_fillin(asked.drop("__batch"), client, retries)
    request = F.concat(render(kind, F.col("prompt"), F.col("instruction_id_list"), F.col("kwargs"), step), F.lit("\n\nBatch "), F.col("__batch").cast("string"))

    def checked(requests: list[list[dict]]) -> list[str | None]:
        return [reply if reply is not None and _versions(reply) >= step else None for reply in client(requests)]

    replies = complete(asked.withColumn("messages", messages(request)), checked, retries=retries).where("reply is not null")
    one = replies.select("*", F.posexplode(F.slice(F.from_json("reply", "array<string>"), 1, step)).alias("__i", "__v"))
    own = [c for c in asked.columns if c not in ("key", "prompt", "__batch")]
    return one.select(variant_key(F.col("key"), label, F.col("__batch") + F.col("__i") + 1).alias("key"), F.col("__v").alias("prompt"), *own, F.col("prompt").alias("original_prompt"))


def _versions(reply: str) -> int:
    try:
        found = json.loads(reply)
    except ValueError:
        return 0
    return len(found) if isinstance(found, list) and all(isinstance(x, str) for x in found) else 0


def synthesise_fillin(prompts: DataFrame, client: Client, retries: int = 3) -> DataFrame:
    """Variants with other arguments: the reply is typed JSON with prompts, ids and arguments.

    A version whose arguments don't parse is left out; a reply that doesn't is
    asked for again, ``retries`` times.
    """
    request = render("fillin", F.col("prompt"), F.col("instruction_id_list"), F.col("kwargs"), KINDS["fillin"][1])

    def checked(requests: list[list[dict]]) -> list[str | None]:
        out: list[str | None] = []
        for reply in client(requests):
            try:
                found = json.loads(reply or "null")["outputs"]
                out.append(reply if len(found) >= KINDS["fillin"][1] and all(isinstance(json.loads(x["revised_kwargs"]), list) for x in found) else None)
            except (ValueError, KeyError, TypeError):
                out.append(None)
        return out

    replies = complete(prompts.withColumn("messages", messages(request)), checked, retries=retries).where("reply is not null")
    one = replies.select("*", F.posexplode(F.from_json("reply", f"struct<outputs:{REVISED}>")["outputs"]).alias("__i", "__v"))
    args = F.from_json("__v.revised_kwargs", f"array<{kwargs_schema().simpleString()}>")
    changed = {"key", "prompt", "instruction_id_list", "kwargs"}
    return one.select(
        variant_key(F.col("key"), KINDS["fillin"][0], F.col("__i") + 1).alias("key"), F.col("__v.revised_prompt").alias("prompt"), F.col("__v.revised_instruction_id_list").alias("instruction_id_list"), args.alias("kwargs"),
        *[c for c in prompts.columns if c not in changed], F.col("prompt").alias("original_prompt"), F.col("instruction_id_list").alias("original_instruction_id_list"), F.col("kwargs").alias("original_kwargs"),
    )


def judge_request(prompt: Column, ids: Column, kwargs: Column) -> Column:
    return F.concat(F.lit(f"{JUDGE}\n\n"), describe(ids, kwargs), F.lit("\n\n"), prompt)


def judge(prompts: DataFrame, client: Client, retries: int = 0) -> DataFrame:
    """``prompts`` with a verdict on each; a reply that fails or doesn't parse counts as not valid."""
    request = judge_request(F.col("prompt"), F.col("instruction_id_list"), F.col("kwargs"))
    replies = complete(prompts.withColumn("messages", messages(request)), client, retries=retries)
    verdict = F.from_json("reply", VERDICT)
    failed = F.struct(F.lit(FAILED).alias("reasoning"), F.lit(False).alias("is_valid"))
    return replies.withColumn(JUDGEMENT, F.when(verdict["is_valid"].isNotNull(), verdict).otherwise(failed)).drop("reply")


def valid_rows(judged: DataFrame) -> DataFrame:
    """Rows that a judge found valid without failing."""
    verdict = F.col(f"`{JUDGEMENT}`")
    return judged.where(verdict["is_valid"] & ~verdict["reasoning"].contains(FAILED))


def valid_by_root(judged: DataFrame) -> DataFrame:
    """root, valid: how many rows of each root are kept, 0 included."""
    verdict = F.col(f"`{JUDGEMENT}`")
    return judged.groupBy(key_root(F.col("key")).alias("root")).agg(F.count_if(verdict["is_valid"] & ~verdict["reasoning"].contains(FAILED)).alias("valid"))


def union_variants(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def conflict_closure(conflicts: DataFrame) -> DataFrame:
    """Pairs (a, b) of a conflict table, both ways round, and each id with itself."""
    a, b = F.col("a"), F.col("b")
    ids = conflicts.select(a.alias("a")).union(conflicts.select(b))
    return conflicts.select(a, b).union(conflicts.select(b, a)).union(ids.select("a", "a")).distinct()
