"""From files to reports: sources, evaluation, sinks, generation, synthesis, judging, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluate as E
from plumbline.operators import metrics as M
from plumbline.operators import synth as S
from plumbline.sources import jsonl as J

PROMPTS = [
    {"key": "1:original", "prompt": "a", "instruction_id_list": ["punctuation:no_comma", "length_constraints:number_words"], "kwargs": [{}, {"num_words": 2, "relation": "at least"}]},
    {"key": "2:original", "prompt": "b", "instruction_id_list": ["keywords:existence"], "kwargs": [{"keywords": ["cat"], "num_words": None}], "extra": 1},
    {"key": "3:original", "prompt": "c", "instruction_id_list": [], "kwargs": []},
    {"key": "4:original", "prompt": "d", "instruction_id_list": ["punctuation:no_comma"], "kwargs": [{}]},
    {"key": "5:original", "prompt": "e", "instruction_id_list": ["punctuation:no_comma"], "kwargs": [{}]},
]
RESPONSES = [
    {"key": "1", "prompt": "a", "response": "old, response"},
    {"key": "1", "prompt": "a", "response": "hm</think>\n\ntwo words"},
    {"key": "2", "prompt": "b", "response": "*cat*s\nthe **cat**"},
    {"key": "4", "prompt": "d", "response": " \n "},
]


def lines(path, rows):
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    return str(path)


@pytest.fixture
def tables(spark, tmp_path):
    return J.read_prompts(spark, lines(tmp_path / "p.jsonl", PROMPTS)), J.read_responses(spark, lines(tmp_path / "r.jsonl", RESPONSES))


def test_strict(spark, tables, tmp_path):
    out = E.evaluate_strict(*tables)
    got = {r.key: (r.follow_all_instructions, r.follow_instruction_list, r.response) for r in out.collect()}
    assert got == {
        "1:original": (True, [True, True], "two words"), "2:original": (True, [True], "*cat*s\nthe **cat**"), "3:original": (True, [], ""), "4:original": (False, [False], " \n "), "5:original": (False, [False], ""),
    }
    log = M.report(out, "none")
    assert log["prompt_level_accuracy"] == 0.6 and log["instruction_level_accuracy"] == 0.6 and log["tier0"]["punctuation"] == pytest.approx(1 / 3)
    assert "reliable_at_k" in M.report(out) and "tier0" not in M.formatted(log)
    J.write_detail(out.drop("pos", "errors"), f"{tmp_path}/detail", 1)
    first = json.loads(next((tmp_path / "detail").glob("part*")).read_text().splitlines()[0])
    assert list(first) == sorted(first)
    with pytest.raises(ValueError):
        J.write_detail(out.limit(0), f"{tmp_path}/none")
    J.write_log(spark, log, f"{tmp_path}/log.json")
    assert json.loads((tmp_path / "log.json").read_text()) == log


def test_loose(tables):
    with pytest.raises(Exception, match="no response"):
        E.evaluate_loose(*tables).collect()
    got = {r.key: r.follow_instruction_list for r in E.evaluate_loose(*tables, mode="flag").collect()}
    assert got == {"1:original": [True, True], "2:original": [True], "3:original": [], "4:original": [False], "5:original": [False]}


def test_unknown(tables):
    prompts, responses = tables
    bad = prompts.withColumn("instruction_id_list", F.array(F.lit("no:such"), F.lit("punctuation:no_comma")))
    with pytest.raises(Exception, match="unknown instruction"):
        E.evaluate_strict(bad, responses).collect()
    rows = E.evaluate_strict(bad.where("key = '1:original'"), responses, mode="flag").collect()
    assert rows[0].follow_instruction_list == [False, True] and rows[0].errors == ["unknown instruction no:such"]
    short = prompts.where("key = '1:original'").withColumn("kwargs", F.slice("kwargs", 1, 1))
    with pytest.raises(Exception, match="no arguments"):
        E.evaluate_strict(short, responses).collect()


def test_plan(tables):
    """Neither texts nor instructions become rows, and nothing is dealt by place: what there is to shuffle is the look-up by prompt."""
    for evaluate in (E.evaluate_strict, E.evaluate_loose):
        plan = evaluate(*tables, only=["punctuation:no_comma", "length_constraints:number_words", "keywords:existence", "keywords:forbidden_words"])._jdf.queryExecution().optimizedPlan().toString()
        assert [line for line in plan.splitlines() if "Generate" in line] == []
        assert plan.count("Join LeftOuter") == 1 and "Aggregate [pos" not in plan
    without = E.evaluate_strict(*tables, only=["punctuation:no_comma", "length_constraints:number_words", "keywords:existence"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in without and "Arrow" not in without


def test_all_kinds_at_once(spark):
    """What needs Python is asked about rows that need it alone, for each reading and instruction."""
    ids = ["detectable_format:json_format", "keywords:forbidden_words", "detectable_content:postscript", "keywords:forbidden_words", "detectable_content:postscript", "punctuation:no_comma"]
    args = [{}, {"forbidden_words": [r"(a)\1", "zz"]}, {"postscript_marker": r"(?:n)\.b\."}, {"forbidden_words": ["q+x"]}, {"postscript_marker": r"(k)\1"}, {}]
    rows = [("1", "p1", '{"a": 1}'), ("2", "p2", "see aa, N.B. this kk"), ("3", "p3", "q, qqx"), ("4", "p4", "intro\n**[1]**\nout"), ("5", "p5", "")]
    prompts = spark.read.schema(J.PROMPTS).json(spark.sparkContext.parallelize([json.dumps({"key": k, "prompt": p, "instruction_id_list": ids, "kwargs": args}) for k, p, _ in rows])).withColumn("pos", F.monotonically_increasing_id())
    responses = spark.createDataFrame([(p, r) for _, p, r in rows], "prompt string, response string")
    strict = {r.key: r.follow_instruction_list for r in E.evaluate_strict(prompts, responses).collect()}
    assert strict == {
        "1": [True, True, False, True, False, True], "2": [False, False, True, True, True, False], "3": [False, True, False, False, False, False], "4": [False, True, False, True, False, True], "5": [False] * 6,
    }
    assert {r.key: r.follow_instruction_list for r in E.evaluate_loose(prompts, responses).collect()}["4"] == [True, True, False, True, False, True]


def test_missing_lists(spark):
    """A null list of instructions is an empty one; instructions without arguments are an error."""
    prompts = spark.createDataFrame([(0, "1", "a", None, None), (1, "2", "b", ["punctuation:no_comma", None], None)], "pos long, key string, prompt string, instruction_id_list array<string>, kwargs array<struct<num_words:bigint>>")
    responses = spark.createDataFrame([("a", "x"), ("b", "x")], "prompt string, response string")
    rows = {r.key: (r.follow_instruction_list, r.errors) for r in E.evaluate_strict(prompts, responses, mode="flag", only=["punctuation:no_comma"]).collect()}
    assert rows == {"1": ([], []), "2": ([False, False], ["no arguments"])}
    with pytest.raises(Exception, match="no arguments"):
        E.evaluate_strict(prompts, responses, only=["punctuation:no_comma"]).collect()


def test_order_of_lines(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(4):
        lines(folder / f"{k}.jsonl", [{"key": str(k * 10 + i), "prompt": "x" * (200 if k == 2 else 1), "response": ""} for i in range(10)])
    rows = J.read_lines(spark, str(folder), J.RESPONSES).orderBy("pos").collect()
    assert [int(r.key) for r in rows] == list(range(40))


def test_order_within_files(spark, tmp_path):
    """Splits of a file keep their order, and the data is scanned once."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        folder = tmp_path / "split"
        folder.mkdir()
        for k in range(3):
            lines(folder / f"{k}.jsonl", [{"key": str(k * 100 + i), "prompt": "x" * (7 * i % 90), "response": ""} for i in range(100)])
        df = J.read_lines(spark, str(folder), J.RESPONSES)
        rows = df.orderBy("pos").collect()
        assert df.rdd.getNumPartitions() > 6 and [int(r.key) for r in rows] == list(range(300)) and len({r.pos for r in rows}) == 300
        assert df._jdf.queryExecution().optimizedPlan().toString().count(" json") == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_paths():
    got = J.output_paths("out/", "m", "x/input_response_data_abc.jsonl")
    assert got["detail"] == "out/stat_m/raw/abc_eval_results_strict_detail.jsonl" and got["log"].endswith("abc_eval_results_strict_log.json")


def test_resume(spark, tables, tmp_path):
    prompts, _ = tables
    out = f"{tmp_path}/responses"
    first = S.generate(prompts.limit(2), S.offline_client, retries=1)
    J.append_lines(first, out)
    (tmp_path / "responses" / "part-bad.json").write_text("{broken\n")
    done = J.completed_keys(spark, out)
    assert done.count() == 2
    J.append_lines(S.generate(prompts, S.offline_client, done), out)
    assert J.completed_keys(spark, out).count() == 5
    assert S.generate(prompts, lambda r: [None] * len(r)).count() == 0


def test_synthesis(spark, tables, tmp_path):
    prompts = tables[0].where("size(kwargs) > 0").drop("pos").withColumn("key", F.split_part("key", F.lit(":"), F.lit(1)))
    many = S.synthesise(prompts, "rephrasing", lambda rs: [json.dumps([f"v{i}" for i in range(8)]) for _ in rs])
    keys = sorted(r.key for r in many.where("original_prompt = 'a'").collect())
    assert keys == sorted(f"1:rephrasing:{i}" for i in range(1, 25))
    version = {"random_seed": "1", "reasoning": "", "revised_prompt": "p2", "revised_instruction_id_list": ["punctuation:no_comma"], "revised_kwargs": "[{}]"}

    def client(requests):
        return [json.dumps({"outputs": [version] * 8}) if "Request" in r[-1]["content"] else None for r in requests]

    filled = S.synthesise(prompts, "fillin", client)
    row = filled.where("key = '2:ct_alteration:8'").first()
    assert row.prompt == "p2" and row.original_prompt == "b" and row.original_kwargs[0].keywords == ["cat"] and row.kwargs[0].keywords is None
    assert S.synthesise(prompts, "fillin", lambda rs: ["{bad"] * len(rs)).count() == 0
    assert S.union_variants(many, filled).count() == many.count() + filled.count()


def test_judging(spark, tables, tmp_path):
    prompts = tables[0].drop("pos")
    replies = lambda rs: [None if "\n\na" in r[-1]["content"] else json.dumps({"reasoning": "ok", "is_valid": "\n\nb" not in r[-1]["content"]}) for r in rs]
    judged = S.judge(prompts, replies)
    assert {r.key for r in S.valid_rows(judged).collect()} == {"3:original", "4:original", "5:original"}
    assert {r.root: r.valid for r in S.valid_by_root(judged).collect()} == {"1": 0, "2": 0, "3": 1, "4": 1, "5": 1}
    J.write_judged(judged, f"{tmp_path}/all", f"{tmp_path}/valid", F.col(f"`{J.JUDGEMENT}`.is_valid"))
    assert spark.read.json(f"{tmp_path}/all").count() == 5 and spark.read.json(f"{tmp_path}/valid").count() == 3


def test_client_retries(spark):
    df = spark.createDataFrame([("x",)], "key string").withColumn("messages", S.messages(F.col("key"), "be kind"))
    calls = []

    def flaky(requests):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("down")
        return [r[0]["role"] for r in requests]

    assert S.complete(df, flaky, retries=3).first().reply == "system"
    assert S.complete(df, flaky).schema.names == ["key", "reply"]
    assert S.parse_model("m-no-think") == ("m", False) and S.parse_model("m") == ("m", True)


def test_stream(spark, tables, tmp_path):
    from plumbline.streaming.watch import watch_prompts

    folder = tmp_path / "in"
    folder.mkdir()
    lines(folder / "p.jsonl", PROMPTS[:2])
    for expected in (2, 2):
        watch_prompts(spark, str(folder), tables[1], f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
        assert spark.read.json(f"{tmp_path}/out").count() == expected


def test_run(spark, tmp_path):
    """The chain of the command line, loose too, and the paths of what it writes."""
    from plumbline import __main__ as cli

    prompts, responses = lines(tmp_path / "p.jsonl", PROMPTS), lines(tmp_path / "input_response_data_r.jsonl", RESPONSES)
    done = E.run(spark, prompts, responses, f"{tmp_path}/out", "m")
    assert done["report"]["prompt_level_accuracy"] == 0.6 and (tmp_path / "out/stat_m/raw/r_eval_results_strict_detail.jsonl").exists()
    assert json.loads((tmp_path / "out/stat_m/log/r_eval_results_strict_log.json").read_text())["prompt_level_accuracy"] == 0.6
    assert E.run(spark, prompts, responses, f"{tmp_path}/out", "m", loose=True, mode="flag")["detail"].endswith("r_eval_results_loose_detail.jsonl")
    args = cli.parser().parse_args(["generate", "--model", "x-no-think", "--input_data", prompts, "--output_dir", f"{tmp_path}/gen"])
    assert args.client_type == "vllm" and args.num_workers == 16
    path = cli.ask(spark, args, S.offline_client, 2)
    cli.ask(spark, args, S.offline_client, 2)
    assert path == f"{tmp_path}/gen/x-no-think.jsonl" and J.read_records(spark, path).count() == 5


def asked_log(path, reply, stop_at=None):
    """A client that writes down what it is asked, and brings its process down at the request that ``stop_at`` names."""

    def client(requests):
        for r in requests:
            if stop_at and stop_at in r[-1]["content"]:
                os._exit(1)
            with open(path, "a") as log:
                log.write(json.dumps(r[-1]["content"]) + "\n")
        return [reply(r) for r in requests]

    return client


def test_stopped_run_resumes(spark, tmp_path):
    """What batches before a failure appended stays, and the next run asks for the rest alone."""
    prompts = spark.createDataFrame([(f"{i:02}", f"prompt {i:02}") for i in range(12)], "key string, prompt string").repartition(1).sortWithinPartitions("key")
    out, log = f"{tmp_path}/out.jsonl", tmp_path / "log"
    with pytest.raises(Exception):
        S.generate_into(prompts, asked_log(log, lambda r: "yes", "prompt 07"), out, tasks=1, batch_rows=3)
    kept = {r.key for r in J.read_records(spark, out).collect()}
    assert 0 < len(kept) < 12 and len(kept) % 3 == 0 and "07" not in kept
    first = len(log.read_text().splitlines())
    S.generate_into(prompts, asked_log(log, lambda r: "yes"), out, tasks=1, batch_rows=3)
    assert sorted(r.key for r in J.read_records(spark, out).collect()) == [f"{i:02}" for i in range(12)]
    assert len(log.read_text().splitlines()) - first == 12 - len(kept)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["log", "out.jsonl"]
    S.generate_into(prompts, asked_log(log, lambda r: None), f"{tmp_path}/failed.jsonl", tasks=2)
    assert spark.read.schema(J.RESPONSES).json(f"{tmp_path}/failed.jsonl").count() == 0


def test_commands(spark, tmp_path):
    """Synthesis adds to a target or takes its place; judging writes both files anew, or goes on."""
    from plumbline import __main__ as cli

    rows = [{"key": str(i), "prompt": f"p{i}", "instruction_id_list": ["punctuation:no_comma"], "kwargs": [{}], "extra": i} for i in range(3)]
    source = lines(tmp_path / "in.set.jsonl", rows)
    eight = lambda r: json.dumps([f"v{k}" for k in range(8)])
    log = tmp_path / "log"

    def run(kind, *more):
        args = cli.parser().parse_args(["synthesise", "--kind", kind, "--input_file", source, "--target_file", f"{tmp_path}/{kind}.jsonl", "--model", "m", *more])
        return J.read_records(spark, cli.ask(spark, args, asked_log(log, eight), 2))

    assert run("distractor").count() == 24 and run("distractor").count() == 24  # in its place
    assert run("task").count() == 24 and run("task").count() == 48  # added
    found = run("rephrasing")
    assert found.count() == 72 and {r.key for r in found.where("extra = 2").collect()} == {f"2:rephrasing:{k}" for k in range(1, 25)}
    before = len(log.read_text().splitlines())
    assert run("rephrasing", "--resume").count() == 72 and len(log.read_text().splitlines()) == before  # all there
    part = J.read_records(spark, f"{tmp_path}/rephrasing.jsonl").drop("pos").where("key not like '1:rephrasing:%'")
    part.write.json(f"{tmp_path}/part.jsonl")
    args = cli.parser().parse_args(["synthesise", "--kind", "rephrasing", "--input_file", source, "--target_file", f"{tmp_path}/part.jsonl", "--model", "m", "--resume"])
    assert J.read_records(spark, cli.ask(spark, args, asked_log(log, eight), 2)).count() == 72 and len(log.read_text().splitlines()) == before + 3

    def judged(reply, *more):
        args = cli.parser().parse_args(["judge", "--input_file", source, "--target_dir", f"{tmp_path}/judged", "--model", "m", *more])
        return cli.ask(spark, args, asked_log(log, reply), 2).splitlines()

    reply = lambda r: None if r[-1]["content"].endswith("p0") else json.dumps({"reasoning": "r", "is_valid": r[-1]["content"].endswith("p1")})
    annotated, valid, told = judged(reply)
    assert annotated.endswith("judged/in_annotated.jsonl") and valid.endswith("judged/in_filtered.jsonl") and told == "1 valid rows of 3 roots, 2 roots without any"
    assert spark.read.json(annotated).count() == 3 and [r.key for r in spark.read.json(valid).collect()] == ["1"]
    before = len(log.read_text().splitlines())
    assert judged(reply, "--resume")[2] == told and len(log.read_text().splitlines()) == before
    assert judged(lambda r: json.dumps({"reasoning": "r", "is_valid": True}))[2] == "3 valid rows of 3 roots, 0 roots without any"


def test_shares_of_workers():
    from plumbline.operators.durable import shared_out

    assert [shared_out(w, 8) for w in (1, 3, 8, 16, 100)] == [(1, 1), (3, 1), (8, 1), (8, 2), (8, 12)]


def test_run_evaluates_once(spark, tmp_path):
    """A check that is a Python function sees each response once, though verdicts, detail and log are written; one of them failing leaves nothing between."""
    import pandas as pd

    from plumbline.operators import checkers as C

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("boolean")
    def counted(v: pd.Series) -> pd.Series:
        seen.add(len(v))
        return v.str.contains("c")

    C.register_checker("own:counted", lambda v: counted(v), python=True)
    try:
        rows = [{"key": f"{i}:original", "prompt": f"p{i}", "instruction_id_list": ["punctuation:no_comma", "own:counted"], "kwargs": [{}, {}]} for i in range(6)]
        answers = [{"prompt": f"p{i}", "response": f"{'abc'[i % 3]}, x"[: 1 + i]} for i in range(6)]
        paths = lines(tmp_path / "p.jsonl", rows), lines(tmp_path / "r.jsonl", answers)
        done = E.run(spark, *paths, f"{tmp_path}/out", "m", groups="none")
        assert seen.value == 6 and done["report"]["tier1"] == {"own:counted": pytest.approx(2 / 6), "punctuation:no_comma": pytest.approx(1 / 6)}
        detail = J.read_records(spark, done["detail"]).collect()
        assert {r.key: r.follow_instruction_list for r in detail}["2:original"] == [False, True] and sorted(detail[0].asDict()) == sorted(["follow_all_instructions", "follow_instruction_list", "instruction_id_list", "key", "pos", "prompt", "response"])
        assert len(list((tmp_path / "out/stat_m/raw").iterdir())) == 1
        empty = lines(tmp_path / "none.jsonl", [])
        with pytest.raises(ValueError, match="no outputs"):
            J.write_detail(J.read_prompts(spark, empty), done["detail"])
        assert J.read_records(spark, done["detail"]).count() == 6
    finally:
        C.unregister_checker("own:counted")


def test_chat_client():
    """What is sent to a server, and replies that fail."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    sent = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            sent.append(body)
            good = body["messages"][-1]["content"] != "bad"
            data = json.dumps({"choices": [{"message": {"content": f" r{i} "}} for i in range(body.get("n", 1))]}).encode()
            self.send_response(200 if good else 500)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/v1"
        one = S.ChatClient("m-no-think", url, temperature=0.7, effort="low")
        turns = [[{"role": "user", "content": c}] for c in ("good", "bad")]
        assert one(turns) == ["r0", None]
        assert sent[0]["model"] == "m" and sent[0]["temperature"] == 0.7 and sent[0]["reasoning_effort"] == "low" and sent[0]["chat_template_kwargs"] == {"enable_thinking": False}
        assert json.loads(S.ChatClient("m", url, choices=3)(turns[:1])[0]) == ["r0", "r1", "r2"]
    finally:
        server.shutdown()


def test_client_from_env(monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    monkeypatch.delenv("OAI_API_KEY", raising=False)
    assert S.client_from_env("m", port=9).url == "http://localhost:9/v1/chat/completions"
    with pytest.raises(ValueError):
        S.client_from_env("m", "oai")


def test_own_arguments(spark, tmp_path):
    from plumbline.operators import checkers as C
    from pyspark.sql import types as T

    with pytest.raises(ValueError):
        C.register_checker("own:last", lambda v, own_last: F.endswith(v, own_last))
    C.register_checker("own:last", lambda v, own_last: F.endswith(v, own_last), "The last is {own_last}.", {"own_last": T.StringType()})
    try:
        rows = [{"key": "1", "prompt": "a", "instruction_id_list": ["own:last", "punctuation:no_comma"], "kwargs": [{"own_last": "words"}, {}]}]
        prompts, responses = J.read_prompts(spark, lines(tmp_path / "p.jsonl", rows)), J.read_responses(spark, lines(tmp_path / "r.jsonl", RESPONSES))
        assert E.evaluate_strict(prompts, responses).first().follow_instruction_list == [True, True]
        with pytest.raises(ValueError):
            C.register_checker("own:last", lambda v, own_last: v, "", {"own_last": T.LongType()})
        with pytest.raises(ValueError):
            C.register_checker("own:other", lambda v, num_words: v, "", {"num_words": T.StringType()})
        assert len(C.KWARGS.names) == 25 and len(C.kwargs_schema().names) == 26
        plain = prompts.withColumn("kwargs", F.transform("kwargs", lambda k: k.dropFields("own_last")))  # read before the check was there
        assert E.evaluate_strict(plain, responses).first().follow_instruction_list == [False, True]
    finally:
        C.unregister_checker("own:last")
    assert C.kwargs_schema() == C.KWARGS and "own_last" not in J.read_prompts(spark, str(tmp_path / "p.jsonl")).schema.simpleString()


def test_tables_and_variants(spark, tables, tmp_path):
    prompts = tables[0].drop("pos")
    prompts.write.parquet(f"{tmp_path}/table")
    assert J.read_prompt_table(spark, f"{tmp_path}/table").count() == 5
    J.write_variants(prompts, f"{tmp_path}/v")
    J.write_variants(prompts.limit(1), f"{tmp_path}/v")
    assert J.read_records(spark, f"{tmp_path}/v").count() == 6
    J.write_variants(prompts.limit(2), f"{tmp_path}/v", "overwrite")
    assert J.read_records(spark, f"{tmp_path}/v").count() == 2
    with pytest.raises(ValueError):
        J.write_variants(prompts, f"{tmp_path}/v", "other")
