import random

import pytest
from pyspark.sql import functions as F

from tableworks.operators import enrich as N
from tableworks.operators import reasoning as R
from tableworks.operators import safety as S
from tableworks.operators import threads as D


def machine(ids, budget, grace, newlines, end, natural):
    """Token by token: what a limiter does that watches the output as it grows."""
    if budget < 0:
        return ids, None
    for n in range(len(ids) + 1):
        if any(n >= len(e) and ids[n - len(e):n] == e for e in natural):
            return ids, None
        if n >= budget + max(grace, 0) or (n >= budget and n and ids[n - 1] in newlines):
            out = ids[:n]
            while True:
                held = next((k for k in range(min(len(out), len(end)), 0, -1) if out[-k:] == end[:k]), 0)
                if held == len(end):
                    return out, n
                out = out + [end[held]]
    return ids, None


def test_truncation_equals_the_machine(spark):
    rng, rows = random.Random(11), []
    for i in range(600):
        ids = [rng.choice([1, 2, 3, 5, 6]) for _ in range(rng.randint(0, 15))]
        prompt = [7, 8, 9] if rng.random() < 0.8 else [9]
        rows.append((i, prompt, ids, rng.randint(-1, 12), rng.randint(-1, 4), [5, 6, 99]))
    df = spark.createDataFrame(rows, "req_id INT, prompt_ids ARRAY<INT>, output_ids ARRAY<INT>, budget INT, grace INT, end_ids ARRAY<INT>")
    out = R.truncate_reasoning(df, newline_ids=[1], natural_ids=[[3, 2]], think_ids=[8, 9]).collect()
    assert len(out) == 600
    for r in out:
        want = machine(r.output_ids, r.budget, r.grace, [1], [5, 6, 99], [[3, 2]]) if r.prompt_ids == [7, 8, 9] else (r.output_ids, None)
        assert (r.kept_ids, r.stop_at) == want, r


def test_split_rules(spark):
    rows = [("no tag",), ("<think> a\nb </think> x </think> y",), ("<think>open",)]
    df = spark.createDataFrame(rows, "t STRING")
    tagged = [(r.reasoning, r.answer) for r in R.split_reasoning(df, col="t").collect()]
    assert tagged[0] == ("No internal reasoning trace provided.", "no tag")
    assert tagged[1] == ("a\nb", "y") and tagged[2][1] == "<think>open"
    cut = [(r.reasoning, r.answer) for r in R.split_reasoning(df, col="t", rule="partition").collect()]
    assert cut == [("no tag", ""), ("<think> a\nb ", " x </think> y"), ("<think>open", "")]


def test_accounting_keeps_letters_of_the_reasoning(spark):
    df = spark.createDataFrame([("think hard", 3, 5, 10), ("x</think>", 20, 5, 10), (None, 1, 10, 10)], "reasoning STRING, tokens_used INT, budget INT, max_tokens INT")
    rows = R.budget_accounting(df).collect()
    assert rows[0].reasoning_text == "think hard." and rows[0].remaining == 7 and rows[0].violation is None
    assert rows[1].reasoning_text == "x" and rows[1].violation == "remaining tokens must be positive"
    assert rows[2].violation == "reasoning_budget must be smaller than max_tokens"


def test_long_thread_comes_in_segments(spark):
    rows = [("hot", i, "user", f"m{i}") for i in range(100)] + [("cold", 5, "system", "s")]
    df = spark.createDataFrame(rows, "thread_id STRING, turn BIGINT, role STRING, text STRING")
    tags = {"user": ("<", ">"), "system": ("[", "]"), "assistant": ("A:", "")}
    out = D.render_chat_prompt(df, tags=tags, system="hi", width=16).orderBy("thread_id", "segment").collect()
    assert [r.prompt for r in out if r.thread_id == "cold"] == ["[s]A:"]
    hot = [r.prompt for r in out if r.thread_id == "hot"]
    assert len(hot) == 7 and "".join(hot) == "[hi]" + "".join(f"<m{i}>" for i in range(100)) + "A:"


def test_last_message_falls_back(spark):
    rows = [("a", 1, "assistant", "one"), ("a", 2, "assistant", ""), ("a", 3, "user", "q"), ("b", 1, "user", "only"), ("c", 1, "user", None)]
    df = spark.createDataFrame(rows, "thread_id STRING, turn BIGINT, role STRING, text STRING")
    assert {r.thread_id: r.response for r in D.last_ai_message(df).collect()} == {"a": "one", "b": "only", "c": ""}


def test_mode_needs_a_system_or_user_tag(spark):
    rows = [("a", 0, "user", "x"), ("a", 1, "user", "/think /no_think"), ("a", 2, "assistant", "/think"), ("a", 3, "system", "go /think now")]
    df = spark.createDataFrame(rows, "thread_id STRING, turn BIGINT, role STRING, text STRING")
    assert [r.mode for r in D.reasoning_mode(df).orderBy("turn").collect()] == ["on", "off", "off", "on"]


def test_closing_tags_and_paths_do_not_switch(spark):
    texts = ["/no_think", "done </think>", "see https://a.b/think", "a/think", "/thinking", "x\n/think now"]
    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "thread_id INT, turn INT, role STRING, text STRING")
    assert [r.mode for r in D.reasoning_mode(df).orderBy("turn").collect()] == ["off"] * 5 + ["on"]


def test_scores_of_reviews(spark):
    from tableworks.operators import reasoning as R

    cases = {"Score: 8": 8, "helpfulness SCORE is 10/10": 10, "9 / 10 overall": 9, "a 3 out of 10": 3, "score: 11": None, "score 0": None, "none": None, "": None, "scores 5": None}
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t STRING")
    assert {r.t: r.quality_score for r in R.quality_score_extract(df, col="t").collect()} == {**cases, None: None}


def test_tool_results_and_errors(spark):
    df = spark.createDataFrame([("1", "add", '{"a": 1, "b": 2}'), ("2", "nope", "{}"), ("3", "add", '{"a": 1}'), ("4", "add", None)], "id STRING, name STRING, arguments STRING")
    out = {r.id: r.content for r in D.dispatch_results(df, {"add": lambda a, b: a + b}).collect()}
    assert out["1"] == "3" and out["2"] == "Unknown tool: nope"
    assert out["3"].startswith("Error in add:") and out["4"].startswith("Error in add:")


def test_argument_types_are_checked(spark):
    specs = spark.createDataFrame([("t", "n", "integer", True, None, None), ("t", "f", "boolean", False, None, None)],
                                  "tool STRING, param STRING, type STRING, required BOOLEAN, enum ARRAY<STRING>, default STRING")
    calls = spark.createDataFrame([("1", "t", '{"n": "x", "f": true}'), ("2", "t", '{"n": 3, "f": "maybe"}'), ("3", "t", '{"n": 3}')], "id STRING, name STRING, arguments STRING")
    got = sorted((r.id, r.problem, r.param) for r in D.validate_tool_calls(calls, specs).collect())
    assert got == [("1", "type", "n"), ("2", "type", "f")]


def test_client_retries_what_can_pass(spark):
    def client():
        tries = {}

        def call(text):
            tries[text] = tries.get(text, 0) + 1
            if text == "busy" and tries[text] < 3:
                raise N.ClientError(429)
            if text == "down":
                raise N.ClientError(503, "still down")
            if text == "denied":
                raise N.ClientError(401, "denied")
            return f"{text} {tries[text]}"

        return call

    df = spark.createDataFrame([("ok",), ("busy",), ("down",), ("denied",), (None,)], "t STRING").coalesce(1)
    out = {r.t: (r.answer, r.answer_error) for r in N.llm_map(df, col="t", client=client, backoff=0.0).collect()}
    assert out == {"ok": ("ok 1", None), "busy": ("busy 3", None), "down": (None, "still down"), "denied": (None, "denied"), None: (None, None)}


def test_guard_defaults(spark):
    rows = [("{}",), ('{"User Safety": "Safe"}',), ("[1]",), ("{} x",), (None,)]
    df = S.is_safe(S.parse_safety(spark.createDataFrame(rows, "raw STRING")))
    got = [(r.verdict.user_safety, r.is_safe) for r in df.collect()]
    assert got == [(None, False), ("Safe", True), (None, False), ("unknown", False), ("unknown", False)]


def test_safety_prompt_leaves_out_an_empty_reply(spark):
    df = spark.createDataFrame([("q", None), ("q", ""), ("q", "r")], "q STRING, r STRING")
    prompts = [r.prompt for r in S.render_template(df, query="q", response="r").collect()]
    assert prompts[0] == prompts[1] and "user: q\n\n<END CONVERSATION>" in prompts[0]
    assert "user: q\n\nresponse: agent: r\n\n<END CONVERSATION>" in prompts[2] and prompts[2].endswith("Output JSON: ")


def test_transcript_wrapper(spark):
    df = spark.createDataFrame([("Hyp(text='hello you', s=1)",), ("plain",), ("text=''",), (" \n",), (None,)], "transcript STRING")
    assert [(r.query, r.error is None) for r in D.clean_transcript(df).collect()] == [
        ("hello you", True), ("plain", True), ("text=''", True), (" \n", False), (None, False)
    ]
