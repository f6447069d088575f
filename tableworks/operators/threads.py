"""Message threads: history, prompts, modes, tool calls, stream deltas.

A message frame has a thread id, an integral order that is unique in the thread, a role and a
text. Nothing here gathers a thread in one task: positions and carried modes are computed in
buckets of the order, and joined texts come in bounded segments.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import is_json
from ..functions.text import strip
from .guards import fits, posexploded, require_columns
from .ordering import BUCKET_WIDTH, join_segments, last_value_before, position_in_group


def thread_history(
    msgs: DataFrame, *, thread: str = "thread_id", order: str = "turn", role: str = "role", text: str = "text", system: str | None = None,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Messages with their 0-based position; a system message is put first where none is."""
    require_columns(msgs, thread, order, role, text)
    return _placed_messages(msgs, thread, order, role, text, system, width).drop("_total")


def _placed_messages(
    msgs: DataFrame, thread: str, order: str, role: str, text: str, system: str | None, width: int
) -> DataFrame:
    """History with ``_total``, the number of messages of the thread including an added one."""
    rows = msgs.select(thread, F.col(order).cast("long").alias(order), role, text)
    if system is None:
        return position_in_group(rows, by=[thread], order=order, out="position", width=width, total="_total").drop(order)
    placed = position_in_group(
        rows, by=[thread], order=order, out="position", width=width, total="_total", any_of=("_has", F.col(role) == "system")
    )
    shift = F.when(F.col("_has"), 0).otherwise(1)
    own = F.struct((F.col("position") + shift).cast("long").alias("position"), F.col(role).alias(role), F.col(text).alias(text))
    added = F.struct(F.lit(0).cast("long").alias("position"), F.lit("system").alias(role), F.lit(system).alias(text))
    both = F.when(~F.col("_has") & (F.col("position") == 0), F.array(added, own)).otherwise(F.array(own))
    return placed.select(thread, (F.col("_total") + shift).alias("_total"), F.explode_outer(both).alias("_m")).select(
        thread, "_m.*", "_total"
    )


def last_ai_message(msgs: DataFrame, *, thread: str = "thread_id", order: str = "turn", role: str = "role", text: str = "text", ai: str = "assistant") -> DataFrame:
    """Last non-empty model message per thread, else the last message, else an empty text."""
    spoken = (F.col(role) == ai) & (F.length(text) > 0)
    return msgs.groupBy(thread).agg(
        F.coalesce(F.max_by(text, F.when(spoken, F.col(order))), F.max_by(text, order), F.lit("")).alias("response")
    )


# Markers around a message and in front of the answer, by role.
CHAT_TAGS = {
    "system": ("<|im_start|>system\n", "<|im_end|>\n"),
    "user": ("<|im_start|>user\n", "<|im_end|>\n"),
    "assistant": ("<|im_start|>assistant\n", "<|im_end|>\n"),
    "tool": ("<|im_start|>tool\n", "<|im_end|>\n"),
}


def render_chat_prompt(
    msgs: DataFrame, *, thread: str = "thread_id", order: str = "turn", role: str = "role", text: str = "text",
    tags: dict[str, tuple[str, str]] = CHAT_TAGS, generation: bool = True, system: str | None = None,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Role-tagged prompt per thread: (thread, segment, prompt). Threads of up to a few thousand
    messages have one segment."""
    history = _placed_messages(msgs, thread, order, role, text, system, width)

    def lookup(side: int) -> Column:
        marks = F.create_map(*[F.lit(x) for r, tag in tags.items() for x in (r, tag[side])])
        return F.coalesce(F.try_element_at(marks, F.col(role)), F.lit(""))

    part = F.concat(lookup(0), F.coalesce(text, F.lit("")), lookup(1))
    if generation:
        last = F.col("position") == F.col("_total") - 1
        part = F.concat(part, F.when(last, tags["assistant"][0]).otherwise(""))
    parts = history.withColumn("_part", part)
    return join_segments(parts, by=[thread], position="position", parts={"prompt": "_part"}, width=width)


def reasoning_mode(msgs: DataFrame, *, thread: str = "thread_id", order: str = "turn", role: str = "role", text: str = "text", default: str = "on") -> DataFrame:
    """Reasoning switch in force at each message: the last tag so far in a system or user text. A tag stands at the start
    or after white space, so closing tags and paths do not switch."""
    tag = F.regexp_extract(text, r"(?s)^(?:.*\s)?(/no_think|/think)(?![\w/])", 1)
    own = F.when(F.col(role).isin("system", "user"), F.when(tag == "/think", "on").when(tag == "/no_think", "off"))
    out = last_value_before(msgs.withColumn("_tag", own), by=[thread], order=order, value="_tag", out="mode", inclusive=True)
    return out.withColumn("mode", F.coalesce("mode", F.lit(default))).drop("_tag")


def collect_stream_chunks(df: DataFrame, *, stream: str = "stream_id", order: str = "seq", width: int = BUCKET_WIDTH) -> DataFrame:
    """Ordered deltas to whole texts: (stream, segment, reasoning, content)."""
    placed = position_in_group(df.select(stream, order, "reasoning", "content"), by=[stream], order=order, out="position")
    return join_segments(placed, by=[stream], position="position", parts={"reasoning": "reasoning", "content": "content"}, width=width)


# --- tool calls -------------------------------------------------------------------------------


def extract_tool_calls(msgs: DataFrame, *, calls: str = "tool_calls", first_only: bool = False, keep: list[str] = ("thread_id", "turn")) -> DataFrame:
    """One row per call: kept columns, call_no, id, name, arguments; arguments that are no JSON become {}."""
    exploded = posexploded(msgs, list(keep), F.col(calls), "call_no", "_c")
    if first_only:
        exploded = exploded.where(F.col("call_no") == 0)
    raw = F.col("_c.arguments")
    return exploded.select(
        *keep, "call_no", F.col("_c.id").alias("id"), F.col("_c.name").alias("name"),
        F.when(is_json(raw), raw).otherwise("{}").alias("arguments"),
    )


MAX_TOOLS = 10_000


def validate_tool_calls(calls: DataFrame, specs: DataFrame, *, keep: list[str] = ("id",)) -> DataFrame:
    """Problems of tool calls: (kept columns, name, problem, param).

    ``specs`` has one row per parameter: tool, param, type, required, enum (array), default.
    A tool without parameters has one row with a null param. Problems are ``unknown_tool``,
    ``missing``, ``extra``, ``enum`` and ``type``. A missing parameter with a default is fine.
    """
    fields = [c for c in ("param", "type", "required", "enum", "default")]
    by_tool = specs.groupBy(F.col("tool").alias("name")).agg(
        F.filter(F.collect_list(F.struct(*fields)), lambda s: s["param"].isNotNull()).alias("_specs")
    )
    if fits(by_tool, MAX_TOOLS):
        by_tool = F.broadcast(by_tool)
    args = F.from_json("arguments", "map<string,string>")
    joined = calls.join(by_tool, "name", "left").withColumn("_args", F.coalesce(args, F.create_map().cast("map<string,string>")))

    def value(s: Column) -> Column:
        return F.try_element_at("_args", s["param"])

    def problem(kind: str, param: Column) -> Column:
        return F.struct(F.lit(kind).alias("problem"), param.cast("string").alias("param"))

    def wrong_type(s: Column) -> Column:
        v = value(s)
        whole = (s["type"] == "integer") & v.try_cast("long").isNull()
        number = (s["type"] == "number") & v.try_cast("double").isNull()
        flag = (s["type"] == "boolean") & ~v.isin("true", "false")
        return v.isNotNull() & (whole | number | flag)

    specs_of = F.col("_specs")
    listed = F.transform(specs_of, lambda s: s["param"])
    known = F.concat(
        F.transform(
            F.filter(specs_of, lambda s: s["required"] & s["default"].isNull() & ~F.map_contains_key("_args", s["param"])),
            lambda s: problem("missing", s["param"]),
        ),
        F.transform(F.array_except(F.map_keys("_args"), listed), lambda k: problem("extra", k)),
        F.transform(
            F.filter(specs_of, lambda s: s["enum"].isNotNull() & value(s).isNotNull() & ~F.array_contains(s["enum"], value(s))),
            lambda s: problem("enum", s["param"]),
        ),
        F.transform(F.filter(specs_of, wrong_type), lambda s: problem("type", s["param"])),
    )
    unknown = F.array(problem("unknown_tool", F.lit(None)))
    found = F.when(specs_of.isNull(), unknown).otherwise(known)
    return joined.select(*keep, "name", F.inline(found))


def dispatch_results(calls: DataFrame, registry: dict[str, Callable[..., str]], *, keep: list[str] = ("id",)) -> DataFrame:
    """Run the registered function of each call: (kept columns, name, role, content). Unknown tools
    and errors become text, as a model expects them."""

    @F.pandas_udf("string")
    def run(names: pd.Series, arguments: pd.Series) -> pd.Series:
        def one(name: str, raw: str) -> str:
            if name not in registry:
                return f"Unknown tool: {name}"
            try:
                return str(registry[name](**json.loads(raw or "{}")))
            except Exception as error:  # the text goes back to the model
                return f"Error in {name}: {error}"

        return pd.Series([one(n, a) for n, a in zip(names, arguments)], dtype=object)

    return calls.select(*keep, "name", F.lit("tool").alias("role"), run("name", "arguments").alias("content"))


def _cut(col: Column, n: int, always: bool = False) -> Column:
    dots = F.lit("...") if always else F.when(F.length(col) > n, "...").otherwise("")
    return F.concat(F.substring(col, 1, n), dots)


def collaboration_log(
    msgs: DataFrame, *, thread: str = "thread_id", order: str = "turn", role: str = "role", text: str = "text",
    calls: str = "tool_calls", name: str = "name", arg_len: int = 100, text_len: int = 150,
) -> DataFrame:
    """Who did what in a thread: (thread, step, call_no, label, name, preview).

    Model messages with calls give one row per call, others one row. Roles outside user, assistant
    and tool are left out. Steps count from 1.
    """
    placed = position_in_group(msgs, by=[thread], order=order, out="_pos")
    one = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(False).alias("is_call")))
    called = F.transform(calls, lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"), F.lit(True).alias("is_call")))
    has_calls = (F.col(role) == "assistant") & (F.size(F.coalesce(F.col(calls), F.array().cast(msgs.schema[calls].dataType))) > 0)
    shown_roles = placed.where(F.col(role).isin("user", "assistant", "tool"))
    kept = [thread, (F.col("_pos") + 1).alias("step"), role, text, name]
    items = posexploded(shown_roles, kept, F.when(has_calls, called).otherwise(one), "call_no", "_i")
    is_call = F.col("_i.is_call")
    label = (
        F.when(is_call, "TOOL CALL").when(F.col(role) == "tool", "TOOL RESULT").when(F.col(role) == "user", "USER").otherwise("COORDINATOR")
    )
    preview = (
        F.when(is_call, _cut(F.col("_i.arguments"), arg_len))
        .when(F.col(role) == "user", _cut(F.col(text), arg_len, always=True))
        .otherwise(_cut(F.col(text), text_len))
    )
    shown = F.when(is_call, F.coalesce("_i.name", F.lit("unknown"))).when(F.col(role) == "tool", F.coalesce(name, F.lit("unknown")))
    return items.select(thread, "step", "call_no", label.alias("label"), shown.alias("name"), preview.alias("preview"))


def clean_transcript(df: DataFrame, *, col: str = "transcript") -> DataFrame:
    """Adds ``query`` without a recogniser's text='…' wrapper, and ``error`` where nothing was said."""
    from ..fixed_values import NO_SPEECH

    inner = F.regexp_extract(col, r"text='([^']+)'", 1)
    query = F.when(inner != "", inner).otherwise(F.col(col))
    out = df.withColumn("query", query)
    blank = F.coalesce(F.length(strip(F.col("query"))) == 0, F.lit(True))
    return out.withColumn("error", F.when(blank, F.lit(NO_SPEECH)))
