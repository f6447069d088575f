"""Safety prompts, verdicts and the guarded flow as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    INPUT_REFUSAL, OUTPUT_REFUSAL, SAFETY_ENDING, SAFETY_FORMAT, SAFETY_TASK, SAFETY_TAXONOMY,
)
from ..functions.json import is_json

VERDICT_SCHEMA = "`User Safety` STRING, `Response Safety` STRING, `Safety Categories` STRING"


def render_template(df: DataFrame, *, query: str, response: str | None = None, variant: str = "inline", out: str = "prompt") -> DataFrame:
    """Safety prompt of a user text and, where there is one, a reply.

    ``inline`` ends taxonomy lines and the prompt with a blank, ``rails`` does not.
    """
    blank = " " if variant == "inline" else ""
    taxonomy = "\n".join(f"{code}: {name}.{blank}" for code, name in SAFETY_TAXONOMY)
    head = (
        f"{SAFETY_TASK}\n\n<BEGIN UNSAFE CONTENT CATEGORIES>\n{taxonomy}\n<END UNSAFE CONTENT CATEGORIES>\n\n"
        "<BEGIN CONVERSATION>\n\nuser: "
    )
    ending = SAFETY_ENDING if variant == "inline" else SAFETY_ENDING.rstrip()
    tail = f"\n<END CONVERSATION>\n\n{SAFETY_FORMAT}\n\n{ending}"
    reply: Column = F.lit("")
    if response is not None:
        reply = F.when(F.length(response) > 0, F.concat(F.lit("\nresponse: agent: "), F.col(response), F.lit("\n"))).otherwise("")
    return df.withColumn(out, F.concat(F.lit(head), F.coalesce(query, F.lit("")), F.lit("\n"), reply, F.lit(tail)))


def verdict(col: Column) -> Column:
    """Verdict text to a struct; what cannot be parsed is 'unknown' and kept raw."""
    ok = is_json(col)
    parsed = F.when(ok, F.from_json(col, VERDICT_SCHEMA))
    return F.struct(
        F.when(ok, parsed["User Safety"]).otherwise("unknown").alias("user_safety"),
        parsed["Response Safety"].alias("response_safety"),
        parsed["Safety Categories"].alias("categories"),
        F.when(~ok, col).alias("raw_response"),
    )


def user_ok(v: Column) -> Column:
    return F.lower(F.coalesce(v["user_safety"], F.lit("unsafe"))) == "safe"


def response_ok(v: Column) -> Column:
    return F.lower(F.coalesce(v["response_safety"], F.lit("safe"))) == "safe"


def parse_safety(df: DataFrame, *, col: str = "raw", out: str = "verdict") -> DataFrame:
    return df.withColumn(out, verdict(F.col(col)))


def is_safe(df: DataFrame, *, verdict: str = "verdict", out: str = "is_safe") -> DataFrame:
    """Both parts must be safe; an absent user part counts as unsafe, an absent reply as safe."""
    return df.withColumn(out, user_ok(F.col(verdict)) & response_ok(F.col(verdict)))


def safety_categories(df: DataFrame, *, verdict: str = "verdict", keep: list[str] = ("case_id",)) -> DataFrame:
    """One row per listed category: (kept columns, category, code, name). Categories may be given
    by code, by name or as ``code: name``; one outside the taxonomy has null code and name."""
    names = F.create_map(*[F.lit(x) for code, name in SAFETY_TAXONOMY for x in (code, name)])
    codes = F.create_map(*[F.lit(x) for code, name in SAFETY_TAXONOMY for x in (name.lower(), code)])
    listed = F.filter(F.transform(F.split(F.col(verdict)["categories"], ","), lambda c: F.trim(c)), lambda c: c != "")
    rows = df.select(*keep, F.explode(listed).alias("category"))
    head = F.regexp_extract("category", r"^(S\d+)\b", 1)
    code = F.when(F.try_element_at(names, head).isNotNull(), head).otherwise(F.try_element_at(codes, F.lower("category")))
    return rows.withColumn("code", code).withColumn("name", F.try_element_at(names, F.col("code")))


def guard_flow(
    df: DataFrame, *, input_verdict: str = "input_verdict", output_verdict: str = "output_verdict", response: str = "response", error: str = "error",
) -> DataFrame:
    """Outcome of a guarded answer: adds ``final_response``, ``is_safe`` and ``blocked_at``.

    The input check comes first, then a failed answer, then the output check.
    """
    bad_input = ~user_ok(F.col(input_verdict))
    failed = F.col(error).isNotNull()
    bad_output = ~(user_ok(F.col(output_verdict)) & response_ok(F.col(output_verdict)))
    blocked = F.when(bad_input, "input_validation").when(failed, "agent_execution").when(bad_output, "output_validation")
    final = F.when(bad_input, INPUT_REFUSAL).when(failed, None).when(bad_output, OUTPUT_REFUSAL).otherwise(F.col(response))
    return df.withColumns({"blocked_at": blocked, "final_response": final}).withColumn("is_safe", F.col("blocked_at").isNull())
