"""Reasoning traces: splitting, budgets and token accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import NO_REASONING
from ..functions.text import strip

END = "</think>"


def split_reasoning(df: DataFrame, *, col: str, rule: str = "tagged", default: str = NO_REASONING) -> DataFrame:
    """Adds ``reasoning`` and ``answer``.

    ``partition`` cuts at the first closing tag; without one all of the text is reasoning.
    ``tagged`` takes the first closed block as reasoning and what follows the last closing tag
    as answer; without a block the whole text is the answer.
    """
    text = F.col(col)
    if rule == "partition":
        at = F.instr(text, END)
        reasoning = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
        answer = F.when(at > 0, F.substring(text, at + len(END), F.length(text))).otherwise("")
    elif rule == "tagged":
        block = r"(?s)<think>(.*?)</think>"
        tagged = text.rlike(block)
        reasoning = F.when(tagged, strip(F.regexp_extract(text, block, 1))).otherwise(F.lit(default))
        answer = F.when(tagged, strip(F.substring_index(text, END, -1))).otherwise(text)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return df.withColumns({"reasoning": reasoning, "answer": answer})


def budget_overrides(reqs: DataFrame, overrides: DataFrame, *, defaults: dict, key: str = "req_id") -> DataFrame:
    """Requests with budget, grace and end_ids: the value of the request where given, else the default."""
    types = dict(overrides.dtypes)
    joined = reqs.join(overrides, key, "left")

    def literal(value) -> Column:
        return F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)

    return joined.withColumns({c: F.coalesce(F.col(c), literal(v).cast(types[c])) for c, v in defaults.items()})


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")


def truncate_reasoning(
    df: DataFrame, *, tokens: str = "output_ids", prompt: str = "prompt_ids", budget: str = "budget", grace: str = "grace",
    newline_ids: list[int], end_ids: str = "end_ids", natural_ids: list[list[int]], think_ids: list[int],
) -> DataFrame:
    """Cut reasoning token arrays at their budget: adds ``kept_ids`` and ``stop_at``.

    Only rows whose prompt ends with the think sequence are touched. The cut is at the first
    length that reaches the budget just after a line break, or the budget plus grace, unless the
    trace has closed by itself by then. The end sequence follows, less what the kept tokens
    already hold of it. A negative budget means no limit, a negative grace none.
    """
    ids, n = F.col(tokens), F.size(tokens)
    at, room = F.col(budget), F.greatest(F.col(grace), F.lit(0))
    think = _ints(think_ids)
    thinking = F.lit(False)
    if think_ids:
        size = len(think_ids)
        thinking = (F.size(prompt) >= size) & (F.slice(F.col(prompt), F.greatest(F.size(prompt) - size + 1, F.lit(1)), size) == think)

    breaks = F.transform(ids, lambda t, i: F.when(F.array_contains(_ints(newline_ids), t), i + 1))
    at_break = F.array_min(F.filter(breaks, lambda p: p.isNotNull() & (p >= at)))
    at_limit = F.when(at + room <= n, at + room)
    stop = F.when((at >= 0) & thinking, F.least(at_break, at_limit))

    def first_end(seq: list[int]) -> Column:
        size = len(seq)

        def closes(_, i: Column) -> Column:
            here = F.slice(ids, F.greatest(i + 2 - size, F.lit(1)), size) == _ints(seq)
            return F.when((i + 1 >= size) & here, i + 1)

        return F.array_min(F.filter(F.transform(ids, closes), lambda p: p.isNotNull()))

    ends = [first_end(seq) for seq in natural_ids if seq]
    natural = F.least(*ends) if len(ends) > 1 else ends[0] if ends else F.lit(None).cast("int")
    work = df.withColumn("stop_at", F.when(natural.isNull() | (natural > stop), stop))

    closing, cut = F.col(end_ids), F.col("stop_at")
    kept = F.slice(ids, F.lit(1), cut)
    longest = F.least(F.size(closing), cut)
    sizes = F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>"))
    held = F.filter(sizes, lambda k: F.slice(ids, cut - k + 1, k) == F.slice(closing, F.lit(1), k))
    overlap = F.coalesce(F.array_max(held), F.lit(0))
    rest = F.slice(closing, overlap + 1, F.greatest(F.size(closing) - overlap, F.lit(0)))
    return work.withColumn("kept_ids", F.when(cut.isNull(), ids).otherwise(F.concat(kept, rest)))


def budget_accounting(df: DataFrame, *, reasoning: str = "reasoning", tokens_used: str = "tokens_used", budget: str = "budget", max_tokens: str = "max_tokens") -> DataFrame:
    """Close open reasoning, count what is left for the answer and name violations.

    ``tokens_used`` is the token count of the closed reasoning. Adds ``closed``, ``remaining``,
    ``reasoning_text`` (the tag removed) and ``violation``.
    """
    text = F.coalesce(F.col(reasoning), F.lit(""))
    closed = F.when(F.instr(text, END) > 0, text).otherwise(F.concat(text, F.lit(".\n</think>\n\n")))
    out = df.withColumn("closed", closed).withColumn("remaining", F.col(max_tokens) - F.col(tokens_used))
    bare = strip(F.regexp_replace(strip(F.col("closed")), r"</think>$", ""))
    violation = F.when(F.col(max_tokens) <= F.col(budget), "reasoning_budget must be smaller than max_tokens").when(
        F.col("remaining") <= 0, "remaining tokens must be positive"
    )
    return out.withColumns({"reasoning_text": bare, "violation": violation})


def quality_score_extract(df: DataFrame, *, col: str, out: str = "quality_score") -> DataFrame:
    """The helpfulness score of a review: the first whole number after the word "score", or else before "/10" or "out of 10".
    Anything but 1 to 10 is null."""
    named = F.regexp_extract(col, r"(?i)\bscore\b\D{0,20}?(\d+)", 1)
    of_ten = F.regexp_extract(col, r"(?i)(\d+)\s*(?:/|out of)\s*10\b", 1)
    text = F.when(F.length(named) > 0, named).otherwise(of_ten)
    number = F.when((F.length(text) > 0) & (F.length(text) <= 2), text).cast("int")
    return df.withColumn(out, F.when(number.between(1, 10), number))
