"""Queries over threads, tool calls, reasoning traces and safety verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import SAFETY_ENDING, SAFETY_FORMAT, SAFETY_TASK, SAFETY_TAXONOMY
from ..operators import enrich as N
from ..operators import reasoning as R
from ..operators import safety as S
from ..operators import threads as D
from ..session import table
from .registry import query

KEYS = {"thread": "conv_id", "order": "turn"}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- threads ----------------------------------------------------------------------------------

HELLO = "You are a helpful assistant."

HISTORY_SQL = f"""
WITH lacking AS (SELECT conv_id, min(turn) - 1 AS turn FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'system')),
msgs AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, 'system', {quoted(HELLO)} FROM lacking),
history AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, text FROM msgs)
"""


@query("thread_history", HISTORY_SQL + "SELECT * FROM history")
def thread_history(spark, sf):
    return D.thread_history(table(spark, sf, "conversations"), **KEYS, system=HELLO)


@query("last_ai_message", """
SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'assistant' AND length(text) > 0), arg_max(text, turn), '') AS response
FROM conversations GROUP BY conv_id""")
def last_ai_message(spark, sf):
    return D.last_ai_message(table(spark, sf, "conversations"), **KEYS)


@query("render_chat_prompt", HISTORY_SQL + """
SELECT conv_id, 0::BIGINT AS segment,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY position) || '<|im_start|>assistant' || chr(10) AS prompt
FROM history GROUP BY conv_id""")
def render_chat_prompt(spark, sf):
    return D.render_chat_prompt(table(spark, sf, "conversations"), **KEYS, system=HELLO)


TAGGED_SQL = """
WITH tagged AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 300 THEN text || ' /no_think' WHEN length(text) < 150 THEN text || ' /think' ELSE text END AS text FROM conversations)
"""


@query("reasoning_mode", TAGGED_SQL + """,
own AS (SELECT *, CASE WHEN role IN ('system', 'user') THEN CASE WHEN text LIKE '%/no_think' THEN 'off' WHEN text LIKE '%/think' THEN 'on' END END AS tag FROM tagged)
SELECT conv_id, turn, role, coalesce(last_value(tag IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 'on') AS mode FROM own""")
def reasoning_mode(spark, sf):
    text = F.when(F.length("text") > 300, F.concat("text", F.lit(" /no_think"))).when(F.length("text") < 150, F.concat("text", F.lit(" /think"))).otherwise(F.col("text"))
    return D.reasoning_mode(table(spark, sf, "conversations").withColumn("text", text), **KEYS).drop("text")


@query("collect_stream_chunks", """
SELECT conv_id AS stream_id, 0::BIGINT AS segment, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'assistant'), '') AS reasoning,
       coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS content
FROM conversations GROUP BY conv_id""")
def collect_stream_chunks(spark, sf):
    """Each message split into deltas before every blank; user texts play the reasoning."""
    return D.collect_stream_chunks(deltas(spark, sf))


def deltas(spark, sf):
    pieces = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("stream_id"), "turn", "role", F.posexplode_outer(F.split("text", "(?= )")).alias("n", "piece")
    )
    seq = F.shiftleft(F.col("turn"), 32) + F.col("n")
    return pieces.select(
        "stream_id", seq.alias("seq"), F.when(F.col("role") != "assistant", F.col("piece")).alias("reasoning"),
        F.when(F.col("role") == "assistant", F.col("piece")).alias("content"),
    )


# --- tool calls -------------------------------------------------------------------------------

CALLS_SQL = """
WITH raw AS (
  SELECT event_id, 0::BIGINT AS call_no, 'c' || event_id AS id, event_type AS name, CASE WHEN event_type = 'error' THEN substr(props, 1, 4) ELSE props END AS arguments FROM events
  UNION ALL SELECT event_id, 1, 'd' || event_id, 'lookup', '{"user": ' || user_id || ', "unit": "' || CASE WHEN value < 20 THEN 'celsius' ELSE event_type END || '"}' FROM events WHERE event_type IN ('click', 'purchase')),
calls AS (SELECT event_id, call_no, id, name, CASE WHEN json_valid(arguments) THEN arguments ELSE '{}' END AS arguments FROM raw)
"""


def messages_with_calls(spark, sf):
    """A model message per event: one call named after its type, for some types a second one."""
    kind = F.col("event_type")
    first = F.struct(
        F.concat(F.lit("c"), "event_id").alias("id"), kind.alias("name"),
        F.when(kind == "error", F.substring("props", 1, 4)).otherwise(F.col("props")).alias("arguments"),
    )
    unit = F.when(F.col("value") < 20, "celsius").otherwise(kind)
    second = F.struct(
        F.concat(F.lit("d"), "event_id").alias("id"), F.lit("lookup").alias("name"),
        F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "unit": "'), unit, F.lit('"}')).alias("arguments"),
    )
    return table(spark, sf, "events").select(
        "event_id", "user_id", "ts", "event_type", F.when(kind.isin("click", "purchase"), F.array(first, second)).otherwise(F.array(first)).alias("tool_calls")
    )


@query("extract_tool_calls", CALLS_SQL + "SELECT * FROM calls")
def extract_tool_calls(spark, sf):
    return D.extract_tool_calls(messages_with_calls(spark, sf), keep=["event_id"])


@query("extract_tool_calls_first", CALLS_SQL + "SELECT * FROM calls WHERE call_no = 0")
def extract_tool_calls_first(spark, sf):
    return D.extract_tool_calls(messages_with_calls(spark, sf), keep=["event_id"], first_only=True)


def tool_specs(spark):
    return spark.sql("""
        SELECT * FROM VALUES
          ('click', 'k', 'integer', true, CAST(NULL AS ARRAY<STRING>), CAST(NULL AS STRING)),
          ('error', 'k', 'integer', true, NULL, NULL),
          ('purchase', 'amount', 'number', true, NULL, '0'),
          ('purchase', 'shop', 'string', true, NULL, NULL),
          ('lookup', 'user', 'integer', true, NULL, NULL),
          ('lookup', 'unit', 'string', false, array('celsius', 'fahrenheit'), NULL),
          ('view', NULL, NULL, NULL, NULL, NULL)
        AS specs(tool, param, type, required, enum, default)""")


@query("validate_tool_calls", CALLS_SQL + """,
args AS (SELECT *, json_extract_string(arguments, '$.k') AS k, json_extract_string(arguments, '$.unit') AS unit FROM calls)
SELECT id, name, 'unknown_tool' AS problem, NULL::VARCHAR AS param FROM args WHERE name NOT IN ('click', 'error', 'purchase', 'lookup', 'view')
UNION ALL SELECT id, name, 'missing', 'k' FROM args WHERE name IN ('click', 'error') AND k IS NULL
UNION ALL SELECT id, name, 'missing', 'shop' FROM args WHERE name = 'purchase'
UNION ALL SELECT id, name, 'extra', 'k' FROM args WHERE name IN ('purchase', 'view') AND k IS NOT NULL
UNION ALL SELECT id, name, 'enum', 'unit' FROM args WHERE name = 'lookup' AND unit NOT IN ('celsius', 'fahrenheit')""")
def validate_tool_calls(spark, sf):
    calls = D.extract_tool_calls(messages_with_calls(spark, sf), keep=["event_id"])
    return D.validate_tool_calls(calls, tool_specs(spark))


@query("dispatch_results", CALLS_SQL + """
SELECT id, name, 'tool' AS role, CASE name
         WHEN 'click' THEN 'clicked ' || json_extract_string(arguments, '$.k')
         WHEN 'lookup' THEN 'user ' || json_extract_string(arguments, '$.user') || ' in ' || json_extract_string(arguments, '$.unit')
         ELSE 'Unknown tool: ' || name END AS content FROM calls""")
def dispatch_results(spark, sf):
    calls = D.extract_tool_calls(messages_with_calls(spark, sf), keep=["event_id"])
    return D.dispatch_results(calls, {"click": lambda k: f"clicked {k}", "lookup": lambda user, unit: f"user {user} in {unit}"})


TRACE_SQL = """
WITH msgs AS (
  SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' AND length(text) > 400 THEN 1 WHEN role = 'assistant' AND length(text) < 100 THEN 2 END AS kind,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations)
"""


@query("collaboration_log", TRACE_SQL + """
SELECT conv_id, step, 0::BIGINT AS call_no, 'USER' AS label, NULL::VARCHAR AS name, substr(text, 1, 100) || '...' AS preview FROM msgs WHERE role = 'user'
UNION ALL SELECT conv_id, step, 0, 'TOOL RESULT', 'search', substr(text, 1, 150) || CASE WHEN length(text) > 150 THEN '...' ELSE '' END FROM msgs WHERE kind = 2
UNION ALL SELECT conv_id, step, 0, 'COORDINATOR', NULL, substr(text, 1, 150) || CASE WHEN length(text) > 150 THEN '...' ELSE '' END FROM msgs WHERE role = 'assistant' AND kind IS NULL
UNION ALL SELECT conv_id, step, 0, 'TOOL CALL', 'search', substr(text, 1, 100) || '...' FROM msgs WHERE kind = 1
UNION ALL SELECT conv_id, step, 1, 'TOOL CALL', 'unknown', '{}' FROM msgs WHERE kind = 1""")
def collaboration_log(spark, sf):
    """Long replies become two tool calls each, short ones the result of a tool."""
    reply = F.col("role") == "assistant"
    call = F.struct(F.lit("search").alias("name"), F.col("text").alias("arguments"))
    bare = F.struct(F.lit(None).cast("string").alias("name"), F.lit("{}").alias("arguments"))
    msgs = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text",
        F.when(reply & (F.length("text") < 100), "tool").otherwise(F.col("role")).alias("role"),
        F.when(reply & (F.length("text") > 400), F.array(call, bare)).alias("tool_calls"),
        F.when(reply & (F.length("text") < 100), "search").alias("name"),
    )
    return D.collaboration_log(msgs, **KEYS)


@query("clean_transcript", """
WITH heard AS (SELECT doc_id, replace(text, '''', ' ') AS said, CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 11 = 0 THEN 2 WHEN lang = 'es' THEN 3 END AS kind FROM documents)
SELECT doc_id, CASE kind WHEN 1 THEN '  ' || chr(10) WHEN 2 THEN 'text='''' ' || said ELSE CASE WHEN kind IS NULL AND said = '' THEN 'Hypothesis(score=1, text='''', ok)' ELSE said END END AS query,
       CASE WHEN kind = 1 OR (kind = 3 AND regexp_full_match(said, '\\s*')) OR (kind IS NULL AND said <> '' AND regexp_full_match(said, '\\s*')) THEN 'No speech detected in audio' END AS error FROM heard""")
def clean_transcript(spark, sf):
    """Whole texts as transcripts: wrapped, bare (Spanish), blank, and with an empty wrapper before the text."""
    said = F.replace("text", F.lit("'"), F.lit(" "))
    wrapped = F.concat(F.lit("Hypothesis(score=1, text='"), said, F.lit("', ok)"))
    bare = F.when(F.col("lang") == "es", said).otherwise(wrapped)
    heard = F.when(F.col("doc_id") % 7 == 0, "  \n").when(F.col("doc_id") % 11 == 0, F.concat(F.lit("text='' "), said)).otherwise(bare)
    return D.clean_transcript(table(spark, sf, "documents").select("doc_id", heard.alias("transcript"))).select("doc_id", "query", "error")


@query("quality_score_extract", """
SELECT conv_id, turn, CASE WHEN turn % 5 IN (0, 1) AND length(text) % 13 BETWEEN 1 AND 10 THEN (length(text) % 13)::INTEGER
                           WHEN turn % 5 = 2 THEN 7 END AS quality_score FROM conversations""")
def quality_score_extract(spark, sf):
    """Every message as a review: a score by name, one out of ten, both, none, and a decimal text."""
    n, kind, text = (F.length("text") % 13).cast("string"), F.col("turn") % 5, F.regexp_replace("text", "(?i)score|[0-9]", "")
    review = (
        F.when(kind == 0, F.concat(text, F.lit("\nHelpfulness score: "), n))
        .when(kind == 1, F.concat(text, F.lit(" I give it "), n, F.lit(" / 10.")))
        .when(kind == 2, F.concat(F.lit("**Score**: 7 (not 3/10). "), text).cast("string"))
        .otherwise(text)
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", review.alias("review"))
    return R.quality_score_extract(rows, col="review").drop("review")


# --- reasoning --------------------------------------------------------------------------------

THOUGHT_SQL = """
WITH traces AS (SELECT conv_id, turn, text AS body, CASE
    WHEN length(text) < 100 THEN text
    WHEN length(text) < 200 THEN '<think> ' || text || chr(10) || '</think> Done ' || turn || chr(10)
    WHEN length(text) < 300 THEN '<think>' || text || '</think>a</think> b'
    ELSE '<think>' || text END AS text, length(text) AS n FROM conversations)
"""


def traces(spark, sf):
    n, text = F.length("text"), F.col("text")
    wrapped = (
        F.when(n < 100, text)
        .when(n < 200, F.concat(F.lit("<think> "), text, F.lit("\n</think> Done "), F.col("turn").cast("string"), F.lit("\n")))
        .when(n < 300, F.concat(F.lit("<think>"), text, F.lit("</think>a</think> b")))
        .otherwise(F.concat(F.lit("<think>"), text))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", wrapped.alias("text"))


@query("split_reasoning", THOUGHT_SQL + r"""
SELECT conv_id, turn,
       CASE WHEN n < 100 OR n >= 300 THEN 'No internal reasoning trace provided.' ELSE regexp_replace(body, '^\s+|\s+$', '', 'g') END AS reasoning,
       CASE WHEN n < 100 OR n >= 300 THEN text WHEN n < 200 THEN 'Done ' || turn ELSE 'b' END AS answer FROM traces""")
def split_reasoning(spark, sf):
    return R.split_reasoning(traces(spark, sf), col="text").drop("text")


@query("split_reasoning_partition", THOUGHT_SQL + """
SELECT conv_id, turn,
       CASE WHEN n < 100 THEN text WHEN n < 200 THEN '<think> ' || body || chr(10) ELSE '<think>' || body END AS reasoning,
       CASE WHEN n < 100 OR n >= 300 THEN '' WHEN n < 200 THEN ' Done ' || turn || chr(10) ELSE 'a</think> b' END AS answer FROM traces""")
def split_reasoning_partition(spark, sf):
    return R.split_reasoning(traces(spark, sf), col="text", rule="partition").drop("text")


TOKENS_SQL = """
WITH reqs AS (
  SELECT conv_id, turn, role, list_transform(string_split(replace(text, chr(10), ' ~ '), ' '), lambda w: CASE WHEN w = '~' THEN 1 ELSE length(w) + 1 END)::INTEGER[] AS ids,
         CASE WHEN role = 'user' THEN 20 WHEN length(text) < 200 THEN NULL ELSE 30 END AS own_budget,
         CASE WHEN role = 'assistant' THEN 3 END AS own_grace FROM conversations),
limits AS (SELECT *, coalesce(own_budget, 10) AS budget, coalesce(own_grace, 8) AS grace, len(ids) AS n FROM reqs)
"""


def token_requests(spark, sf):
    """Word lengths as tokens, 1 for a line break. Prompts of system messages do not ask for thought."""
    words = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ~ ")), " ")
    ids = F.transform(words, lambda w: F.when(w == "~", 1).otherwise(F.length(w) + 1))
    prompt = F.when(F.col("role") == "system", F.array(F.lit(7))).otherwise(F.array(F.lit(7), F.lit(8), F.lit(9)))
    rows = table(spark, sf, "conversations")
    reqs = rows.select("conv_id", "turn", "role", ids.alias("output_ids"), prompt.alias("prompt_ids"), F.concat_ws("/", "conv_id", "turn").alias("req_id"))
    overrides = rows.select(
        F.concat_ws("/", "conv_id", "turn").alias("req_id"),
        F.when(F.col("role") == "user", 20).when(F.length("text") < 200, None).otherwise(30).alias("budget"),
        F.when(F.col("role") == "assistant", 3).alias("grace"),
        F.lit(None).cast("array<int>").alias("end_ids"),
    )
    return R.budget_overrides(reqs, overrides, defaults={"budget": 10, "grace": 8, "end_ids": [5, 6, 99]})


@query("budget_overrides", TOKENS_SQL + "SELECT conv_id, turn, budget, grace, '5,6,99' AS end_ids FROM limits")
def budget_overrides(spark, sf):
    return token_requests(spark, sf).select("conv_id", "turn", "budget", "grace", F.array_join(F.col("end_ids").cast("array<string>"), ",").alias("end_ids"))


@query("truncate_reasoning", TOKENS_SQL + """,
stops AS (SELECT *, list_min(list_filter(range(0, n + 1), lambda L: L >= budget AND (L >= budget + grace OR (L > 0 AND ids[L] = 1)))) AS s,
                 list_min(list_filter(range(1, n + 1), lambda L: ids[L] = 13)) AS nat FROM limits),
cuts AS (SELECT *, CASE WHEN role <> 'system' AND (nat IS NULL OR nat > s) THEN s END AS stop_at FROM stops),
kept AS (SELECT *, CASE WHEN stop_at >= 2 AND ids[stop_at - 1] = 5 AND ids[stop_at] = 6 THEN [99] WHEN stop_at >= 1 AND ids[stop_at] = 5 THEN [6, 99] ELSE [5, 6, 99] END AS tail FROM cuts)
SELECT conv_id, turn, stop_at::INTEGER AS stop_at, array_to_string(CASE WHEN stop_at IS NULL THEN ids ELSE list_concat(ids[1:stop_at], tail) END, ',') AS kept_ids FROM kept""")
def truncate_reasoning(spark, sf):
    out = R.truncate_reasoning(token_requests(spark, sf), newline_ids=[1], natural_ids=[[13]], think_ids=[8, 9])
    return out.select("conv_id", "turn", "stop_at", F.array_join(F.col("kept_ids").cast("array<string>"), ",").alias("kept_ids"))


@query("budget_accounting", THOUGHT_SQL + r""",
used AS (SELECT *, CASE WHEN contains(text, '</think>') THEN text ELSE text || '.' || chr(10) || '</think>' || chr(10) || chr(10) END AS closed,
                (n // 4)::BIGINT AS tokens_used, CASE WHEN n < 120 THEN 40 ELSE 80 END::BIGINT AS max_tokens, 60::BIGINT AS budget FROM traces)
SELECT conv_id, turn, closed, max_tokens - tokens_used AS remaining,
       regexp_replace(regexp_replace(regexp_replace(closed, '\s+$', ''), '</think>$', ''), '^\s+|\s+$', '', 'g') AS reasoning_text,
       CASE WHEN max_tokens <= budget THEN 'reasoning_budget must be smaller than max_tokens' WHEN max_tokens - tokens_used <= 0 THEN 'remaining tokens must be positive' END AS violation FROM used""")
def budget_accounting(spark, sf):
    body = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    rows = traces(spark, sf).join(body, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("reasoning"), F.expr("n div 4").alias("tokens_used"),
        F.when(F.col("n") < 120, 40).otherwise(80).cast("long").alias("max_tokens"), F.lit(60).cast("long").alias("budget"),
    )
    return R.budget_accounting(rows).select("conv_id", "turn", "closed", "remaining", "reasoning_text", "violation")


# --- safety -----------------------------------------------------------------------------------

_LINES = "\n".join(f"{c}: {n}. " for c, n in SAFETY_TAXONOMY)
_HEAD = f"{SAFETY_TASK}\n\n<BEGIN UNSAFE CONTENT CATEGORIES>\n{_LINES}\n<END UNSAFE CONTENT CATEGORIES>\n\n<BEGIN CONVERSATION>\n\nuser: "
_TAIL = f"\n<END CONVERSATION>\n\n{SAFETY_FORMAT}\n\n{SAFETY_ENDING}"


@query("render_template", f"""
SELECT conv_id, turn, {quoted(_HEAD)} || text || chr(10) || CASE WHEN role = 'assistant' THEN chr(10) || 'response: agent: ' || text || chr(10) ELSE '' END || {quoted(_TAIL)} AS prompt
FROM conversations""")
def render_template(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("response", F.when(F.col("role") == "assistant", F.col("text")).when(F.col("role") == "system", ""))
    return S.render_template(rows, query="text", response="response").select("conv_id", "turn", "prompt")


VERDICTS_SQL = """
WITH cases AS (
  SELECT doc_id AS case_id, CASE
    WHEN toxic = 1 AND quality = 1 THEN '{"User Safety": "Unsafe", "Safety Categories": "Violence, S9, S16: Fraud/Deception, Nonsense"}'
    WHEN toxic = 1 THEN '{"User Safety": "safe", "Response Safety": "unsafe", "Safety Categories": "Harassment"}'
    WHEN quality = 0 THEN 'unsafe, because' WHEN n_chars < 600 THEN '{"User Safety": "SAFE"}' WHEN n_chars < 1200 THEN '{}'
    ELSE '{"User Safety": "safe", "Response Safety": "safe"}' END AS raw,
    CASE WHEN toxic = 1 AND quality = 1 THEN 1 WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 3 WHEN n_chars < 600 THEN 4 WHEN n_chars < 1200 THEN 5 ELSE 6 END AS kind,
    text, lang
  FROM labels JOIN documents USING (doc_id))
"""


def verdicts(spark, sf):
    toxic, good, n = F.col("toxic") == 1, F.col("quality") == 1, F.col("n_chars")
    raw = (
        F.when(toxic & good, '{"User Safety": "Unsafe", "Safety Categories": "Violence, S9, S16: Fraud/Deception, Nonsense"}')
        .when(toxic, '{"User Safety": "safe", "Response Safety": "unsafe", "Safety Categories": "Harassment"}')
        .when(~good, "unsafe, because")
        .when(n < 600, '{"User Safety": "SAFE"}')
        .when(n < 1200, "{}")
        .otherwise('{"User Safety": "safe", "Response Safety": "safe"}')
    )
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("doc_id").alias("case_id"), raw.alias("raw"), "text", "lang")


@query("parse_safety", VERDICTS_SQL + """
SELECT case_id, CASE kind WHEN 1 THEN 'Unsafe' WHEN 3 THEN 'unknown' WHEN 4 THEN 'SAFE' WHEN 5 THEN NULL ELSE 'safe' END AS user_safety,
       CASE kind WHEN 2 THEN 'unsafe' WHEN 6 THEN 'safe' END AS response_safety,
       CASE WHEN kind <> 3 THEN json_extract_string(CASE WHEN kind = 3 THEN '{}' ELSE raw END, '$."Safety Categories"') END AS categories,
       CASE WHEN kind = 3 THEN raw END AS raw_response FROM cases""")
def parse_safety(spark, sf):
    return S.parse_safety(verdicts(spark, sf)).select("case_id", "verdict.*")


@query("is_safe", VERDICTS_SQL + "SELECT case_id, kind IN (4, 6) AS is_safe FROM cases")
def is_safe(spark, sf):
    return S.is_safe(S.parse_safety(verdicts(spark, sf))).select("case_id", "is_safe")


@query("safety_categories", VERDICTS_SQL + """
SELECT case_id, category, code, name FROM cases JOIN (VALUES
  (1, 'Violence', 'S1', 'Violence'), (1, 'S9', 'S9', 'PII/Privacy'), (1, 'S16: Fraud/Deception', 'S16', 'Fraud/Deception'), (1, 'Nonsense', NULL, NULL),
  (2, 'Harassment', 'S10', 'Harassment')) AS t(k, category, code, name) ON kind = k""")
def safety_categories(spark, sf):
    return S.safety_categories(S.parse_safety(verdicts(spark, sf)))


@query("guard_flow", VERDICTS_SQL + """
SELECT case_id,
       CASE WHEN kind IN (1, 3, 5) THEN 'I cannot process this request due to safety concerns.' WHEN lang = 'de' THEN NULL
            WHEN kind = 2 THEN 'The generated response was filtered due to safety concerns.' ELSE text END AS final_response,
       CASE WHEN kind IN (1, 3, 5) THEN 'input_validation' WHEN lang = 'de' THEN 'agent_execution' WHEN kind = 2 THEN 'output_validation' END AS blocked_at,
       kind IN (4, 6) AND lang <> 'de' AS is_safe FROM cases""")
def guard_flow(spark, sf):
    rows = S.parse_safety(verdicts(spark, sf), out="input_verdict").withColumn("output_verdict", F.col("input_verdict"))
    rows = rows.withColumns({"response": F.col("text"), "error": F.when(F.col("lang") == "de", "timeout")})
    return S.guard_flow(rows).select("case_id", "final_response", "blocked_at", "is_safe")


# --- injected client --------------------------------------------------------------------------


def echo_client():
    """A local stand-in for a model: answers with the length, refuses empty lines at the end."""

    def call(text: str) -> str:
        if text.endswith("?"):
            raise ValueError("no questions")
        return f"{len(text)} characters"

    return call


@query("llm_map", """
SELECT doc_id, CASE WHEN text NOT LIKE '%?' THEN length(text) || ' characters' END AS answer,
       CASE WHEN text LIKE '%?' THEN 'ValueError: no questions' END AS answer_error FROM documents""")
def llm_map(spark, sf):
    return N.llm_map(table(spark, sf, "documents").select("doc_id", "text"), col="text", client=echo_client).drop("text")
