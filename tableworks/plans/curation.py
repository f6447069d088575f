"""Queries that describe, select and clean the documents of a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import STOP_WORDS
from ..functions.blocks import page_text
from ..functions.pii import PATTERNS
from ..operators import bm25 as B
from ..operators import curation as C
from ..operators import overlap as O
from ..operators import schemas as J
from ..session import scratch_path, table
from .registry import query

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

# --- exact duplicates, labels --------------------------------------------------------------------


@query("exact_dedup", r"""
WITH h AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS kept_id, count(*) OVER (PARTITION BY h) AS n_copies, doc_id = min(doc_id) OVER (PARTITION BY h) AS kept FROM h""")
def exact_dedup(spark, sf):
    return C.exact_dedup(table(spark, sf, "documents"), key="doc_id", text="text")


@query("safety_filter", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def safety_filter(spark, sf):
    return C.safety_filter(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), key="doc_id", flag="toxic")


@query("safety_rates", """
SELECT source, count(*) AS n_rows, count(toxic) AS n_labelled, coalesce(sum((toxic = 1)::BIGINT), 0)::BIGINT AS n_flagged,
       sum((toxic = 1)::BIGINT) / nullif(count(toxic), 0) AS flagged_share
FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source""")
def safety_rates(spark, sf):
    return C.safety_rates(table(spark, sf, "documents"), table(spark, sf, "labels"), key="doc_id", flag="toxic", by="source")


# --- personal data -------------------------------------------------------------------------------

_LUHN = """list_sum(list_transform(regexp_extract_all(reverse(regexp_replace(h, '[ -]', '', 'g')), '.'), lambda d, i:
  CASE WHEN i % 2 = 0 THEN CASE WHEN d::INTEGER > 4 THEN d::INTEGER * 2 - 9 ELSE d::INTEGER * 2 END ELSE d::INTEGER END)) % 10 = 0"""
_CHECKS = {
    "IBAN": """list_reduce([0::BIGINT] || list_transform(regexp_extract_all(h[5:] || h[1:4], '.'), lambda c:
      CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE ascii(c) - 55 END), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1""",
    "CARD": f"length(regexp_replace(h, '[ -]', '', 'g')) <= 19 AND {_LUHN}",
    "SSN": "h[1:3] NOT IN ('000', '666') AND h[1:1] <> '9' AND h[5:6] <> '00' AND h[8:] <> '0000'",
    "IP": "list_max(list_transform(string_split(h, '.'), lambda x: x::INTEGER)) <= 255",
}


def _masks() -> str:
    """A step per kind: the text with marks in place of what earlier kinds took."""
    steps, before = [], "SELECT doc_id, text AS t FROM documents"
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        quoted = pattern.replace("'", "''")
        mark = f"chr({0xFDD0 + k}) || repeat(chr({0xFDEF}), length(h) - 1)"
        hit = f"list_transform(regexp_extract_all(t, '{quoted}'), lambda h: CASE WHEN {_CHECKS.get(kind, 'true')} THEN {mark} ELSE h END)"
        steps.append(
            f"s{k} AS (SELECT doc_id, CASE WHEN t IS NULL THEN NULL ELSE list_aggregate(list_transform(list_zip(regexp_split_to_array(t, '{quoted}'), {hit}), "
            f"lambda x: coalesce(x[1], '') || coalesce(x[2], '')), 'string_agg', '') END AS t FROM ({before}))"
        )
        before = f"SELECT * FROM s{k}"
    return "WITH " + ",\n".join(steps)


_MASKS, _LAST = _masks(), f"s{len(PATTERNS) - 1}"
_NAMES = "[" + ", ".join(f"'{k}'" for k in PATTERNS) + "]"
_SPAN = f"[{chr(0xFDD0)}-{chr(0xFDD0 + len(PATTERNS) - 1)}]{chr(0xFDEF)}*"
_REDACT = "t"
for _k, _kind in enumerate(PATTERNS):
    _REDACT = f"regexp_replace({_REDACT}, '{chr(0xFDD0 + _k)}{chr(0xFDEF)}*', '[{_kind}]', 'g')"


@query("pii_detect", f"""{_MASKS},
found AS (SELECT doc_id, regexp_extract_all(t, '{_SPAN}') AS hits, regexp_split_to_array(t, '{_SPAN}') AS gaps FROM {_LAST}),
spans AS (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM found)
SELECT doc_id, ({_NAMES})[ord(hits[i]) - {0xFDD0 - 1}] AS kind, length(hits[i]) AS size,
       (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))::BIGINT AS start FROM spans""")
def pii_detect(spark, sf):
    return C.pii_detect(table(spark, sf, "documents"), key="doc_id", text="text")


@query("pii_redact", f"{_MASKS} SELECT doc_id, {_REDACT} AS text FROM {_LAST}")
def pii_redact(spark, sf):
    return C.pii_redact(table(spark, sf, "documents").select("doc_id", "text"), col="text")


# --- benchmark overlap, lexical scores --------------------------------------------------------------


@query("benchmark_overlap", f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), v AS (SELECT item_id, {WORDS} AS w FROM benchmark),
g AS (SELECT doc_id, array_to_string(w[i:i + 7], ' ') AS gram, i AS pos FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
b AS (SELECT item_id, array_to_string(w[i:i + 7], ' ') AS gram, i AS item_pos FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM v WHERE len(w) >= 8)),
sizes AS (SELECT item_id, count(DISTINCT gram) AS n FROM b GROUP BY item_id),
hits AS (SELECT doc_id, item_id, gram, pos, pos - item_pos AS d FROM g JOIN b USING (gram)),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY pos) AS k FROM hits),
runs AS (SELECT doc_id, item_id, count(*) + 7 AS run FROM islands GROUP BY doc_id, item_id, d, k),
longest AS (SELECT doc_id, item_id, max(run) AS longest_run FROM runs GROUP BY ALL),
shared AS (SELECT doc_id, item_id, count(DISTINCT gram) AS n_shared FROM hits GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_shared / n AS containment, longest_run FROM shared JOIN longest USING (doc_id, item_id) JOIN sizes USING (item_id)""")
def benchmark_overlap(spark, sf):
    return O.benchmark_overlap(
        table(spark, sf, "documents"), table(spark, sf, "benchmark"), key="doc_id", text="text", item_key="item_id", item_text="text"
    )


@query("bm25_topk", f"""
WITH c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS size FROM c GROUP BY doc_id), t AS (SELECT count(*) AS n, avg(size) AS mean FROM l),
f AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM c, t GROUP BY term, n),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
      FROM q JOIN f USING (term) JOIN c USING (term) JOIN l USING (doc_id), t GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s)
SELECT item_id, rank, score FROM r WHERE rank <= 5""")
def bm25_topk(spark, sf):
    """Scores alone are compared: documents whose sums differ in the last digits may change places."""
    index = B.bm25_index(table(spark, sf, "documents"), scratch_path(spark, "bm25"), key="doc_id", text="text")
    best = B.bm25_topk(index, table(spark, sf, "benchmark"), key="item_id", text="text", k=5)
    return best.select("item_id", "rank", F.round("score", 6).alias("score"))


# --- pages ---------------------------------------------------------------------------------------


@query("html_to_text", r"""
WITH a AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
                  regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, replace(replace(title, '&quot;', '"'), '&amp;', '&') AS title, lang,
             list_filter(list_transform(regexp_split_to_array(body, '</?(?:p|h1|br|ul|li)(?: [^>]*)?>'), lambda x:
               trim(regexp_replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM a)
SELECT page_id, nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), '') AS title, lang, array_to_string(parts, chr(10)) AS text, len(parts)::INTEGER AS n_content FROM b""")
def html_to_text(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", page_text("html").alias("p"))
    return rows.select("page_id", "p.title", "p.lang", "p.text", (F.col("p.n_blocks") - F.col("p.n_boilerplate")).alias("n_content"))


# --- schemas ---------------------------------------------------------------------------------------


def event_records(spark, sf):
    """Props of events, every seventh with a field of another type, every eleventh without it, every thirteenth broken."""
    i = F.col("event_id")
    record = F.to_json(F.struct(
        F.col("user_id").alias("user"), F.when(i % 11 != 0, F.when(i % 7 == 0, F.col("event_type")).otherwise("value")).alias("kind"),
        F.array(F.struct(F.when(i % 5 == 0, F.lit("x")).alias("tag"), F.col("value").alias("v"))).alias("parts"),
    ))
    number = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "kind": 5, "parts": []}'))
    return table(spark, sf, "events").select("event_id", "event_type", F.when(i % 13 == 0, F.substr(record, F.lit(2))).when(i % 17 == 0, number).otherwise(record).alias("record"))


@query("schema_check", """
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '$' WHEN event_id % 17 = 0 THEN '$.kind' WHEN event_id % 11 = 0 THEN '$.kind'
                      WHEN event_id % 5 <> 0 THEN '$.parts[].tag' END AS failed_path FROM events""")
def schema_check(spark, sf):
    part = T.StructType([T.StructField("tag", T.StringType(), False), T.StructField("v", T.DoubleType())])
    schema = T.StructType([
        T.StructField("user", T.LongType(), False), T.StructField("kind", T.StringType(), False), T.StructField("parts", T.ArrayType(part), False),
    ])
    return J.schema_check(event_records(spark, sf), text="record", schema=schema).select("event_id", "failed_path")


@query("infer_schema", """
SELECT event_type, count(*) AS n_rows, count(*) FILTER (event_id % 13 <> 0) AS n_json, 'OBJECT<k: BIGINT>' AS props FROM events GROUP BY event_type""")
def infer_schema(spark, sf):
    """Records for the counts, the given props for the schema."""
    records = J.infer_schema(event_records(spark, sf), text="record", by=["event_type"]).drop("schema")
    props = J.infer_schema(table(spark, sf, "events"), text="props", by=["event_type"]).select("event_type", F.col("schema").alias("props"))
    return records.join(props, "event_type")


# --- samples, statistics, rules ----------------------------------------------------------------------

SIZES = {"tiny": 5, "small": 25, "medium": 120}


@query("scale_sample", """
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN r <= 5 THEN 'tiny' WHEN r <= 25 THEN 'small' ELSE 'medium' END AS sample,
       least(1, CASE WHEN r <= 5 THEN 5 WHEN r <= 25 THEN 25 ELSE 120 END / n)::DOUBLE AS probability FROM r WHERE r <= 120""")
def scale_sample(spark, sf):
    return C.scale_sample(table(spark, sf, "documents").select("doc_id", "lang"), key="doc_id", sizes=SIZES, by=["lang"])


@query("partition_stats", f"""
WITH d AS (SELECT lang, source, text, length(text) AS c, len({WORDS}) AS w FROM documents)
SELECT lang, source, (grouping(lang) + grouping(source))::INTEGER AS level, count(*) AS n_rows, count(*) - count(text) AS n_null, sum(c)::BIGINT AS n_chars, sum(w)::BIGINT AS n_words,
       max(c) AS max_chars, count(DISTINCT text) AS n_distinct, true AS close FROM d GROUP BY ROLLUP (lang, source)""")
def partition_stats(spark, sf):
    """Beside the sketched number of distinct texts stands the exact one; they may differ by a twentieth."""
    docs = table(spark, sf, "documents")
    stats = C.partition_stats(docs, by=["lang", "source"], text="text")
    exact = docs.rollup("lang", "source").agg(F.bit_count(F.grouping_id()).cast("int").alias("g"), F.countDistinct("text").alias("n_distinct"))
    exact = exact.select(F.col("lang").alias("l"), F.col("source").alias("s"), "g", "n_distinct")
    both = stats.join(exact, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("level") == F.col("g")))
    close = F.abs(F.col("distinct_sketch") - F.col("n_distinct")) <= F.greatest(F.lit(1.0), 0.05 * F.col("n_distinct"))
    return both.select("lang", "source", "level", "n_rows", "n_null", "n_chars", "n_words", "max_chars", "n_distinct", close.alias("close"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


@query("quality_filter", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, text, {WORDS} AS w, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS lines FROM d),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM e),
g AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram,
             i <= max(i) OVER (PARTITION BY doc_id) - 4 AS whole FROM p),
h AS (SELECT *, whole AND count(*) OVER (PARTITION BY doc_id, gram, whole) > 1 AS again FROM g),
k AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM h),
r AS (SELECT doc_id, sum(CASE WHEN covered THEN length(word) ELSE 0 END) / sum(length(word)) AS repeated_gram_share FROM k GROUP BY doc_id),
m AS (SELECT e.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 0) AS mean_word,
             coalesce(length(regexp_replace(text, '[\p{{L}}\p{{N}}\s.,;:!?''"()-]+', '', 'g')) / nullif(length(regexp_replace(text, '\s+', '', 'g')), 0), 0) AS symbol_share,
             coalesce((len(lines) - len(list_distinct(lines))) / nullif(len(lines), 0), 0) AS repeated_line_share, coalesce(repeated_gram_share, 0) AS repeated_gram_share,
             coalesce(len(list_filter(w, lambda x: list_contains({_STOPS}, x))) / nullif(len(w), 0), 0) AS stop_share
      FROM e LEFT JOIN r ON e.doc_id = r.doc_id),
t AS (SELECT m.*, list_filter([CASE WHEN n_words < 5 THEN 'n_words' END, CASE WHEN mean_word < 1.5 OR mean_word > 12 THEN 'mean_word' END, CASE WHEN symbol_share > 0.1 THEN 'symbol_share' END,
        CASE WHEN repeated_line_share > 0.3 THEN 'repeated_line_share' END, CASE WHEN repeated_gram_share > 0.3 THEN 'repeated_gram_share' END,
        CASE WHEN stop_share < 0.02 THEN 'stop_share' END], lambda x: x IS NOT NULL) AS f FROM m)
SELECT doc_id, n_words, round(mean_word, 9) AS mean_word, round(symbol_share, 9) AS symbol_share, round(repeated_line_share, 9) AS repeated_line_share,
       round(repeated_gram_share, 9) AS repeated_gram_share, round(stop_share, 9) AS stop_share, array_to_string(f, ',') AS failed, len(f) = 0 AS passed, quality::BIGINT AS quality
FROM t LEFT JOIN labels USING (doc_id)""")
def quality_filter(spark, sf):
    """Rules and measures beside the labels that some documents have."""
    rows = C.quality_filter(table(spark, sf, "documents").select("doc_id", "text"), text="text", stop_words=STOP_WORDS)
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    shares = [F.round(c, 9).alias(c) for c in ("mean_word", "symbol_share", "repeated_line_share", "repeated_gram_share", "stop_share")]
    return rows.join(labels, "doc_id", "left").select("doc_id", "n_words", *shares, F.array_join("failed", ",").alias("failed"), "passed", "quality")
