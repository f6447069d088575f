"""Queries over parsed page layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import BLOCK_TYPES
from ..operators import layout as L
from ..session import scratch_path, table
from ..sources import tables as S
from .registry import query

# --- blocks from documents: every line is a block ---------------------------------------------

_TYPES_SQL = "[" + ", ".join(f"'{t}'" for t in BLOCK_TYPES) + "]"

BLOCKS_SQL = f"""
WITH lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS id FROM documents),
blocks AS (
  SELECT doc_id, lang, id, ({_TYPES_SQL})[id % 14 + 1] AS type, text, id % 11 <> 10 AS boxed, (id % 7) / 10.0::DOUBLE AS xmin, (id % 5) / 10.0::DOUBLE AS ymin,
         (id % 7) / 10.0::DOUBLE + CASE WHEN id % 6 = 5 THEN 0 ELSE 0.25 END AS xmax, (id % 5) / 10.0::DOUBLE + 0.125 AS ymax FROM lines)
"""


def document_blocks(spark, sf):
    """Documents with an array of layout blocks: type and box follow from the line number."""
    types = F.array(*[F.lit(t) for t in BLOCK_TYPES])

    def block(line, i):
        x, y = (i % 7) / F.lit(10.0), (i % 5) / F.lit(10.0)
        box = F.struct(
            x.alias("xmin"), y.alias("ymin"), (x + F.when(i % 6 == 5, 0).otherwise(0.25)).alias("xmax"), (y + 0.125).alias("ymax")
        )
        return F.struct(F.get(types, i % 14).alias("type"), line.alias("text"), F.when(i % 11 != 10, box).alias("bbox"))

    return table(spark, sf, "documents").select("doc_id", "lang", F.transform(F.split("text", "\n"), block).alias("blocks"))


@query("parse_blocks_json", BLOCKS_SQL + """
SELECT doc_id, id, type, text, CASE WHEN boxed THEN round(xmin, 6) END AS xmin, CASE WHEN boxed THEN round(ymax, 6) END AS ymax FROM blocks WHERE lang IN ('en', 'fr')""")
def parse_blocks_json(spark, sf):
    """English as a list, French as a list of lists, German broken, Spanish a bare object."""
    text, lang = F.to_json("blocks"), F.col("lang")
    raw = (
        F.when(lang == "en", text)
        .when(lang == "fr", F.concat(F.lit("["), text, F.lit(', [{"type": "Text", "text": "second list"}]]')))
        .when(lang == "de", F.concat(text, F.lit("]")))
        .otherwise('{"type": "Text", "text": "no list"}')
    )
    parsed = L.parse_blocks_json(document_blocks(spark, sf).select("doc_id", raw.alias("arguments")))
    rows = parsed.select("doc_id", F.posexplode_outer("blocks").alias("id", "b")).where("id IS NOT NULL")
    return rows.select("doc_id", F.col("id").cast("long").alias("id"), "b.type", "b.text", F.round("b.bbox.xmin", 6).alias("xmin"), F.round("b.bbox.ymax", 6).alias("ymax"))


@query("blocks_preview", """
SELECT doc_id, 0::BIGINT AS id, 'Text' AS type, substr(replace(text, chr(10), ' '), 1, 200) AS text FROM documents
UNION ALL SELECT doc_id, 1, 'Caption', '' FROM documents""")
def blocks_preview(spark, sf):
    """Each whole document as one block, and one block without text."""
    box = F.lit(None).cast("struct<xmin:double,ymin:double,xmax:double,ymax:double>").alias("bbox")
    whole = F.struct(F.lit("Text").alias("type"), F.col("text"), box)
    empty = F.struct(F.lit("Caption").alias("type"), F.lit(None).cast("string").alias("text"), box)
    return L.blocks_preview(table(spark, sf, "documents").select("doc_id", F.array(whole, empty).alias("blocks"))).drop("bbox")


def records(spark, sf):
    return L.blocks_to_records(document_blocks(spark, sf).withColumn("page", F.lit(1)), width=1536, height=2048)


RECORDS_SQL = BLOCKS_SQL + """,
records AS (SELECT doc_id, 1::INTEGER AS page, id, type, text, CASE WHEN boxed THEN concat_ws(',', trunc(xmin * 1536)::INTEGER, trunc(ymin * 2048)::INTEGER, trunc(xmax * 1536)::INTEGER, trunc(ymax * 2048)::INTEGER) ELSE '0,0,0,0' END AS bbox_px,
                   boxed AND id % 6 <> 5 AS valid FROM blocks)
"""


def _with_px(df):
    return df.select("doc_id", "page", "id", "type", "text", F.array_join(F.col("bbox_px").cast("array<string>"), ",").alias("bbox_px"))


@query("blocks_to_records", RECORDS_SQL + "SELECT doc_id, page, id, type, text, bbox_px FROM records")
def blocks_to_records(spark, sf):
    return _with_px(records(spark, sf))


@query("valid_bbox", RECORDS_SQL + "SELECT doc_id, page, id, type, text, bbox_px FROM records WHERE valid")
def valid_bbox(spark, sf):
    return _with_px(L.valid_bbox(records(spark, sf)))


@query("export_records_jsonl", RECORDS_SQL + "SELECT doc_id, page, id, type, text, bbox_px FROM records")
def export_records_jsonl(spark, sf):
    rows = records(spark, sf)
    path = scratch_path(spark, "records")
    S.export_records_jsonl(rows, path)
    return _with_px(spark.read.schema(rows.schema).json(path))


# --- LaTeX ------------------------------------------------------------------------------------


def order_tables(spark, sf):
    latex = F.concat(
        F.lit(r"before \begin{tabular}{|l|l|} \hline Order & Value \\ \hline Status & "), "o_orderstatus",
        F.lit(r" \\ \textbf{Priority} & R\&D \_ "), "o_orderpriority", F.lit(r" \\ & \% \textless "), F.col("o_custkey").cast("string"),
        F.lit(r" \\ & \\ \end{tabular} after"),
    )
    return table(spark, sf, "orders").select("o_orderkey", latex.alias("latex"))


@query("latex_table_cells", r"""
SELECT o_orderkey, r::BIGINT AS "row", c::BIGINT AS col, 1::BIGINT AS rowspan, 1::BIGINT AS colspan,
       CASE WHEN r = 0 THEN CASE c WHEN 0 THEN 'Order' ELSE 'Value' END WHEN r = 1 AND c = 0 THEN 'Status' WHEN r = 1 THEN o_orderstatus
            WHEN r = 2 AND c = 0 THEN '<b>Priority</b>' WHEN r = 2 THEN 'R&D _ ' || o_orderpriority ELSE '\% < ' || o_custkey END AS content
FROM orders, (VALUES (0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0)) AS t(r, c)""")
def latex_table_cells(spark, sf):
    return L.latex_table_cells(order_tables(spark, sf), col="latex", key="o_orderkey")


def customer_tables(spark, sf):
    latex = F.concat(
        F.lit(r"\begin{tabular}{lll} \multicolumn{3}{c}{\textit{"), "c_name", F.lit(r"}} \\ \multirow{2}{*}{"), "c_mktsegment",
        F.lit(r"} & a & b \\ \multicolumn{2}{r}{\multirow{2}{*}{"), F.col("c_nationkey").cast("string"), F.lit(r"}} \\ last & z \\ \end{tabular}"),
    )
    return table(spark, sf, "customer").select("c_custkey", latex.alias("latex"))


SPANS_SQL = r"""
WITH cells AS (SELECT c_custkey, r::BIGINT AS "row", c::BIGINT AS col, rs::BIGINT AS rowspan, cs::BIGINT AS colspan,
       CASE k WHEN 'name' THEN '<i>' || c_name || '</i>' WHEN 'seg' THEN c_mktsegment WHEN 'nation' THEN c_nationkey::VARCHAR ELSE k END AS content
FROM customer, (VALUES (0, 0, 1, 3, 'name'), (1, 0, 2, 1, 'seg'), (1, 1, 1, 1, 'a'), (1, 2, 1, 1, 'b'), (2, 1, 2, 2, 'nation'), (3, 0, 1, 1, 'last'), (3, 3, 1, 1, 'z')) AS t(r, c, rs, cs, k))
"""


@query("latex_table_cells_spans", SPANS_SQL + "SELECT * FROM cells")
def latex_table_cells_spans(spark, sf):
    return L.latex_table_cells(customer_tables(spark, sf), col="latex", key="c_custkey")


@query("latex_table_html", SPANS_SQL + r""",
tagged AS (SELECT *, '    <' || CASE WHEN "row" = 0 THEN 'th' ELSE 'td' END || CASE WHEN colspan > 1 THEN ' colspan="' || colspan || '"' ELSE '' END || CASE WHEN rowspan > 1 THEN ' rowspan="' || rowspan || '"' ELSE '' END
                  || '>' || content || '</' || CASE WHEN "row" = 0 THEN 'th' ELSE 'td' END || '>' AS cell FROM cells),
rows AS (SELECT c_custkey, "row", '  <tr>' || chr(10) || string_agg(cell, chr(10) ORDER BY col) || chr(10) || '  </tr>' AS tr FROM tagged GROUP BY ALL)
SELECT c_custkey, '<table border="1" class="dataframe">' || chr(10) || string_agg(tr, chr(10) ORDER BY "row") || chr(10) || '</table>' AS html FROM rows GROUP BY c_custkey""")
def latex_table_html(spark, sf):
    return L.latex_table_html(customer_tables(spark, sf), col="latex").select("c_custkey", "html")


@query("clean_latex_text", r"""
SELECT o_orderkey, '<b>' || o_orderpriority || '</b> <i>x</i> & _ # < > ' || ' \$ \% ' || o_orderstatus AS text FROM orders""")
def clean_latex_text(spark, sf):
    raw = F.concat(F.lit(r"  \textbf{"), "o_orderpriority", F.lit(r"} \textit{x} \& \_ \# \textless \textgreater\newline \$ \% "), "o_orderstatus", F.lit(" \n"))
    return L.clean_latex_text(table(spark, sf, "orders").select("o_orderkey", raw.alias("text")), col="text")


@query("clean_md", r"""
SELECT doc_id, regexp_replace('- # [x] ' || source || ' ' || replace(text, '•', '-'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def clean_md(spark, sf):
    raw = F.concat(F.lit(" • \\# \\[x\\] "), "source", F.lit(" "), "text", F.lit("  "))
    return L.clean_md(table(spark, sf, "documents").select("doc_id", raw.alias("text")), col="text")


# --- pages ------------------------------------------------------------------------------------

PAGE_SQL = BLOCKS_SQL + r""",
shown AS (SELECT doc_id, id, type, CASE WHEN type = 'Table' THEN '\begin{tabular}{l}' || replace(text, '&', '+') || '\end{tabular}' ELSE text END AS text FROM blocks),
full_rows AS (SELECT doc_id, id, type, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text,
                     CASE WHEN type = 'List-item' THEN 1 WHEN type IN ('Table', 'Formula', 'Title', 'Section-header', 'Caption', 'Footnote') THEN 0 END AS event
              FROM shown WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
opened AS (SELECT *, event = 0 AND coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS closes,
                  regexp_replace(replace(text, '•', '-'), '\\([#>*_`~\-+!\[\]()])', '\1', 'g') AS t FROM full_rows),
lines_out AS (SELECT doc_id, id, CASE WHEN closes THEN chr(10) ELSE '' END || CASE type
    WHEN 'Title' THEN CASE WHEN t LIKE '#%' THEN t ELSE '# ' || t END
    WHEN 'Section-header' THEN CASE WHEN t LIKE '##%' THEN t ELSE '## ' || t END
    WHEN 'List-item' THEN '- ' || t
    WHEN 'Caption' THEN '> Caption: ' || t
    WHEN 'Footnote' THEN '<p><small>[Footnote] ' || t || '</small></p>'
    WHEN 'Formula' THEN '<pre><code>$$ ' || text || ' $$</code></pre>'
    WHEN 'Table' THEN CASE WHEN regexp_matches(text, '^\\begin\{tabular\}\{l\}\s*\\end\{tabular\}$') THEN '<pre><code>' || text || '</code></pre>'
      ELSE '<table border="1" class="dataframe">' || chr(10) || '  <tr>' || chr(10) || '    <th>' || regexp_replace(text[19:length(text) - 13], '^\s+|\s+$', '', 'g') || '</th>' || chr(10) || '  </tr>' || chr(10) || '</table>' END
    ELSE t END || CASE WHEN type = 'List-item' THEN '' ELSE chr(10) END AS piece FROM opened)
"""


def page_blocks(spark, sf):
    """Lines of documents as blocks of one page each, with tables as LaTeX."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("id", "line"))
    kind = F.get(F.array(*[F.lit(t) for t in BLOCK_TYPES]), F.col("id") % 14)
    latex = F.concat(F.lit(r"\begin{tabular}{l}"), F.replace("line", F.lit("&"), F.lit("+")), F.lit(r"\end{tabular}"))
    rows = lines.select("doc_id", F.lit(1).alias("page"), "id", kind.alias("type"), "line")
    return rows.withColumn("text", F.when(F.col("type") == "Table", latex).otherwise(F.col("line"))).drop("line")


MARKDOWN_SQL = PAGE_SQL + r"""
SELECT doc_id, 1::INTEGER AS page, 0::BIGINT AS segment, regexp_replace(string_agg(piece, chr(10) ORDER BY id), '\s+$', '') AS markdown FROM lines_out GROUP BY doc_id"""


@query("page_markdown", MARKDOWN_SQL)
def page_markdown(spark, sf):
    """Every document as a page."""
    return L.page_markdown(page_blocks(spark, sf), page=["doc_id", "page"])


KINDS_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS id FROM documents),
typed AS (SELECT doc_id, id, ({_TYPES_SQL})[id % 14 + 1] AS type, line FROM lines)
"""


@query("index_by_type", KINDS_SQL + "SELECT doc_id, id::BIGINT AS id, type FROM typed WHERE type IN ('Text', 'Table')")
def index_by_type(spark, sf):
    blocks = L.index_by_type(page_blocks(spark, sf), types=["Text", "Table"])
    return blocks.select("doc_id", F.col("id").cast("long").alias("id"), "type")


@query("page_block_stats", KINDS_SQL + r"""
SELECT doc_id, 1::INTEGER AS page, type, count(*) AS n_blocks,
       sum(length(line) + CASE WHEN type = 'Table' THEN length('\begin{tabular}{l}\end{tabular}') ELSE 0 END)::BIGINT AS n_chars FROM typed GROUP BY ALL""")
def page_block_stats(spark, sf):
    return L.page_block_stats(page_blocks(spark, sf), by=["doc_id", "page"])


HTML_SQL = PAGE_SQL + r""",
around AS (SELECT *, type = 'List-item' AS li, type NOT IN ('List-item', 'Table', 'Formula', 'Title', 'Section-header', 'Caption', 'Footnote') AS plain,
                  lag(type) OVER w AS before, lead(type) OVER w AS after, lead(replace(t, '&', '&amp;')) OVER w AS next_t, replace(t, '&', '&amp;') AS e,
                  replace(text, '&', '&amp;') AS et FROM opened WINDOW w AS (PARTITION BY doc_id ORDER BY id)),
shown_html AS (SELECT doc_id, id, CASE type
    WHEN 'Title' THEN '<h1>' || e || '</h1>'
    WHEN 'Section-header' THEN '<h2>' || e || '</h2>'
    WHEN 'Caption' THEN '<blockquote>' || chr(10) || '<p>Caption: ' || e || '</p>' || chr(10) || '</blockquote>'
    WHEN 'Footnote' THEN '<p>[Footnote] ' || e || '</p>'
    WHEN 'Formula' THEN '<pre><code>$$ ' || et || ' $$</code></pre>'
    WHEN 'List-item' THEN CASE WHEN before IS NOT DISTINCT FROM 'List-item' THEN '' ELSE '<ul>' || chr(10) END || '<li>' || e
      || CASE WHEN after NOT IN ('List-item', 'Table', 'Formula', 'Title', 'Section-header', 'Caption', 'Footnote') THEN chr(10) || next_t ELSE '' END || '</li>'
      || CASE WHEN after IS NOT DISTINCT FROM 'List-item' THEN '' ELSE chr(10) || '</ul>' END
    WHEN 'Table' THEN CASE WHEN regexp_matches(text, '^\\begin\{tabular\}\{l\}\s*\\end\{tabular\}$') THEN '<pre><code>' || et || '</code></pre>'
      ELSE '<table border="1" class="dataframe">' || chr(10) || '  <tr>' || chr(10) || '    <th>' || regexp_replace(text[19:length(text) - 13], '^\s+|\s+$', '', 'g') || '</th>' || chr(10) || '  </tr>' || chr(10) || '</table>' END
    ELSE '<p>' || e || '</p>' END AS piece FROM around WHERE NOT (plain AND before IS NOT DISTINCT FROM 'List-item'))
SELECT doc_id, 1::INTEGER AS page, 0::BIGINT AS segment, string_agg(piece, chr(10) ORDER BY id) AS html FROM shown_html GROUP BY doc_id"""


def html_pages(spark, sf):
    return L.page_html(L.page_markdown(page_blocks(spark, sf), page=["doc_id", "page"])).drop("markdown")


@query("page_html", HTML_SQL)
def page_html(spark, sf):
    """Every document as a page of clean HTML."""
    return html_pages(spark, sf)


@query("export_pages", HTML_SQL)
def export_pages(spark, sf):
    pages = html_pages(spark, sf)
    path = scratch_path(spark, "pages")
    S.export_pages(pages, path, by=["doc_id", "page", "segment"])
    return spark.read.schema(pages.schema).parquet(path)


@query("sanitize_html", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '<script>var t="</p>";track\((\d+)\);</script>', 'var t="&lt;/p&gt;";track(\1);') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '<!(?:--.*?--|DOCTYPE html)>', '', 'g'), '</?(?:html|head|meta|title|style|body|nav|a|div|article|footer|b)(?: [^>]*)?>', '', 'g') AS h FROM a),
c AS (SELECT page_id, replace(replace(replace(h, '&quot;', '"'), '&copy;', '©'), '&middot;', '·') AS h FROM b)
SELECT page_id, h || repeat('</p>', ((length(h) - length(replace(h, '<p>', ''))) / 3 - (length(h) - length(replace(h, '</p>', ''))) / 4)::INTEGER) AS html FROM c""")
def sanitize_html(spark, sf):
    return L.sanitize_html(table(spark, sf, "pages").select("page_id", "html"), col="html")
