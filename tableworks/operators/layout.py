"""Parsed page layout: blocks, records, tables, Markdown and HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ALLOWED_ATTRS, ALLOWED_TAGS
from ..functions import layout as Y
from ..functions import markdown as M
from ..functions.html import cleaned_html, cleaned_rows
from ..functions.text import strip
from .guards import posexploded
from .ordering import BUCKET_WIDTH, join_segments, last_value_before

SPECIAL = ["Table", "Formula", "Title", "Section-header", "Caption", "Footnote"]


def parse_blocks_json(df: DataFrame, *, col: str = "arguments", out: str = "blocks") -> DataFrame:
    return df.withColumn(out, Y.blocks_from_json(F.col(col)))


def _exploded(df: DataFrame, blocks: str) -> DataFrame:
    return posexploded(df, [c for c in df.columns if c != blocks], F.col(blocks), "id", "_b")


def blocks_preview(df: DataFrame, *, blocks: str = "blocks", n: int = 200) -> DataFrame:
    """One row per block with its ordinal and a one-line text preview."""
    text = F.substring(F.replace(F.coalesce("_b.text", F.lit("")), F.lit("\n"), F.lit(" ")), 1, n)
    return _exploded(df, blocks).withColumns({"type": F.col("_b.type"), "text": text, "bbox": F.col("_b.bbox")}).drop("_b")


def blocks_to_records(df: DataFrame, *, width: int, height: int, blocks: str = "blocks") -> DataFrame:
    """One row per block with the box in relative and in whole pixel units; a missing box is zeros."""
    box = F.coalesce(F.col("_b.bbox"), F.expr("named_struct('xmin', 0D, 'ymin', 0D, 'xmax', 0D, 'ymax', 0D)"))

    def pixel(side: str, size: int) -> Column:
        return (F.coalesce(box[side], F.lit(0.0)) * size).cast("int")

    px = F.array(pixel("xmin", width), pixel("ymin", height), pixel("xmax", width), pixel("ymax", height))
    return _exploded(df, blocks).withColumns(
        {"type": F.col("_b.type"), "text": F.col("_b.text"), "bbox_norm": box, "bbox_px": px}
    ).drop("_b")


def valid_bbox(df: DataFrame, *, bbox: str = "bbox_norm") -> DataFrame:
    """Blocks whose box has an area; absent sides count as zero."""
    side = {s: F.coalesce(F.col(bbox)[s], F.lit(0.0)) for s in ("xmin", "ymin", "xmax", "ymax")}
    return df.where((side["xmax"] > side["xmin"]) & (side["ymax"] > side["ymin"]))


def latex_table_cells(df: DataFrame, *, col: str, key: str | list[str]) -> DataFrame:
    """One row per table cell: (key, row, col, rowspan, colspan, content)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, F.inline(Y.latex_cells(F.col(col))))


def latex_table_html(df: DataFrame, *, col: str, out: str = "html") -> DataFrame:
    cells = df.withColumn("_cells", Y.latex_cells(F.col(col)))
    return cells.withColumn(out, Y.latex_html(F.col(col), F.col("_cells"))).drop("_cells")


def clean_latex_text(df: DataFrame, *, col: str, compat: bool = True) -> DataFrame:
    return df.withColumn(col, Y.cleaned_latex(F.col(col), compat))


def clean_md(df: DataFrame, *, col: str) -> DataFrame:
    return df.withColumn(col, Y.cleaned_md(F.col(col)))


def _line(kind: Column, text: Column, table: Column) -> Column:
    t = Y.cleaned_md(text)
    return (
        F.when(kind == "Table", table)
        .when(kind == "Formula", F.concat(F.lit("<pre><code>$$ "), text, F.lit(" $$</code></pre>")))
        .when(kind == "Title", F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("# "), t)))
        .when(kind == "Section-header", F.when(t.startswith("##"), t).otherwise(F.concat(F.lit("## "), t)))
        .when(kind == "List-item", F.concat(F.lit("- "), t))
        .when(kind == "Caption", F.concat(F.lit("> Caption: "), t))
        .when(kind == "Footnote", F.concat(F.lit("<p><small>[Footnote] "), t, F.lit("</small></p>")))
        .otherwise(t)
    )


def page_markdown(blocks: DataFrame, *, page: list[str], order: str = "id", type: str = "type", text: str = "text", width: int = BUCKET_WIDTH) -> DataFrame:
    """Markdown per page: (page columns, segment, markdown).

    A page of up to a few thousand blocks has one segment; the segments of a longer one, joined
    by a line break, are its text. A list stays open until a block of a special type, which is
    then set off by a blank line.
    """
    rows = blocks.select(*page, F.col(order).cast("long").alias("_o"), F.col(type).alias("_k"), strip(F.coalesce(text, F.lit(""))).alias("_t"))
    rows = rows.where(F.col("_t") != "")
    kind = F.col("_k")
    rows = rows.withColumn("_event", F.when(kind == "List-item", 1).when(kind.isin(SPECIAL), 0))
    rows = last_value_before(rows, by=page, order="_o", value="_event", out="_open", width=width, segment="segment")
    # the LaTeX of other blocks is not looked at
    rows = rows.withColumn("_latex", F.when(kind == "Table", F.col("_t"))).withColumn("_cells", Y.latex_cells(F.col("_latex")))
    table = Y.latex_html(F.col("_latex"), F.col("_cells"))
    opened = F.when((F.col("_open") == 1) & kind.isin(SPECIAL), "\n").otherwise("")
    ended = F.when(kind == "List-item", "").otherwise("\n")
    parts = rows.select(*page, "segment", "segment_is_last", "_o", F.concat(opened, _line(kind, F.col("_t"), table), ended).alias("_p"))
    out = join_segments(
        parts, by=page, position="_o", parts={"markdown": "_p"}, sep="\n", keep=["segment_is_last"], numbered=True
    )
    trimmed = F.when(F.col("segment_is_last"), F.regexp_replace("markdown", r"\s+$", "")).otherwise(F.col("markdown"))
    return out.withColumn("markdown", trimmed).drop("segment_is_last")


def page_html(pages: DataFrame, *, col: str = "markdown", out: str = "html") -> DataFrame:
    """Adds the HTML of a Markdown column, with only the tags and attributes that survive cleaning. A null text stays null.

    Each segment of a long page is rendered by itself; segments joined by a line break are the page, where a list that crosses
    the border of two segments comes as two lists.
    """
    return cleaned_rows(pages.withColumn(out, M.to_html(F.col(col))), out)


def sanitize_html(df: DataFrame, *, col: str, tags: list[str] = ALLOWED_TAGS, attrs: dict[str, list[str]] = ALLOWED_ATTRS) -> DataFrame:
    """Tags and attributes off the lists are dropped, all text stays."""
    return df.withColumn(col, cleaned_html(tags, attrs)(F.col(col)))


def index_by_type(df: DataFrame, *, types: list[str], col: str = "type") -> DataFrame:
    """Blocks of the types that are to be indexed; others, and blocks without a type, are left out."""
    return df.where(F.col(col).isin(types))


def page_block_stats(df: DataFrame, *, by: list[str], col: str = "type", text: str = "text") -> DataFrame:
    """Blocks and characters per page and type; a missing type is its own row."""
    return df.groupBy(*by, col).agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"))
