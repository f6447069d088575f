"""Column functions for parsed page layout: block JSON, Markdown and LaTeX text, LaTeX tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json import is_json
from .text import strip

BLOCK = "struct<type:string,text:string,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>"


def blocks_from_json(col: Column) -> Column:
    """Array of blocks from a JSON list, or from the first inner list of a list of lists. Anything
    else gives an empty array."""
    is_list = is_json(col) & F.coalesce(F.schema_of_variant(F.try_parse_json(col)).like("ARRAY%"), F.lit(False))
    nested = F.get(F.from_json(col, f"array<array<{BLOCK}>>"), F.lit(0))
    flat = F.from_json(col, f"array<{BLOCK}>")
    return F.coalesce(F.when(is_list, F.coalesce(nested, flat)), F.array().cast(f"array<{BLOCK}>"))


def cleaned_latex(col: Column, compat: bool = True) -> Column:
    """LaTeX cell text to HTML text. ``compat`` leaves escaped dollar and percent signs alone."""
    # Patterns and what replaces them, in order.
    rules = [
        (r"\\textbf\{(.*?)\}", "<b>$1</b>"),
        (r"\\textit\{(.*?)\}", "<i>$1</i>"),
        (r"\\&", "&"),
        (r"\\_", "_"),
        (r"\\#", "#"),
        (r"\\textless", "<"),
        (r"\\textgreater", ">"),
        (r"\\newline", " "),
    ]
    if not compat:
        rules += [(r"\\\$", r"\$"), (r"\\%", "%")]
    out = strip(col)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def cleaned_md(col: Column) -> Column:
    """Markdown escapes removed, bullets as dashes, trimmed."""
    return strip(F.replace(F.regexp_replace(col, r"\\([#>*_`~\-+!\[\]()])", "$1"), F.lit("•"), F.lit("-")))


_SPAN = r"(?s)^\\multi(column|row)\{(\d+)\}\{[^}]*\}\{(.*)\}\s*$"
_COVERED = "array<struct<row:bigint,start:bigint,end:bigint>>"
_CELLS = "array<struct<row:bigint,col:bigint,rowspan:bigint,colspan:bigint,content:string>>"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unwrapped(cell: Column) -> Column:
    """A cell without its span commands, as many levels as it has, and the spans they state."""
    levels = F.size(F.split(cell, r"\\multi(?:column|row)\{")) - 1

    def peel(acc: Column, _: Column) -> Column:
        hit = acc["content"].rlike(_SPAN)
        kind, count = F.regexp_extract(acc["content"], _SPAN, 1), F.regexp_extract(acc["content"], _SPAN, 2).try_cast("long")
        return F.struct(
            F.when(hit, strip(F.regexp_extract(acc["content"], _SPAN, 3))).otherwise(acc["content"]).alias("content"),
            F.when(hit & (kind == "row"), count).otherwise(acc["rowspan"]).alias("rowspan"),
            F.when(hit & (kind == "column"), count).otherwise(acc["colspan"]).alias("colspan"),
        )

    start = F.struct(cell.alias("content"), _long(1).alias("rowspan"), _long(1).alias("colspan"))
    return F.aggregate(F.slice(F.sequence(F.lit(0), levels), 2, levels), start, peel)


def _placed(grid: Column) -> Column:
    """Cells of a table with spans and their columns: a cell takes the first column that no row
    span from above covers."""
    height = F.size(grid).cast("long")
    rows = F.transform(grid, lambda cells, i: F.struct(F.transform(cells, _unwrapped).alias("cells"), i.cast("long").alias("no")))

    def place_row(acc: Column, row: Column) -> Column:
        def place(state: Column, cell: Column) -> Column:
            above = F.array_sort(F.filter(state["covered"], lambda c: c["row"] == row["no"]))
            free = F.aggregate(above, state["col"], lambda at, c: F.when((c["start"] <= at) & (at < c["end"]), c["end"]).otherwise(at))
            last = F.least(row["no"] + cell["rowspan"], height) - 1
            below = F.when(last > row["no"], F.sequence(row["no"] + 1, last)).otherwise(F.array().cast("array<bigint>"))

            def put(col: Column) -> Column:
                placed = F.struct(
                    acc["shown"].alias("row"), col.alias("col"), F.greatest(_long(1), cell["rowspan"]).alias("rowspan"),
                    F.greatest(_long(1), cell["colspan"]).alias("colspan"), cell["content"].alias("content"),
                )
                shadow = F.transform(below, lambda r: F.struct(r.alias("row"), col.alias("start"), (col + cell["colspan"]).alias("end")))
                return F.struct(
                    (col + cell["colspan"]).alias("col"), F.concat(state["covered"], shadow).alias("covered"),
                    F.concat(state["out"], F.array(placed)).alias("out"),
                )

            return _let(free, put)

        begin = F.struct(_long(0).alias("col"), acc["covered"].alias("covered"), acc["out"].alias("out"))
        done = F.aggregate(row["cells"], begin, place, lambda s: F.struct(s["covered"].alias("covered"), s["out"].alias("out")))
        shown = acc["shown"] + F.when(F.size(row["cells"]) > 0, _long(1)).otherwise(_long(0))
        return F.struct(done["covered"].alias("covered"), done["out"].alias("out"), shown.alias("shown"))

    start = F.struct(F.array().cast(_COVERED).alias("covered"), F.array().cast(_CELLS).alias("out"), _long(0).alias("shown"))
    return F.aggregate(rows, start, place_row, lambda s: s["out"])


def _plain(grid: Column) -> Column:
    """Cells of a table without spans."""

    def cell(row: Column, col: Column, content: Column) -> Column:
        return F.struct(
            row.cast("long").alias("row"), col.cast("long").alias("col"), _long(1).alias("rowspan"), _long(1).alias("colspan"),
            content.alias("content"),
        )

    rows = F.filter(grid, lambda r: F.size(r) > 0)
    return F.flatten(F.transform(rows, lambda r, i: F.transform(r, lambda c, j: cell(i, j, c))))


def latex_cells(col: Column, compat: bool = True) -> Column:
    """Cells of a LaTeX table: row, col, rowspan, colspan, content. Empty cells are no cells."""
    tabular = r"(?s)\\begin\{tabular\}\{[^}]*\}(.*?)\\end\{tabular\}"
    body = F.regexp_replace(F.when(col.rlike(tabular), F.regexp_extract(col, tabular, 1)).otherwise(col), r"\\hline", "")

    def parts(text: Column, pattern: str) -> Column:
        return F.filter(F.transform(F.split(text, pattern), lambda p: strip(p)), lambda p: p != "")

    grid = F.transform(parts(body, r"(?<!\\)\\\\"), lambda r: parts(r, r"(?<!\\)&"))
    spans = F.contains(col, F.lit("\\multi"))

    cells = _let(grid, lambda g: F.when(spans, _placed(g)).otherwise(_plain(g)))
    return F.transform(cells, lambda c: c.withField("content", cleaned_latex(c["content"], compat)))


def latex_html(latex: Column, cells: Column) -> Column:
    """HTML table from the cells of ``latex_cells``; the first row is the header. A text without
    rows is shown as it is, an empty one gives an empty text."""
    rows = F.sequence(F.lit(0).cast("long"), F.array_max(F.transform(cells, lambda c: c["row"])))

    def html_cell(c: Column) -> Column:
        tag = F.when(c["row"] == 0, "th").otherwise("td")
        span = F.concat(
            F.when(c["colspan"] > 1, F.concat(F.lit(' colspan="'), c["colspan"].cast("string"), F.lit('"'))).otherwise(""),
            F.when(c["rowspan"] > 1, F.concat(F.lit(' rowspan="'), c["rowspan"].cast("string"), F.lit('"'))).otherwise(""),
        )
        return F.concat(F.lit("    <"), tag, span, F.lit(">"), c["content"], F.lit("</"), tag, F.lit(">"))

    lines = F.transform(
        rows, lambda r: F.concat(F.lit("  <tr>\n"), F.array_join(F.transform(F.filter(cells, lambda c: c["row"] == r), html_cell), "\n"), F.lit("\n  </tr>"))
    )
    table = F.concat(F.lit('<table border="1" class="dataframe">\n'), F.array_join(lines, "\n"), F.lit("\n</table>"))
    raw = F.concat(F.lit("<pre><code>"), latex, F.lit("</code></pre>"))
    return F.when(F.coalesce(F.length(latex), F.lit(0)) == 0, "").when(F.size(cells) > 0, table).otherwise(raw)
