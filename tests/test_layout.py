import random
import re

import pytest

from tableworks.fixed_values import ALLOWED_TAGS
from tableworks.operators import layout as L


def walk(latex):
    """Small grid walk to compare with."""
    rows = [[c.strip() for c in re.split(r"(?<!\\)&", r) if c.strip()] for r in re.split(r"(?<!\\)\\\\", latex) if r.strip()]
    taken, out, shown = set(), [], 0
    for r, cells in enumerate(rows):
        col = 0
        for cell in cells:
            while (r, col) in taken:
                col += 1
            rs = cs = 1
            while m := re.match(r"\\multi(row|column)\{(\d+)\}\{[^}]*\}\{(.*)\}$", cell):
                rs, cs = (int(m[2]), cs) if m[1] == "row" else (rs, int(m[2]))
                cell = m[3]
            out.append((shown, col, rs, cs, cell))
            taken |= {(r + i, col + j) for i in range(1, rs) for j in range(cs)}
            col += cs
        shown += bool(cells)
    return out


def test_cells_of_random_tables(spark):
    rng, rows = random.Random(2), []
    for i in range(150):
        lines = []
        for r in range(rng.randint(1, 5)):
            cells = []
            for c in range(rng.randint(0, 4)):
                cell = f"x{r}{c}"
                if rng.random() < 0.3:
                    cell = rf"\multirow{{{rng.randint(1, 4)}}}{{*}}{{{cell}}}"
                if rng.random() < 0.3:
                    cell = rf"\multicolumn{{{rng.randint(1, 3)}}}{{c}}{{{cell}}}"
                cells.append(cell if rng.random() < 0.9 else " ")
            lines.append(" & ".join(cells) or "&")
        rows.append((i, r" \\ ".join(lines)))
    out = {}
    for r in L.latex_table_cells(spark.createDataFrame(rows, "k INT, t STRING"), col="t", key="k").collect():
        out.setdefault(r.k, []).append((r.row, r.col, r.rowspan, r.colspan, r.content))
    for k, latex in rows:
        assert sorted(out.get(k, [])) == sorted(walk(latex)), latex


def test_text_without_rows_is_shown_raw(spark):
    df = spark.createDataFrame([(r"\begin{tabular}{l}\end{tabular}",), ("",), (None,), ("a & b",)], "t STRING")
    html = [r.html for r in L.latex_table_html(df, col="t").collect()]
    assert html[0] == r"<pre><code>\begin{tabular}{l}\end{tabular}</code></pre>" and html[1] == html[2] == ""
    assert html[3] == '<table border="1" class="dataframe">\n  <tr>\n    <th>a</th>\n    <th>b</th>\n  </tr>\n</table>'


def test_escapes_in_both_modes(spark):
    df = spark.createDataFrame([(r" \$5 \% \& \#\_ ",)], "t STRING")
    assert L.clean_latex_text(df, col="t").first().t == r"\$5 \% & #_"
    assert L.clean_latex_text(df, col="t", compat=False).first().t == "$5 % & #_"


BLOCKS = [
    ("Title", " T "), ("Text", "p"), ("List-item", "• one"), ("List-item", ""), ("Text", "inside"), ("Caption", r"fig \#1"), ("List-item", "two"),
    ("Formula", "x^2"), ("Section-header", "## S"), ("Footnote", "n"), ("Table", "a & b"), (None, "end"), ("List-item", "last"),
]
PAGE = (
    "# T\n\np\n\n- - one\ninside\n\n\n> Caption: fig #1\n\n- two\n\n<pre><code>$$ x^2 $$</code></pre>\n\n## S\n\n"
    "<p><small>[Footnote] n</small></p>\n\n" + '<table border="1" class="dataframe">\n  <tr>\n    <th>a</th>\n    <th>b</th>\n  </tr>\n</table>'
    "\n\nend\n\n- last"
)


@pytest.mark.parametrize("width", [4096, 3])
def test_page_text_by_hand(spark, width):
    rows = [(1, i, t, x) for i, (t, x) in enumerate(BLOCKS)]
    df = spark.createDataFrame(rows, "page INT, id INT, type STRING, text STRING")
    out = L.page_markdown(df, page=["page"], width=width).orderBy("segment").collect()
    assert "\n".join(r.markdown for r in out) == PAGE and len(out) == (1 if width > 100 else 5)


def test_block_json_shapes(spark):
    raw = ['[{"type": "Text", "text": "a"}]', '[[{"type": "Text", "text": "b"}], [{"type": "Text", "text": "c"}]]', "[]", "[[]]", '{"type": "Text"}', "[{", "", None, '[{"text": "x"}]]']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i INT, arguments STRING")
    got = {r.i: [b.text for b in r.blocks] for r in L.parse_blocks_json(df).collect()}
    assert got == {0: ["a"], 1: ["b"], 2: [], 3: [], 4: [], 5: [], 6: [], 7: [], 8: []}


def test_missing_boxes_are_zero_and_not_valid(spark):
    df = spark.createDataFrame([(1, [("Text", "a", (0.1, 0.2, 0.9999, 0.5)), ("Text", "b", None), ("Text", "c", (0.5, None, 0.4, 0.9))])],
                               "page INT, blocks ARRAY<STRUCT<type:STRING,text:STRING,bbox:STRUCT<xmin:DOUBLE,ymin:DOUBLE,xmax:DOUBLE,ymax:DOUBLE>>>")
    rows = L.blocks_to_records(df, width=100, height=200).orderBy("id").collect()
    assert [r.bbox_px for r in rows] == [[10, 40, 99, 100], [0, 0, 0, 0], [50, 0, 40, 180]]
    assert [r.id for r in L.valid_bbox(L.blocks_to_records(df, width=100, height=200)).collect()] == [0]


def test_sanitized_html_is_clean_and_stable(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    once = L.sanitize_html(pages, col="html")
    twice = {r.page_id: r.html for r in L.sanitize_html(once, col="html").collect()}
    rows = once.collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert twice[r.page_id] == r.html
        assert set(re.findall(r"</?([a-z0-9]+)", r.html)) <= set(ALLOWED_TAGS)
    df = spark.createDataFrame([('<td colspan="2" onclick="x">a<b>b</b> &lt;i&gt; <script>s</script><br/><p>open',)], "h STRING")
    assert L.sanitize_html(df, col="h").first().h == '<td colspan="2">ab &lt;i&gt; s<br><p>open</p></td>'


PAGES = [
    ("# T\n## U ##\ntext\nnext line\n\nother", "<h1>T</h1>\n<h2>U</h2>\n<p>text\nnext line</p>\n<p>other</p>"),
    ("- one\n- two\nlazy\n\nafter", "<ul>\n<li>one</li>\n<li>two\nlazy</li>\n</ul>\n<p>after</p>"),
    ("1. a\n2) b\n- c", "<ol>\n<li>a</li>\n<li>b</li>\n</ol>\n<ul>\n<li>c</li>\n</ul>"),
    ("> q *r*\n> s\n\n> t", "<blockquote>\n<p>q <em>r</em></p>\n<p>s</p>\n</blockquote>\n<blockquote>\n<p>t</p>\n</blockquote>"),
    ("```py\nx < 1 & *y*\n\n# z\n```\nend", "<pre><code>x &lt; 1 &amp; *y*\n\n# z\n</code></pre>\n<p>end</p>"),
    ("a|b\n-|:-:\n1|**2**\n", "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td><strong>2</strong></td></tr></tbody></table>"),
    ("<table border=1 onclick=x>\n<tr><td>1</td></tr>\n</table>\n\n<p><small>n</small></p>", '<table border="1">\n<tr><td>1</td></tr>\n</table>\n<p>n</p>'),
    ("**b** *i* _u_ `c<d*e*` [l](http://x) ![alt](y) a*b 2 * 3 * 4 snake_case_x ***", "<p><strong>b</strong> <em>i</em> <em>u</em> <code>c&lt;d*e*</code> l alt a*b 2 * 3 * 4 snake_case_x ***</p>"),
    ("<script>no()</script> a < b & c", "<p>no() a &lt; b &amp; c</p>"), ("", ""), ("\n \n", ""), (None, None), ("#no heading\n+1 not an item", "<p>#no heading\n+1 not an item</p>"),
    ("\x01\x02x\r\ny", "<p>x\ny</p>"),
]


def test_pages_of_hand_made_markdown(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(PAGES)], "id INT, markdown STRING")
    got = {r.id: r.html for r in L.page_html(df).collect()}
    assert [got[i] for i in range(len(PAGES))] == [html for _, html in PAGES]


def test_a_long_page_takes_time_in_proportion(spark):
    import time

    spent = []
    for n in (2_000, 16_000):
        df = spark.createDataFrame([("\n".join(f"- item *{i}*\n\ntext {i}" for i in range(n)),)], "markdown STRING")
        start = time.time()
        assert L.page_html(df).first().html.count("<li>") == n
        spent.append(time.time() - start)
    assert spent[1] < 40 * spent[0]
