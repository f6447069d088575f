"""Markdown to HTML by expressions: whole constructs become one line each, then lines are wrapped by what stands before and after.

Line ends inside a construct are kept as a control character until the end, so that every block is one line and a list or
quote is a run of neighbouring lines. No step looks back further than one line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, each_match

INNER = "\x01"
FENCE = r"(?m)^```[^\n]*\n(?:[^\n]*\n)*?```[ \t]*$"
RAW = r"(?m)^<(?:table|pre|p|div|ul|ol|blockquote|h[1-6])\b(?:[^\n]*\S[^\n]*(?:\n|$))+"
PIPES = r"(?m)^[^\n|]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$(?:\n[^\n|]*\|[^\n]*$)*"
HEAD, ITEM, NUMBER, QUOTE = r"^#{1,6}[ \t]+", r"^[-*+][ \t]+", r"^[0-9]{1,9}[.)][ \t]+", r"^>[ \t]?"
PLAIN = r"(?!\x02|[ \t]*\n|#{1,6}[ \t]|[-*+][ \t]|[0-9]{1,9}[.)][ \t]|>)"


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _block(html: Column) -> Column:
    """One line of finished HTML, set off by blank lines; the mark in front tells it from text."""
    return F.concat(F.lit("\n\x02"), F.replace(F.regexp_replace(html, r"\n+$", ""), F.lit("\n"), F.lit(INNER)), F.lit("\n\n"))


def _code(fence: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(fence, r"^```[^\n]*\n", ""), r"```[ \t]*$", "")
    return _block(F.concat(F.lit("<pre><code>"), escaped(body), F.lit("</code></pre>")))


def _pipe_table(source: Column) -> Column:
    def row(line: Column, tag: str) -> Column:
        cells = F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|")
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), inline(F.trim(c)), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    lines = F.split(source, "\n")
    body = F.transform(F.slice(lines, 3, F.size(lines)), lambda x: row(x, "td"))
    return _block(F.concat(F.lit("<table><thead>"), row(F.get(lines, F.lit(0)), "th"), F.lit("</thead><tbody>"), F.array_join(body, ""), F.lit("</tbody></table>")))


def inline(text: Column) -> Column:
    """Code, strong and emphasis; of links and images the words stay. What a backslash protects is left alone. An asterisk that
    touches a blank on its inner side, or an underscore inside a word, marks nothing."""
    text = each_match(text, r"`[^`\x01]+`", lambda c: F.concat(F.lit("<code>"), F.replace(escaped(F.regexp_replace(c, "`", "")), F.lit("*"), F.lit("&#42;")), F.lit("</code>")))
    text = F.regexp_replace(text, r"!?\[([^\]\x01]*)\]\([^)\s]*\)", "$1")
    text = F.regexp_replace(text, r"(?<![\\*])\*\*(?![\s*])([^*\x01]*[^\s*\x01\\])\*\*(?!\*)", "<strong>$1</strong>")
    text = F.regexp_replace(text, r"(?<![\\*])\*(?![\s*])([^*\x01]*[^\s*\x01\\])\*(?!\*)", "<em>$1</em>")
    return F.regexp_replace(text, r"(?<![\w\\])_(?![\s_])([^_\x01]*[^\s_\x01\\])_(?!\w)", "<em>$1</em>")


def to_html(text: Column) -> Column:
    """HTML of a Markdown text: headings, paragraphs, lists of one level, quotes, fenced code, tables with a header line, HTML blocks.

    A line of plain text goes on with the paragraph, item or quote line before it. A blank line ends every block; lists are tight.
    The result may hold whatever HTML the text holds, so it has to be cleaned.
    """
    work = F.regexp_replace(F.regexp_replace(text, r"[\x01\x02]", ""), r"\r\n?", "\n")
    work = each_match(work, FENCE, _code)
    work = each_match(work, RAW, _block)
    work = each_match(work, PIPES, _pipe_table)
    work = F.regexp_replace(work, r"(?m)^(#{1,6}[ \t][^\n]*)$", "$1\n")
    work = F.regexp_replace(F.concat(work, F.lit("\n")), r"(?<=[^\n])\n" + PLAIN + r"(?=[^\n])", INNER)
    lines = F.transform(F.split(work, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""))

    def kind(line: Column) -> Column:
        return (
            F.when(line == "", "").when(line.startswith("\x02"), "html").when(F.regexp_like(line, F.lit(HEAD)), "h").when(F.regexp_like(line, F.lit(ITEM)), "ul")
            .when(F.regexp_like(line, F.lit(NUMBER)), "ol").when(F.regexp_like(line, F.lit(QUOTE)), "blockquote").otherwise("p")
        )

    def one(line: Column, i: Column, kinds: Column) -> Column:
        own, before, after = F.get(kinds, i), F.get(kinds, i - 1), F.get(kinds, i + 1)
        grouped = own.isin("ul", "ol", "blockquote")
        opening = F.when(grouped & ~before.eqNullSafe(own), F.concat(F.lit("<"), own, F.lit(">\n"))).otherwise("")
        closing = F.when(grouped & ~after.eqNullSafe(own), F.concat(F.lit("\n</"), own, F.lit(">"))).otherwise("")
        level = F.length(F.regexp_extract(line, "^(#+)", 1)).cast("string")
        bare = F.regexp_replace(line, r"^#{1,6}[ \t]+|[ \t]+#+$|^[-*+][ \t]+|^[0-9]{1,9}[.)][ \t]+|^>[ \t]?", "")
        quoted = inline(F.regexp_replace(line, r"(^|\x01)>[ \t]?", "$1"))
        body = (
            F.when(own == "html", F.substr(line, F.lit(2)))
            .when(own == "h", F.concat(F.lit("<h"), level, F.lit(">"), inline(bare), F.lit("</h"), level, F.lit(">")))
            .when(own.isin("ul", "ol"), F.concat(F.lit("<li>"), inline(bare), F.lit("</li>")))
            .when(own == "blockquote", F.concat(F.lit("<p>"), quoted, F.lit("</p>")))
            .otherwise(F.concat(F.lit("<p>"), inline(line), F.lit("</p>")))
        )
        return F.when(own == "", F.lit(None).cast("string")).otherwise(F.concat(opening, body, closing))

    def wrapped(rows: Column) -> Column:
        return bound(F.transform(rows, kind), lambda kinds: F.transform(rows, lambda line, i: one(line, i, kinds)))

    return F.replace(F.array_join(bound(lines, wrapped), "\n"), F.lit(INNER), F.lit("\n"))
