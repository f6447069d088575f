"""Visible text of web pages: blocks between block tags, parted into content and boilerplate."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BREAKING = set(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set("head iframe noscript object script style svg template textarea select".split())
FRAME = set("aside footer form header menu nav".split())
CONTENT = set("article main".split())
FRAME_NAMES = set("ad ads advert advertisement banner breadcrumb breadcrumbs comments cookie cookies footer menu nav promo related share sidebar social sponsored".split())
#: A block with a larger share of its characters in links is boilerplate.
LINK_SHARE = 0.5


class _Blocks(HTMLParser):
    """Collects (text, characters in links, inside a frame) per block. Tags left open are closed by what encloses them; a tag that
    closes nothing is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.blocks: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.title: str | None = None
        self.lang: str | None = None
        self.hidden = self.framed = self.links = self.titles = 0

    def _count(self, tag: str, frame: bool, by: int) -> None:
        self.hidden += by * (tag in HIDDEN)
        self.framed += by * frame
        self.links += by * (tag == "a")
        self.titles += by * (tag == "title")

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.linked, self.framed > 0))
        self.parts, self.linked = [], 0

    def _close(self, tag: str) -> None:
        while self.open:
            last, frame = self.open.pop()
            self._count(last, frame, -1)
            if last == tag:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BREAKING:
            self._flush()
        named = dict(attrs)
        if tag == "html" and named.get("lang"):
            self.lang = named["lang"].strip().lower().replace("_", "-").split("-")[0] or None
        if tag in VOID:
            return
        names = f"{named.get('class') or ''} {named.get('id') or ''}".lower().split()
        if tag in CONTENT:  # a frame that was never closed does not swallow the content
            for k, (last, frame) in enumerate(self.open):
                if frame and last in FRAME:
                    self._close_from(k)
                    break
        if tag in ("p", "li", "tr", "td", "th", "option", "dt", "dd") and self.open and self.open[-1][0] == tag:
            self._close(tag)
        frame = tag in FRAME or any(n in FRAME_NAMES for n in names)
        if tag == "body":
            while any(t == "head" for t, _ in self.open):
                self._close("head")
        self.open.append((tag, frame))
        self._count(tag, frame, 1)

    def _close_from(self, k: int) -> None:
        while len(self.open) > k:
            self._count(*self.open.pop(), -1)

    def handle_startendtag(self, tag, attrs):
        if tag in BREAKING:
            self._flush()

    def handle_endtag(self, tag):
        if tag in BREAKING:
            self._flush()
        if any(t == tag for t, _ in self.open):
            self._close(tag)

    def handle_data(self, data):
        if self.titles and self.title is None or self.titles and self.hidden:
            self.title = (self.title or "") + data
        elif not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def page_blocks(html: str) -> tuple[str | None, str | None, list[tuple[str, bool]]]:
    """Title, language and (text, is boilerplate) of every block."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser._flush()
    title = " ".join((parser.title or "").split()) or None
    return title, parser.lang, [(text, framed or linked > LINK_SHARE * len(text)) for text, linked, framed in parser.blocks]


def page_text(html: Column) -> Column:
    """A page's title, language, content as lines, and how many blocks there were, as a struct. A null page gives nulls."""

    @F.pandas_udf("title string, lang string, text string, n_blocks int, n_boilerplate int")
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            if page is None:
                rows.append((None, None, None, None, None))
                continue
            title, lang, blocks = page_blocks(page)
            kept = [text for text, boiler in blocks if not boiler]
            rows.append((title, lang, "\n".join(kept), len(blocks), len(blocks) - len(kept)))
        return pd.DataFrame(rows, columns=["title", "lang", "text", "n_blocks", "n_boilerplate"]).astype({"n_blocks": "Int32", "n_boilerplate": "Int32"})

    return run(html)
