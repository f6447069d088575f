"""HTML cleaning as a small per-text helper behind an Arrow-batched column function."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ALLOWED_ATTRS, ALLOWED_TAGS


class _Cleaner(HTMLParser):
    def __init__(self, tags: set[str], attrs: dict[str, set[str]]):
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs = tags, attrs
        self.out: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in self.tags:
            return
        kept = "".join(f' {k}="{escape(v or "")}"' for k, v in attrs if k in self.attrs.get(tag, ()))
        self.out.append(f"<{tag}{kept}>")
        if tag != "br":
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag != "br":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while (last := self.open.pop()) != tag:
                self.out.append(f"</{last}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        self.out.append(escape(data, quote=False))

    def result(self) -> str:
        self.close()
        self.out.extend(f"</{tag}>" for tag in reversed(self.open))
        return "".join(self.out)


def _cleaning(tags: list[str], attrs: dict[str, list[str]]):
    tag_set, attr_sets = set(tags), {k: set(v) for k, v in attrs.items()}

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        cleaner = _Cleaner(tag_set, attr_sets)
        cleaner.feed(page)
        return cleaner.result()

    return one


def cleaned_html(tags: list[str] = ALLOWED_TAGS, attrs: dict[str, list[str]] = ALLOWED_ATTRS):
    """Column function that drops tags and attributes off the lists and keeps all text."""
    one = _cleaning(tags, attrs)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(one)

    return run


def cleaned_rows(df: DataFrame, col: str, tags: list[str] = ALLOWED_TAGS, attrs: dict[str, list[str]] = ALLOWED_ATTRS) -> DataFrame:
    """``df`` with a cleaned column, for columns made by expressions that cannot be the argument of a column function."""
    one = _cleaning(tags, attrs)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(col)
            yield batch.set_column(at, col, pa.array([one(x) for x in batch.column(at).to_pylist()], pa.string()))

    return df.mapInArrow(run, df.schema)
