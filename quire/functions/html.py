"""HTML to Markdown blocks and page counts, one Arrow batch at a time."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import ship_by_value
from quire.settings import DEFAULTS, Settings

ship_by_value(__name__)

# Fixed tag sets.
SKIPPED = frozenset({"nav", "aside", "footer", "script", "style", "header", "form", "noscript"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})

PAGE = T.StructType(
    [
        T.StructField("markdown", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text_chars", T.IntegerType()),
        T.StructField("tag_count", T.IntegerType()),
        T.StructField("image_count", T.IntegerType()),
    ]
)


class _Page(HTMLParser):
    """Collects blocks in document order; text right under the body (or the root) is not part of a block."""

    def __init__(self, has_body: bool):
        super().__init__(convert_charrefs=True)
        self.has_body = has_body
        self.open: list[str] = []
        self.text = ""
        self.blocks: list[str] = []
        self.strings: list[str] = []
        self.title: str | None = None
        self.tags = self.images = 0
        self.rows: list[list[list[str]]] = []

    def _within(self, names) -> bool:
        return any(t in names for t in self.open)

    def _flush(self, raw: str | None = None, comment: bool = False) -> None:
        text, self.text = (self.text, "") if raw is None else (raw, self.text)
        clean = text.strip()
        if self._within(SKIPPED):
            return
        if clean and not comment:
            self.strings.append(clean)
            if self.open and self.open[-1] == "title" and self.title is None:
                self.title = clean
        holder = self._holder()
        if holder == "pre" and not comment:
            self.pre.append(text)
        elif holder == "heading" and clean and not comment:
            self.head.append(clean)
        elif holder == "table":
            if clean and not comment and self._within({"td", "th"}) and self.rows and self.rows[-1]:
                self.rows[-1][-1].append(clean)
        elif holder == "block" and clean:
            self.blocks.append(clean)

    def _holder(self) -> str | None:
        path = self.open
        if self.has_body:
            if "body" not in path:
                return None
            path = path[path.index("body") + 1 :]
        for tag in path:
            if tag in ("table", "pre"):
                return tag
            if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                return "heading"
        return "block" if path else None

    def handle_data(self, data):
        self.text += data

    def handle_comment(self, data):
        self._flush()
        self._flush(data, comment=True)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if not self._within(SKIPPED) and tag not in SKIPPED:
            self.tags += 1
            self.images += tag == "img"
            before = self._holder()
            if before in (None, "block"):
                if tag == "table":
                    self.rows = []
                elif tag == "pre":
                    self.pre = []
                elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                    self.head = []
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                self.rows[-1].append([])
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        self._flush()
        if tag not in self.open:
            return
        at = len(self.open) - 1 - self.open[::-1].index(tag)
        before = self._holder()
        first = next((t for t in self.open if t in ("table", "pre") or (len(t) == 2 and t[0] == "h" and t[1] in "123456")), None)
        skipped = self._within(SKIPPED)
        del self.open[at:]
        if skipped or before in (None, "block") or self._holder() not in (None, "block"):
            return
        if before == "heading" and self.head:
            self.blocks.append("#" * int(first[1]) + " " + " ".join(self.head))
        elif before == "pre":
            self.blocks.append("```\n" + "\n".join(self.pre).strip("\n") + "\n```")
        elif before == "table":
            rows = [[" ".join(c).replace("\n", " ") for c in r] for r in self.rows if r]
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                self.blocks.append("\n".join([lines[0], "| " + " | ".join(["---"] * len(rows[0])) + " |", *lines[1:]]))


def _read(html: str | None) -> tuple:
    if html is None:
        return "", "", 0, 0, 0
    page = _Page("<body" in html.lower())
    page.feed(html)
    page.close()
    page._flush()
    return "\n\n".join(page.blocks), page.title or "", len(" ".join(page.strings)), page.tags, page.images


@F.pandas_udf(PAGE)
def read_page(html: pd.Series) -> pd.DataFrame:
    """Markdown, title and counts of a page, whole."""
    return pd.DataFrame([_read(h) for h in html], columns=PAGE.names)


def html_decision(page: Column, cfg: Settings = DEFAULTS) -> Column:
    """Route of a page: html_text, vlm or skip."""
    return (
        F.when(page["text_chars"] >= cfg.html_min_text, "html_text")
        .when(page["image_count"] > 0, "vlm")
        .otherwise("skip")
    )


def low_text_ratio(page: Column, cfg: Settings = DEFAULTS) -> Column:
    ratio = F.try_divide(page["text_chars"], page["tag_count"])
    return F.coalesce(ratio < cfg.html_low_text_tag_ratio, F.lit(False))
