"""Pages as a parsed tree: text of all text nodes (styles and scripts included, comments not) and the style sheets."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import slices


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.sheets: list[str] = []
        self.inline: list[str] = []
        self.in_style = False

    def handle_starttag(self, tag, attrs):
        self.in_style = tag == "style"
        self.inline += [v for k, v in attrs if k == "style" and v]

    def handle_endtag(self, tag):
        if tag == "style":
            self.in_style = False

    def handle_data(self, data):
        self.texts.append(data)
        if self.in_style:
            self.sheets.append(data)


def read_page(html: str) -> tuple[str, str]:
    """(DOM text, CSS)."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return " ".join(reader.texts), "\n".join(reader.sheets + reader.inline)


def read_pages(pages: DataFrame) -> DataFrame:
    """doc_id, dom_text, css of (doc_id, html); null html gives nulls."""

    def run(batches):
        for some in (s for batch in batches for s in slices(batch, "html")):
            rows = [(None, None) if h is None else read_page(h) for h in some.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "dom_text", "css"]
            )

    return pages.select("doc_id", "html").mapInArrow(run, "doc_id long, dom_text string, css string")
