"""What the Markdown scanner sees in each file, as rows."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tamarack.sources.markdown import scan

BLOCK = "path string, kind string, line int, column int, level int, text string, target string, section array<string>"


KINDS = ("entry", "heading", "item", "link", "cell", "comment")


def blocks(path: str, text: str, kinds: Collection[str] = KINDS) -> Iterator[dict]:
    """Headings, list items, links, table cells, comments and front-matter entries, each with its place and the headings it lies under.

    ``level`` is a heading's, a list item's depth or a cell's column;
    ``target`` a heading's anchor, an item's checkbox, a link's target, a
    cell's header.  Only ``kinds`` are searched for.
    """
    s = scan(text)

    def row(kind, at, level, text, target):
        line, column = s.place(at)
        return {"path": path, "kind": kind, "line": line, "column": column, "level": level, "text": text, "target": target, "section": s.section(at)}

    if "entry" in kinds:
        for key, values in s.front.entries.items():
            line, column = s.place(s.front.places[key][0])
            yield {"path": path, "kind": "entry", "line": line, "column": column, "level": 0, "text": ", ".join(values), "target": key, "section": []}
    for h in s.headings if "heading" in kinds else ():
        yield row("heading", h.start, h.level, h.text, h.anchor)
    for i in s.items if "item" in kinds else ():
        yield row("item", i.start, i.depth, i.first_line, i.checkbox)
    for x in s.links if "link" in kinds else ():
        yield row("link", x.start, 0, x.raw, x.target)
    for t in s.tables if "cell" in kinds else ():
        for cells in t.rows:
            for k, c in enumerate(cells):
                yield row("cell", c.start, k, c.text, t.headers[k].text if k < len(t.headers) else None)
    for c in s.comments if "comment" in kinds else ():
        yield row("comment", c.start, 0, c.inner.strip(), None)


def scanned(sources: DataFrame, kinds: Collection[str] = KINDS) -> DataFrame:
    """One row a block of ``kinds`` of ``sources(path, text)``; null texts have none."""
    arrow = to_arrow_schema(StructType.fromDDL(BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_pylist([r for path, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in blocks(path, text or "", kinds)], schema=arrow)

    return sources.select("path", "text").mapInArrow(run, BLOCK)
