"""Heading-aware chunking with overlap, long-paragraph windows and section paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import slices

TABLE_LEAST = 8
SEPARATOR = " > "
CHUNK = "chunk_index int, content string, page int, section_path string"


class _Chunks:
    """The state while one document's blocks go by."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.out: list[tuple[int, str, int | None, str]] = []
        self.held: list[str] = []
        self.chars = 0
        self.open: list[tuple[int, str]] = []
        self.page: int | None = None

    def put(self, content: str) -> None:
        self.out.append((len(self.out), content, self.page, SEPARATOR.join(t for _, t in self.open)))

    def flush(self) -> None:
        """Emit what is held; its tail starts the next chunk."""
        if self.held:
            whole = "\n".join(self.held)
            self.put(whole)
            self.held = [whole[-self.overlap :]] if 0 < self.overlap < len(whole) else []
            self.chars = sum(map(len, self.held))

    def hold(self, text: str) -> None:
        self.held.append(text)
        self.chars += len(text) + 1

    def make_room(self, text: str) -> None:
        if self.held and self.chars + len(text) + 1 > self.size:
            self.flush()

    def heading(self, text: str, level: int, page: int | None) -> None:
        self.flush()
        self.open = [*[x for x in self._above(level)], (level, text)]
        self.page, self.held, self.chars = page, [], 0
        self.hold(text)

    def _above(self, level: int) -> list[tuple[int, str]]:
        keep = len(self.open)
        while keep and self.open[keep - 1][0] >= level:
            keep -= 1
        return self.open[:keep]

    def table(self, text: str, page: int | None) -> None:
        self.make_room(text)
        self.hold(text)
        self.page = page or self.page

    def paragraph(self, text: str, page: int | None) -> None:
        if not text:
            return
        self.page = page or self.page
        self.make_room(text)
        if len(text) > self.size:
            self.flush()
            step, n = self.size - self.overlap, windows_before_last(len(text), self.size, self.overlap)
            for k in range(n):
                self.put(text[k * step : k * step + self.size])
            text = text[n * step :]
        if text:
            self.hold(text)


def windows_before_last(length: int, size: int, overlap: int) -> int:
    """How many full windows come before the rest of a text of this length."""
    return max(0, -(-(length - size) // (size - overlap)))


def chunks_of(blocks: list, size: int = 800, overlap: int = 100) -> list[tuple[int, str, int | None, str]]:
    """(chunk_index, content, page, section_path) of a document's blocks (text, level, kind, page)."""
    if overlap >= size:
        raise ValueError("overlap must be below chunk_size")
    state = _Chunks(size, overlap)
    for b in blocks:
        page = None if b["page"] is None or pd.isna(b["page"]) else int(b["page"])
        if b["kind"] == "heading":
            state.heading(b["text"], b["level"], page)
        elif b["kind"] == "table" and len(b["text"]) >= TABLE_LEAST:
            state.table(b["text"], page)
        else:
            state.paragraph(b["text"].strip(), page)
    state.flush()
    return state.out


def chunk_documents(df: DataFrame, id_col: str = "doc_id", blocks_col: str = "blocks", chunk_size: int = 800, overlap: int = 100) -> DataFrame:
    """doc_id, chunk_index, content, page, section_path. A document is one row, so nothing is shuffled."""
    if overlap >= chunk_size:
        raise ValueError("overlap must be below chunk_size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                rows = [(i, *c) for i, blocks in enumerate(part.column("blocks").to_pylist()) for c in chunks_of(blocks or [], chunk_size, overlap)]
                at, *columns = zip(*rows, strict=True) if rows else ((),) * 5
                made = [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int64())), *made], names=["doc_id", "chunk_index", "content", "page", "section_path"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(blocks_col).alias("blocks")).mapInArrow(run, f"doc_id {id_type}, {CHUNK}")


def window_split(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Overlapping windows of a text; the rest is the last."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i < n, F.substring(text, i * step + 1, F.lit(size))).otherwise(F.substring(text, i * step + 1, F.length(text))))


def section_paths(blocks: DataFrame, id_col: str = "doc_id", pos_col: str = "pos") -> DataFrame:
    """blocks with section_path: for each level the last heading so far, unless a shallower or equal one came later."""
    so_far = Window.partitionBy(id_col).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("kind") == "heading"
    marked = blocks
    for level in range(1, 7):
        at = F.when(heading & (F.col("level") == level), F.struct(F.col(pos_col).alias("at"), F.col("text").alias("title")))
        marked = marked.withColumn(f"__h{level}", F.last(at, ignorenulls=True).over(so_far))
    parts = []
    for level in range(1, 7):
        above = [F.coalesce(F.col(f"__h{k}.at"), F.lit(-1)) for k in range(1, level)]
        newest = F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1)
        parts.append(F.when(F.col(f"__h{level}.at") > newest, F.col(f"__h{level}.title")))
    return marked.withColumn("section_path", F.concat_ws(SEPARATOR, *parts)).drop(*[f"__h{k}" for k in range(1, 7)])
