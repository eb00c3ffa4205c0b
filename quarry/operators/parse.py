"""Parsing of texts into ordered blocks (text, level, kind, page), and routing by file type."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import LINE_BREAK, slices, strip

BLOCK = "struct<text:string,level:int,kind:string,page:int>"
BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("level", pa.int32()), ("kind", pa.string()), ("page", pa.int32())]))
#: Parser of each supported suffix.
PARSERS = {"md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html"}


def _block(text: Column, level: Column, kind: Column) -> Column:
    return F.struct(text.alias("text"), level.cast("int").alias("level"), kind.alias("kind"), F.lit(None).cast("int").alias("page"))


def markdown_blocks(text: Column) -> Column:
    """One block a line: headings by their signs, table rows by their bars, else text."""
    heading = r"(?U)^(#{1,6})\s+(.*)$"

    def block(line: Column) -> Column:
        marks = F.regexp_extract(line, heading, 1)
        table = line.startswith("|") & (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2)
        return F.when(marks != "", _block(strip(F.regexp_extract(line, heading, 2)), F.length(marks), F.lit("heading"))).otherwise(_block(line, F.lit(0), F.when(table, "table").otherwise("text")))

    return F.transform(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), strip), lambda x: x != ""), block)


def text_blocks(text: Column) -> Column:
    """One block a paragraph; paragraphs are parted by blank lines."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\n\s*\n"), strip)
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: _block(x, F.lit(0), F.lit("text")))


class _Blocks(HTMLParser):
    """Headings, table texts and paragraphs of a page, in order."""

    HIDDEN = frozenset(("script", "style", "head", "noscript"))
    BREAKS = frozenset(("p", "div", "li", "ul", "ol", "br", "article", "section", "nav", "body", "td", "tr", "footer", "header", "main", "blockquote", "pre"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.held: list[str] = []
        self.hidden, self.tables, self.level = 0, 0, 0

    def close_block(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            kind = "table" if self.tables else "heading" if self.level else "text"
            self.out.append({"text": text, "level": 0 if self.tables else self.level, "kind": kind, "page": None})
        self.held = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "table":
            if not self.tables:
                self.close_block()
            self.tables += 1
        elif self.tables:
            self.held.append(" ")
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.close_block()
            self.level = min(6, max(1, int(tag[1])))
        elif tag in self.BREAKS:
            self.close_block()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.tables:
            if self.tables == 1:
                self.close_block()
            self.tables -= 1
        elif self.tables:
            self.held.append(" ")
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.close_block()
            self.level = 0
        elif tag in self.BREAKS:
            self.close_block()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held.append(data)


def _page_blocks(html: str | None) -> list[dict]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.out


def html_blocks(html: Column) -> Column:
    """Blocks of HTML pages: headings with levels 1 to 6, each table as one block, white space squeezed."""

    @F.arrow_udf(f"array<{BLOCK}>")
    def run(pages: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], BLOCKS), *[pa.array(map(_page_blocks, part.to_pylist()), BLOCKS) for part in slices(pages)]])

    return run(html)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route(df: DataFrame, path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected): blocks by each file's parser; files of other types with a reason."""
    kind = F.create_map(*[F.lit(x) for pair in PARSERS.items() for x in pair])[suffix(F.col(path_col))]
    rows = df.withColumn("parser", kind)
    text = F.col(text_col)
    parsed = [rows.filter(F.col("parser") == name).withColumn("blocks", parser(text)) for name, parser in (("markdown", markdown_blocks), ("text", text_blocks), ("html", html_blocks))]
    rejected = rows.filter(F.col("parser").isNull()).select(path_col, F.concat(F.lit("unsupported type: "), suffix(F.col(path_col))).alias("reason"))
    return parsed[0].unionByName(parsed[1]).unionByName(parsed[2]), rejected


def exploded(df: DataFrame, blocks_col: str = "blocks") -> DataFrame:
    """A row per block, with pos from 0."""
    kept = [c for c in df.columns if c != blocks_col]
    return df.select(*kept, F.posexplode(blocks_col).alias("pos", "b")).select(*kept, "pos", "b.*")

