"""The whole way of files into the chunk store: parse, chunk, clean, drop duplicates, mask."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.redaction import DEFAULT_RULES, Pattern, Words, audit, redacted
from quarry.operators.chunk import chunk_documents
from quarry.operators.clean import cleaned_by, dedup_documents, document_hashes, marked, reports
from quarry.operators.parse import route


@dataclass
class Ingested:
    """chunks to store (doc_id, chunk_index, content, page, section_path), reports and masking rules by document, files refused,
    and outcomes: doc_id, status (indexed, duplicate or failed), error, chunk_count and duplicate_of of each file taken.

    Contents are masked when chunks or audit are first asked for, once for both; the other results don't need them.
    """

    reports: DataFrame
    rejected: DataFrame
    outcomes: DataFrame
    mask: Callable[[], DataFrame]

    @cached_property
    def masked(self) -> DataFrame:
        return self.mask()

    @property
    def chunks(self) -> DataFrame:
        return self.masked.select("doc_id", "chunk_index", F.col("masked").alias("content"), "page", "section_path")

    @property
    def audit(self) -> DataFrame:
        return audit(self.masked)


def checkpointed(df: DataFrame) -> DataFrame:
    """Worked out once, where the session names a folder for checkpoints."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df


def ingest(
    files: DataFrame, known: DataFrame | None = None, rules: tuple[Pattern | Words, ...] = DEFAULT_RULES, replace_with: str = "****", chunk_size: int = 800, overlap: int = 100,
    model: Callable[[list[str]], list[tuple[str, float]]] | None = None, keep: Callable[[DataFrame], DataFrame] = checkpointed,
) -> Ingested:
    """Ingest files (doc_id, path, text). Documents whose kept chunks are those of an earlier one, or of a known one
    (doc_id, content_hash), are duplicates: they give no chunks, and their report counts the chunks that they would have
    given among those skipped. A document without chunks, or of whose chunks none is kept, has failed and has no report.
    `model` cleans garbled contents.

    The chunks stand behind all results; `keep` (a checkpoint, or persist) is where they are worked out once.
    """
    parsed, rejected = route(files)
    chunks = chunk_documents(parsed, chunk_size=chunk_size, overlap=overlap)
    noted = keep(marked(cleaned_by(chunks, model) if model else chunks))
    kept = noted.filter("reason is null and not duplicate")
    hashes = keep(dedup_documents(document_hashes(kept), known).select("doc_id", "content_hash", "duplicate_of"))

    def mask() -> DataFrame:
        return keep(redacted(kept.join(hashes.filter("duplicate_of is null"), "doc_id", "left_semi"), "content", rules=rules, replace_with=replace_with))

    skipped = F.col("dedup_skipped") + F.when(F.col("duplicate_of").isNotNull(), F.col("kept_blocks")).otherwise(0)
    told = reports(noted).join(hashes, "doc_id").withColumn("dedup_skipped", skipped)
    counted = noted.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull() & ~F.col("duplicate")).alias("kept"))
    known_as = parsed.select("doc_id").distinct().join(counted, "doc_id", "left").join(hashes.select("doc_id", "duplicate_of"), "doc_id", "left")
    error = F.when(F.col("total").isNull(), "no chunks").when(F.col("kept") == 0, "no content")
    status = F.when(error.isNotNull(), "failed").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("indexed")
    chunk_count = F.when(status == "indexed", F.col("total")).otherwise(F.lit(0).cast("long"))
    outcomes = known_as.select("doc_id", status.alias("status"), error.alias("error"), chunk_count.alias("chunk_count"), "duplicate_of")
    return Ingested(told, rejected, outcomes, mask)
