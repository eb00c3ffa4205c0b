"""Cleaning, de-duplication and quality reports over chunks (doc_id, chunk_index, content, page)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import content_hash, is_garbled, noise_reason

LEAST_RATIO, LEAST_CONFIDENCE = 0.5, 0.7


def filter_noise(df: DataFrame, text_col: str = "content") -> DataFrame:
    return df.filter(noise_reason(F.col(text_col)).isNull())


def rejection(cleaned: Column, confidence: Column, original: Column) -> Column:
    """Why a model's cleaning isn't taken, or null."""
    return F.when(F.length(cleaned) < LEAST_RATIO * F.length(original), "length_drop").when(confidence < LEAST_CONFIDENCE, "low_confidence")


def apply_model_cleaning(chunks: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_index"), only_garbled: bool = False) -> DataFrame:
    """chunks with accepted texts of results (keys, cleaned_text, confidence) in place; llm_status is cleaned, fallback or null."""
    joined = chunks.join(results.select(*keys, "cleaned_text", "confidence"), list(keys), "left")
    asked = F.col("cleaned_text").isNotNull() & (is_garbled(F.col("content")) if only_garbled else F.lit(True))
    taken = asked & rejection(F.col("cleaned_text"), F.col("confidence"), F.col("content")).isNull()
    status = F.when(taken, "cleaned").when(asked, "fallback")
    return joined.withColumns({"llm_status": status, "content": F.when(taken, F.col("cleaned_text")).otherwise(F.col("content"))}).drop("cleaned_text", "confidence")


def cleaned_by(chunks: DataFrame, fn: Callable[[list[str]], list[tuple[str, float]]], keys: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """chunks with garbled contents cleaned by a caller's function of texts to (text, confidence), where its answer is taken.

    The function sees garbled contents only. If a call fails, its contents stay as they are.
    """

    @F.pandas_udf("text string, confidence double")
    def run(texts: pd.Series) -> pd.DataFrame:
        try:
            got = [(str(t), float(c)) for t, c in fn(texts.tolist())]
        except Exception:  # noqa: BLE001 - a model out of reach must not fail the ingest
            got = []
        return pd.DataFrame(got if len(got) == len(texts) else [("", 0.0)] * len(texts), columns=["text", "confidence"])

    results = chunks.filter(is_garbled(F.col("content"))).select(*keys, run("content").alias("r"))
    return apply_model_cleaning(chunks, results.select(*keys, F.col("r.text").alias("cleaned_text"), F.col("r.confidence").alias("confidence")), keys, only_garbled=True)


def marked(chunks: DataFrame) -> DataFrame:
    """chunks with reason (of noise), hash, length and duplicate: a later chunk of the document with the content of an earlier kept one.

    Who needs no contents of the result doesn't shuffle them: reports go by the length.
    """
    noted = chunks.withColumns({"reason": noise_reason(F.col("content")), "hash": content_hash(F.col("content")), "length": F.length("content")})
    order = Window.partitionBy("doc_id", "hash", F.col("reason").isNull()).orderBy("chunk_index")
    return noted.withColumn("duplicate", F.col("reason").isNull() & (F.row_number().over(order) > 1))


def dedup_chunks(chunks: DataFrame, scope: str = "document", existing: DataFrame | None = None) -> DataFrame:
    """The first chunk of each content, in a document or in the corpus; contents in existing (hash) are dropped."""
    hashed = chunks.withColumn("hash", content_hash(F.col("content")))
    if existing is not None:
        hashed = hashed.join(existing.select("hash").distinct(), "hash", "left_anti")
    if scope == "document":
        order = Window.partitionBy("doc_id", "hash").orderBy("chunk_index")
        return hashed.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n").select(*chunks.columns, "hash")
    # over the corpus one content may be everywhere: the first place is aggregated, then joined
    first = hashed.groupBy("hash").agg(F.min(F.struct("doc_id", "chunk_index")).alias("first")).select("hash", "first.*")
    return hashed.join(first, ["hash", "doc_id", "chunk_index"], "left_semi").select(*chunks.columns, "hash")


def document_hashes(kept: DataFrame) -> DataFrame:
    """doc_id, content_hash of the kept chunks joined by line breaks."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return kept.groupBy("doc_id").agg(F.sha1(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n")).alias("content_hash"))


def dedup_documents(hashes: DataFrame, known: DataFrame | None = None, arrival: str = "doc_id") -> DataFrame:
    """hashes with duplicate_of: the first to arrive with the content, or a known other document; null if none."""
    first = hashes.groupBy("content_hash").agg(F.min_by("doc_id", F.struct(arrival, "doc_id")).alias("first"))
    out = hashes.join(first, "content_hash").withColumn("duplicate_of", F.when(F.col("first") != F.col("doc_id"), F.col("first"))).drop("first")
    if known is None:
        return out
    other = known.select("content_hash", F.col("doc_id").alias("known_id"))
    # a document that comes again is no duplicate of itself
    found = hashes.join(other, "content_hash").filter(F.col("known_id") != F.col("doc_id")).groupBy("doc_id").agg(F.min("known_id").alias("known_id"))
    return out.join(found, "doc_id", "left").withColumn("duplicate_of", F.coalesce("known_id", "duplicate_of")).drop("known_id")


def reports(noted: DataFrame) -> DataFrame:
    """The quality report of each document over marked chunks; counters of model cleaning where llm_status is there."""
    dropped = F.col("reason").isNotNull() | F.col("duplicate")
    status = F.col("llm_status") if "llm_status" in noted.columns else F.lit(None).cast("string")
    length = F.col("length") if "length" in noted.columns else F.length("content")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    # one pass: counts by (document, page, reason), then by document
    fine = noted.groupBy("doc_id", "page", "reason").agg(
        F.count("*").alias("n"), count(dropped).alias("dropped"), count(F.col("duplicate")).alias("duplicates"),
        F.sum(F.when(~dropped, length).otherwise(0)).cast("long").alias("chars"), count(status == "cleaned").alias("cleaned"), count(status == "fallback").alias("fallback"),
    )
    reasons = fine.filter("reason is not null").groupBy("doc_id", "reason").agg(F.sum("n").cast("long").alias("n"))
    reasons = reasons.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))).alias("noise_reasons"))
    total = lambda c: F.sum(c).cast("long")
    pages = fine.groupBy("doc_id", "page").agg(*[total(c).alias(c) for c in ("n", "dropped", "duplicates", "chars", "cleaned", "fallback")])
    documents = pages.groupBy("doc_id").agg(
        total("n").alias("total_blocks"), (total("dropped") - total("duplicates")).alias("filtered_blocks"), total("duplicates").alias("dedup_skipped"), (total("n") - total("dropped")).alias("kept_blocks"),
        total("chars").alias("chars"), count(F.col("n") == F.col("dropped")).alias("empty_pages"), total("cleaned").alias("llm_cleaned"), total("fallback").alias("llm_fallback"),
    )
    average = F.when(F.col("kept_blocks") > 0, F.round(F.col("chars") / F.col("kept_blocks"), 1)).otherwise(F.lit(0.0))
    out = documents.join(reasons, "doc_id", "left").withColumns({"avg_chunk_length": average, "noise_reasons": F.coalesce("noise_reasons", F.lit("{}"))})
    return out.select("doc_id", "total_blocks", "filtered_blocks", "dedup_skipped", "kept_blocks", "avg_chunk_length", "empty_pages", "noise_reasons", "llm_cleaned", "llm_fallback")
