"""Contexts, citations, history and stored turns of answered questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.redaction import redacted
from quarry.functions.text import cut

# Texts of the context and the history.
SOURCE, NO_HITS, NO_HISTORY, TURN_JOINT, PATH_JOINT = "来源：", "（无检索结果）", "无", "；", " › "
CITED, TITLE, SAID = 500, 20, 80


def context(hits: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """query_id, context: numbered sources and contents in rank order; a fixed text for questions without hits."""
    path = F.when(F.coalesce(F.col("section_path"), F.lit("")) != "", F.concat(F.lit(PATH_JOINT), F.col("section_path"))).otherwise("")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("doc_id").cast("string"), path).alias("s"), "content")))
    entry = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit(f"] {SOURCE}"), x["s"], F.lit("\n"), x["content"])
    out = hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, entry), "\n\n").alias("context"))
    if questions is None:
        return out
    return questions.select("query_id").join(out, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_HITS)))


def citations(hits: DataFrame) -> DataFrame:
    """query_id, index, doc_id, chunk_index, section_path, content (cut, then masked), score."""
    masked = redacted(hits.withColumn("content", F.substring("content", 1, CITED)), "content", "__masked", "__hits")
    index = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return masked.select("query_id", index.alias("index"), "doc_id", "chunk_index", "section_path", F.col("__masked").alias("content"), "score")


def refs_json(cited: DataFrame) -> DataFrame:
    """query_id, refs_json: a question's citations as one JSON list."""
    row = F.struct("index", "doc_id", "chunk_index", "section_path", "content", "score")
    return cited.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("refs_json"))


def history(messages: DataFrame, turns: int = 4, most: int = SAID) -> DataFrame:
    """messages with history: the turns before, each cut, as one text."""
    before = Window.partitionBy("session_id").orderBy("id").rowsBetween(-turns, -1)
    said = F.concat(F.col("role"), F.lit(": "), F.substring("content", 1, most))
    return messages.withColumn("__said", said).withColumn("history", F.coalesce(F.nullif(F.array_join(F.collect_list("__said").over(before), TURN_JOINT), F.lit("")), F.lit(NO_HISTORY))).drop("__said")


def stored_turns(turns: DataFrame) -> DataFrame:
    """session_id, pos, role, content, refs_json, title: a question and its answer as two rows; title for new sessions."""
    title = F.when(F.col("is_new"), F.substring("question", 1, TITLE))
    row = lambda pos, role, content, refs: F.struct(F.lit(pos).alias("pos"), F.lit(role).alias("role"), content.alias("content"), refs.alias("refs_json"))
    both = F.array(row(0, "user", F.col("question"), F.lit("[]")), row(1, "assistant", F.col("answer"), F.col("refs_json")))
    return turns.select("session_id", title.alias("title"), F.explode(both).alias("m")).select("session_id", "m.*", "title")


def audit_row(resource: Column, detail: Column) -> tuple[Column, Column]:
    """Resource and detail as they are stored."""
    return cut(resource, 128), cut(detail, 512)
