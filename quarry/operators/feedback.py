"""From disliked answers to new evaluation cases."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip

KEPT_INTENTS = ("qa", "summary")


def questions_of_answers(messages: DataFrame) -> DataFrame:
    """Disliked answers with the last strictly earlier question of their session; answers without one are dropped."""
    earlier = Window.partitionBy("session_id").orderBy(F.unix_micros("created_at")).rangeBetween(Window.unboundedPreceding, -1)
    asked = F.when(F.col("role") == "user", F.struct("created_at", "id", "content"))
    paired = messages.withColumn("__q", F.max(asked).over(earlier))
    down = (F.col("role") == "assistant") & (F.col("feedback") == "down")
    return paired.filter(down & F.col("__q").isNotNull()).withColumn("question", F.col("__q.content")).drop("__q")


Texts = Callable[[list[str]], list[str]]


def _by(fn: Texts, texts: Column) -> Column:
    """A caller's function of a list of texts, batch by batch."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(fn(values.tolist()), index=values.index, dtype=object)

    return run(texts)


def new_cases(messages: DataFrame, known: DataFrame, limit: int = 50, since: Column | None = None, intents: DataFrame | None = None, classify: Texts | None = None, make_reference: Texts | None = None) -> DataFrame:
    """question, answer_id: new cases, newest answers first; what append_cases takes stands beside them:
    doc_id, section_prefix (both empty), intent, reference, source.

    At most 4 * limit disliked answers are looked at and limit pairs taken; then blank questions, those in
    known (question) and repeats go, and those of other intents, by a table (question, intent) or a function.
    References are made by a function, for the questions that stay; without one they are empty.
    """
    down = messages.filter((F.col("role") == "assistant") & (F.col("feedback") == "down"))
    if since is not None:
        down = down.filter(F.col("created_at") >= since)
    newest = down.orderBy(F.desc("created_at"), F.desc("id")).limit(limit * 4).select("id", "session_id")
    theirs = messages.join(F.broadcast(newest.select("session_id").distinct()), "session_id", "left_semi")  # at most 4 * limit sessions
    pairs = questions_of_answers(theirs).join(newest.select("id"), "id", "left_semi").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    trimmed = pairs.withColumn("question", strip(F.col("question"))).filter("question != ''")
    fresh = trimmed.join(known.select("question").distinct(), "question", "left_anti")
    once = Window.partitionBy("question").orderBy(F.desc("created_at"), F.desc("id"))
    fresh = fresh.withColumn("__n", F.row_number().over(once)).filter("__n = 1").select("question", F.col("id").alias("answer_id"))
    if classify is not None:
        fresh = fresh.withColumn("intent", _by(classify, F.col("question"))).filter(F.col("intent").isin(*KEPT_INTENTS))
    elif intents is not None:
        fresh = fresh.join(intents.filter(F.col("intent").isin(*KEPT_INTENTS)).groupBy("question").agg(F.min("intent").alias("intent")), "question")
    else:
        fresh = fresh.withColumn("intent", F.lit(KEPT_INTENTS[0]))
    reference = _by(make_reference, F.col("question")) if make_reference is not None else F.lit("")
    return fresh.select("question", "answer_id", F.lit("").alias("doc_id"), F.lit("").alias("section_prefix"), "intent", reference.alias("reference"), F.concat(F.lit("feedback:"), F.col("answer_id").cast("string")).alias("source"))


def all_cases(golden: DataFrame, feedback: DataFrame) -> DataFrame:
    """Golden cases that aren't chat, and those from feedback."""
    return golden.filter(F.col("intent") != "chat").unionByName(feedback)
