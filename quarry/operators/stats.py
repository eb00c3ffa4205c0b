"""Counts for overviews and question trends. Scopes are applied by the caller; an empty scope has no rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_DEPARTMENT = "未分类"


def overview(docs: DataFrame, users: DataFrame) -> DataFrame:
    """active_users, documents, departments, chunks over documents that aren't disabled."""
    by = docs.filter("status != 'disabled'").groupBy("department").agg(F.count("*").alias("n"), F.sum("chunk_count").alias("c"))
    cards = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.count("department").alias("departments"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"))
    return users.filter("is_active").agg(F.count("*").alias("active_users")).crossJoin(cards)  # one row and one row


def documents_by_department(docs: DataFrame) -> DataFrame:
    label = F.when(F.coalesce("department", F.lit("")) == "", NO_DEPARTMENT).otherwise(F.col("department"))
    return docs.filter("status != 'disabled'").groupBy(label.alias("department")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "department")


def by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def question_trend(messages: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """day, label, questions of the last days up to as_of, days without any included."""
    first = as_of - dt.timedelta(days=days - 1)
    every = messages.sparkSession.createDataFrame([(first + dt.timedelta(days=i),) for i in range(days)], "day date")
    counts = messages.filter(F.col("role") == "user").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return every.join(counts, "day", "left").select("day", F.date_format("day", "MM-dd").alias("label"), F.coalesce("n", F.lit(0).cast("long")).alias("questions"))


def questions_by_department(messages: DataFrame, sessions: DataFrame, users: DataFrame) -> DataFrame:
    asked = messages.filter(F.col("role") == "user").groupBy("session_id").agg(F.count("*").alias("n"))
    return asked.join(sessions, "session_id").join(users.select("user_id", "department"), "user_id").groupBy("department").agg(F.sum("n").alias("questions"))


def recent_sessions(sessions: DataFrame, most: int = 50) -> DataFrame:
    """user_id, session_id, rank of the most recently updated sessions of each user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("session_id"))
    return sessions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def session_messages(messages: DataFrame, sessions: DataFrame, user_id: int, session_id: int) -> DataFrame:
    """A session's messages in order, for its owner only."""
    own = sessions.filter((F.col("user_id") == user_id) & (F.col("session_id") == session_id))
    return messages.join(own.select("session_id"), "session_id", "left_semi").orderBy("id")
