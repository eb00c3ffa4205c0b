"""Retrieval metrics, means of judge scores, refusals and the regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tolerance of each metric, and signs of a refusal.
TOLERANCE = {"recall_at_k": 0.05, "mrr": 0.05, "faithfulness": 0.05, "answer_relevancy": 0.05, "context_precision": 0.05}
DEFAULT_TOLERANCE = 0.05
REFUSALS, REFUSAL_MOST = ("知识库", "无法", "抱歉", "只能"), 200


def hit_rank(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """case_id, hit_rank: the first rank with the case's doc_id and a section path that holds its prefix; null if none."""
    h = hits.select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("__d"), F.col("section_path").alias("__s"), F.col("rank").alias("__r"))
    # cases are read once, as they may be dear; one that is listed several times is met once and given as often
    own = cases.groupBy("case_id").agg(F.collect_list(F.struct("doc_id", "section_prefix")).alias("__own"))
    good = F.exists("__own", lambda c: (c["doc_id"] == F.col("__d")) & F.coalesce(F.col("__s"), F.lit("")).contains(F.coalesce(c["section_prefix"], F.lit(""))))
    met = own.join(h, "case_id", "left").groupBy("case_id").agg(F.first(F.size("__own")).alias("__n"), F.min(F.when(good, F.col("__r"))).alias("hit_rank"))
    return met.select("case_id", "hit_rank", F.explode(F.array_repeat(F.lit(0), F.col("__n"))).alias("__i")).drop("__i")


def retrieval_metrics(ranks: DataFrame, k: int = 5) -> DataFrame:
    """cases, hits, recall_at_k, mrr over hit ranks from 1."""
    hit = F.col("hit_rank") <= k
    total = lambda c: F.sum(F.when(hit, c).otherwise(0.0))
    share = lambda c: F.when(F.count("*") > 0, F.round(total(c) / F.count("*"), 3)).otherwise(0.0)
    return ranks.agg(F.count("*").alias("cases"), F.count(F.when(hit, 1)).alias("hits"), share(F.lit(1.0)).alias("recall_at_k"), share(1 / F.col("hit_rank")).alias("mrr"))


def metric_means(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean of each named column."""
    means = scores.agg(*[F.round(F.avg(m), 3).alias(m) for m in metrics])
    return means.unpivot([], metrics, "metric", "mean")


def refusal_rate(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """total, passed, rate: answers that decline, and are short."""
    signs = F.col(text_col).rlike("|".join(REFUSALS))
    ok = F.coalesce(signs & (F.length(text_col) < REFUSAL_MOST), F.lit(False))
    return answers.agg(F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("passed"), F.round(F.avg(ok.cast("double")), 3).alias("rate"))


def regression_gate(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, value, baseline, tolerance, passed for metrics that the baseline has."""
    known = F.create_map(*[F.lit(x) for pair in TOLERANCE.items() for x in pair])
    tolerance = F.coalesce(known[F.col("metric")], F.lit(DEFAULT_TOLERANCE))
    joined = metrics.join(baseline, "metric").withColumn("tolerance", tolerance)
    return joined.select("metric", "value", "baseline", "tolerance", (F.col("value") - F.col("baseline") >= -F.col("tolerance")).alias("passed"))


def gate_passed(gate: DataFrame) -> DataFrame:
    return gate.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count(F.when(~F.col("passed"), 1)).alias("failures"))
