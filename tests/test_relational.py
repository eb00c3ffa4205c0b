"""Relational tables in a database of the JVM: round trips, even splits, writers that are lost."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from quarry.sources import relational


@pytest.fixture
def url():
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


def rows(spark, ids, word):
    return spark.createDataFrame([(i, f"{word}{i}") for i in ids], "id int, word string")


def held(spark, url):
    return {r.id: r.word for r in spark.read.format("jdbc").option("url", url).option("dbtable", "docs").load().collect()}


def test_rows_are_replaced_once(spark, url):
    rows(spark, range(10), "old").write.format("jdbc").option("url", url).option("dbtable", "docs").save()
    assert relational.upsert_table(rows(spark, [3, 4, 50], "new"), url, "docs", ["id"], "b-1")
    wanted = {i: f"old{i}" for i in range(10)} | {i: f"new{i}" for i in (3, 4, 50)}
    assert held(spark, url) == wanted
    assert not relational.upsert_table(rows(spark, [3], "again"), url, "docs", ["id"], "b-1")  # the batch is noted
    assert held(spark, url) == wanted
    assert relational.upsert_table(rows(spark, [], "x"), url, "docs", ["id"], "b-2") and held(spark, url) == wanted
    for bad in ("x; DROP TABLE docs", "a'b"):
        with pytest.raises(ValueError, match="plain"):
            relational.upsert_table(rows(spark, [1], "x"), url, bad, ["id"], "b")
        with pytest.raises(ValueError, match="plain"):
            relational.upsert_table(rows(spark, [1], "x"), url, "docs", ["id"], bad)


@pytest.mark.parametrize("point", ["staged", "merged"])
def test_a_lost_writer_leaves_the_table_whole(spark, url, monkeypatch, point):
    rows(spark, range(6), "old").write.format("jdbc").option("url", url).option("dbtable", "docs").save()
    before = held(spark, url)
    new = rows(spark, [1, 9], "new")
    if point == "staged":  # lost after the tasks have written
        monkeypatch.setattr(relational, "_apply", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        error = RuntimeError
    else:  # lost within the transaction, after the delete: the new rows don't fit
        new, good, error = new.withColumn("more", F.lit(1)), new, Exception
    with pytest.raises(error):
        relational.upsert_table(new, url, "docs", ["id"], "b")
    assert held(spark, url) == before
    monkeypatch.undo()
    assert relational.upsert_table(good if point == "merged" else new, url, "docs", ["id"], "b")
    assert held(spark, url) == before | {1: "new1", 9: "new9"}


def test_reads_are_split_evenly(spark, url):
    ids = [*range(1000), *(10**6 + i * 10**4 for i in range(1000)), 10**9]  # even bounds would put nearly all into one
    df = spark.createDataFrame([*((i, "x") for i in ids), (None, "none"), (None, "none")], "id long, word string")
    df.write.format("jdbc").option("url", url).option("dbtable", "docs").save()
    got = relational.read_table(spark, url, "docs", "id", 8)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * len(ids) / 8
    df.limit(0).write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", "docs").save()
    assert relational.read_table(spark, url, "docs", "id", 8).count() == 0
