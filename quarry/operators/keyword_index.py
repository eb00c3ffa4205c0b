"""A stored index for keyword search in short columns: grams of up to three characters, and cards of the documents.

`grams` holds a row for each distinct gram of a document's searched column, in lower case, partitioned by a hash of the
gram. `cards` holds the documents, partitioned by a hash of their id. A search reads the keyword's grams, takes documents
that have all of them in one column, reads these cards and tests the keyword itself; so the page is that of a search
through all documents. An update appends grams and writes touched parts of the cards anew. Grams of documents that have
changed or gone stay behind; what they lead to fails the test.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.catalog import SEARCHED, search_documents

LONGEST, BUCKETS, PARTS = 3, 32, 32
#: Candidates up to which their ids are part of the scan's filter.
LISTED = 1_000


def _bucket(value: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")


def grams(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """doc_id, field, gram: the distinct grams of each searched column."""
    fields = [F.struct(F.lit(c).alias("field"), F.lower(F.col(c).cast("string")).alias("v")) for c in SEARCHED if c in docs.columns]
    rows = docs.select("doc_id", F.explode(F.array(*fields)).alias("f")).select("doc_id", "f.field", "f.v").filter("v != ''")
    starts = F.sequence(F.lit(1), F.length("v"))
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("v"))), lambda n: F.transform(F.slice(starts, 1, F.length("v") - n + 1), lambda i: F.substring(F.col("v"), i, n))))
    return rows.select("doc_id", "field", F.explode(F.array_distinct(cut)).alias("gram"))


def asked_grams(keyword: str, longest: int = LONGEST) -> list[str]:
    """What a value must have to hold the keyword."""
    word = keyword.lower()
    n = min(longest, len(word))
    return sorted({word[i : i + n] for i in range(len(word) - n + 1)})


def _append(docs: DataFrame, path: str, mode: str) -> None:
    rows = grams(docs).withColumn("bucket", _bucket(F.col("gram"), BUCKETS))
    # a gram that is everywhere is dealt over some tasks
    rows.repartition("bucket", _bucket(F.col("doc_id"), 4)).sortWithinPartitions("bucket", "gram").write.mode(mode).partitionBy("bucket").parquet(f"{path}/grams")


def _save(cards: DataFrame, path: str) -> None:
    cards.repartition("part").sortWithinPartitions("part", "doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/cards")


def write_index(docs: DataFrame, path: str) -> None:
    """A new index of documents in a folder."""
    _append(docs, path, "overwrite")
    _save(docs.withColumn("part", _bucket(F.col("doc_id"), PARTS)), path)


def cards_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/cards").filter("doc_id is not null")


def update_index(spark: SparkSession, path: str, gone: DataFrame, new: DataFrame) -> list[int]:
    """Take documents out (doc_id) and put documents in, in the place of their like; the parts of cards written."""
    cards = cards_of(spark, path)
    ids = gone.select("doc_id").union(new.select("doc_id")).distinct().withColumn("part", _bucket(F.col("doc_id"), PARTS)).checkpoint()
    touched = sorted(r[0] for r in ids.select("part").distinct().collect())  # at most PARTS
    if touched:
        _append(new, path, "append")
        kept = cards.filter(F.col("part").isin(touched)).join(ids, ["part", "doc_id"], "left_anti").select(*cards.columns).checkpoint()  # read before it is written over
        after = kept.unionByName(new.withColumn("part", _bucket(F.col("doc_id"), PARTS)))
        empty = spark.createDataFrame([(p,) for p in touched], "part int").join(after.select("part").distinct(), "part", "left_anti")
        _save(after.unionByName(empty, allowMissingColumns=True), path)
    return touched


def candidates(spark: SparkSession, path: str, keyword: str, field: str | None = None) -> DataFrame:
    """doc_id of documents that have all grams of the keyword in one column."""
    asked = asked_grams(keyword)
    rows = spark.read.parquet(f"{path}/grams")
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in asked], "g string").select(_bucket(F.col("g"), BUCKETS)).distinct().collect()]
    found = rows.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(asked))
    if field in SEARCHED:
        found = found.filter(F.col("field") == field)
    return found.groupBy("doc_id", "field").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(asked)).select("doc_id").distinct()


def search(spark: SparkSession, path: str, keyword: str | None = None, field: str | None = None, **filters: Any) -> DataFrame:
    """One page of documents: that of `search_documents` over all cards."""
    cards = cards_of(spark, path)
    if keyword:
        ids = candidates(spark, path, keyword, field).checkpoint()
        few = [r[0] for r in ids.limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            parts = [r[0] for r in ids.select(_bucket(F.col("doc_id"), PARTS)).distinct().collect()]
            cards = cards.filter(F.col("part").isin(parts) & F.col("doc_id").isin(few)) if few else cards.limit(0)
        else:
            cards = cards.join(ids.withColumn("part", _bucket(F.col("doc_id"), PARTS)), ["part", "doc_id"], "left_semi")
    return search_documents(cards.drop("part"), keyword=keyword, field=field, **filters)
