"""Keyword search by the stored index against a search through all documents."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarry.operators import catalog, keyword_index

DOC = "doc_id string, title string, department string, uploaded_by string, status string, kb_id int, created_at int"


def documents(spark, rng, ids):
    words = ["Report", "report_2", "100%", "budget", "Straße", "机器学习", "a", "", "x\\y", "Ab", "ÉTÉ"]
    return spark.createDataFrame([(i, rng.choice([None, " ".join(rng.choice(words) for _ in range(3))]), rng.choice(["Sales", "研发部", None]), rng.choice(["ann", "Bob", None]), rng.choice(["indexed", "failed"]), rng.choice([None, 1, 2]), n) for n, i in enumerate(ids)], DOC)


def test_pages_are_those_of_a_full_search_also_after_updates(spark, tmp_path, monkeypatch):
    for name, value in (("BUCKETS", 4), ("PARTS", 8)):
        monkeypatch.setattr(keyword_index, name, value)
    rng, path = random.Random(1), str(tmp_path)
    docs = documents(spark, rng, [f"d{i}" for i in range(120)])
    keyword_index.write_index(docs, path)
    keywords = ["report", "REPORT_", "0%", "t_2", "机器", "学", "a", "é", "ÉTÉ", "straße", "x\\", "absent", "budget a", "d1", "sale", None, "%", "_"]
    page = lambda df: [tuple(sorted(r.asDict().items(), key=str)) for r in df.collect()]

    def same(docs, some=keywords):
        for k in some:
            for more in ({}, {"field": "title"}, {"departments": ["Sales"], "status": "indexed", "offset": 3, "limit": 4})[: 3 if k == "a" else 1]:
                assert page(keyword_index.search(spark, path, k, **more)) == page(catalog.search_documents(docs, keyword=k, **more)), (k, more)

    same(docs)
    new = documents(spark, rng, ["d3", "d7", "n1", "n2"])
    files = lambda: {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "cards").glob("part=*")}
    old = files()
    touched = keyword_index.update_index(spark, path, spark.createDataFrame([("d9",), ("nobody",)], "doc_id string"), new)
    assert {f"part={p}" for p in touched} == {p for p, f in files().items() if old.get(p) != f} and len(touched) <= 6 < keyword_index.PARTS
    after = docs.filter(~F.col("doc_id").isin("d3", "d7", "d9")).unionByName(new).cache()
    same(after, ["report", "a", "d9", "n1", None])
    monkeypatch.setattr(keyword_index, "LISTED", 1)
    same(after, ["report", "学"])


def test_only_candidates_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "BUCKETS", 8)
    docs = spark.range(3000).selectExpr("CAST(id AS STRING) AS doc_id", "concat('title ', id) AS title", "CAST(id AS INT) AS created_at")
    keyword_index.write_index(docs, str(tmp_path))
    found = keyword_index.search(spark, str(tmp_path), "tle 2719")
    assert [r.doc_id for r in found.collect()] == ["2719"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan.split("PartitionFilters")[1][:200] and "doc_id IN" in plan.replace("In(doc_id", "doc_id IN") or "EqualTo(doc_id" in plan
    assert found.inputFiles() and keyword_index.candidates(spark, str(tmp_path), "tle 2719").count() < 20
