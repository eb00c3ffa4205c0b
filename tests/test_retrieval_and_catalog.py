"""Retrieval, answers, feedback, access, catalog and streaming: literal inputs and their results."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import redaction
from quarry.operators import access, answer, catalog, evaluate, feedback, retrieve, stats
from quarry.streaming import jobs

HITS = "query_id int, chunk_id int, rank int"


def test_rrf(spark):
    dense = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate([1, 2, 3])], HITS)
    sparse = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate([3, 2, 4])], HITS)
    got = retrieve.rrf(dense, sparse).orderBy("rank").collect()
    assert got[0].chunk_id == 3 and {r.chunk_id for r in got} == {1, 2, 3, 4}
    assert got[0].score == pytest.approx(1 / 63 + 1 / 61, abs=1e-6)


def test_tokens(spark):
    got = spark.createDataFrame([("Hello, 知识库 World_2!",)], "t string").select(retrieve.tokens(F.col("t")).alias("x")).first().x
    assert got == ["hello", "world_2", "知识", "识库"]


def test_dense_scope_and_embedding_hook(spark):
    chunks = spark.createDataFrame([(1, "aa", "x"), (2, "b", "y"), (3, "aaa", "y")], "chunk_id long, content string, department string")
    chunks = retrieve.embed(chunks, "content", lambda texts: [[len(t), 1.0] for t in texts])
    queries = retrieve.embed(spark.createDataFrame([(7, "zzzz"), (8, "q")], "query_id long, text string"), "text", lambda texts: [[len(t), 1.0] for t in texts])
    scope = spark.createDataFrame([(7, False, "y"), (8, True, None)], "query_id long, unrestricted boolean, department string")
    got = {(r.query_id, r.rank): r.chunk_id for r in retrieve.dense_topk(chunks, queries, 2, scope).collect()}
    assert got == {(7, 1): 3, (7, 2): 2, (8, 1): 2, (8, 2): 1}
    assert {c for c in (r.chunk_id for r in retrieve.bm25_topk(chunks, spark.createDataFrame([(7, "aa aaa b")], "query_id long, text string"), 5, scope=scope).collect())} == {2, 3}
    assert retrieve.allowed(chunks, None).count() == 3 and retrieve.allowed(chunks, []).count() == 0 and retrieve.allowed(chunks, ["y"]).count() == 2


@pytest.mark.parametrize(("block", "scan"), [(256, 20_000), (2, 20_000), (2, 3)])
def test_bm25_matches_brute_force(spark, monkeypatch, block, scan):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieve, "QUERY_SCAN", scan)
    rng = random.Random(block)
    words = ["the", "a", "cat", "dog", "知识库", "x1", "Über"]
    texts = {f"c{i:02}": " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for i in range(60)} | {"c90": None}
    asked = {i: " ".join(rng.choice([*words, "unknown"]) for _ in range(rng.randint(0, 4))) for i in range(7)}
    departments = {c: rng.choice(["x", "y", None]) for c in texts}
    chunks = spark.createDataFrame([(c, t, departments[c]) for c, t in texts.items()], "chunk_id string, content string, department string").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    scope = spark.createDataFrame([(i, i % 3 == 0, "x" if i % 3 == 1 else "y") for i in range(6)], "query_id long, unrestricted boolean, department string")

    def split(text):
        out = []
        for w in (text or "").lower().split():
            out += [w[i : i + 2] for i in range(len(w) - 1)] if w == "知识库" else [w]
        return out

    held = {c: split(t) for c, t in texts.items()}
    full = {c: t for c, t in held.items() if t}
    average = sum(map(len, full.values())) / len(full)
    for within in (None, scope):
        wanted = set()
        for q, text in asked.items():
            if within is not None and q == 6:
                continue
            found = []
            for c, t in full.items():
                if within is not None and not (q % 3 == 0 or departments[c] == ("x" if q % 3 == 1 else "y")):
                    continue
                score = 0.0
                for w in set(split(text)):
                    df = sum(w in x for x in full.values())
                    tf = t.count(w)
                    score += math.log(1 + (len(full) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / average))
                if score:
                    found.append((-round(score, 6), c))
            wanted |= {(q, c, n, -s) for n, (s, c) in enumerate(sorted(found)[:4], 1)}
        got = {(r.query_id, r.chunk_id, r["rank"], r.score) for r in retrieve.bm25_topk(chunks, queries, 4, scope=within).collect()}
        assert {x[:3] for x in got} == {x[:3] for x in wanted}
        assert sorted(x[3] for x in got) == pytest.approx(sorted(x[3] for x in wanted), abs=2e-6)
    stats = {r.term: (r.df, r.n_chunks, r.avg_length) for r in retrieve.term_stats(chunks).collect()}
    assert stats == {w: (sum(w in x for x in full.values()), len(full), pytest.approx(average)) for w in {w for t in full.values() for w in t}}
    assert retrieve.bm25_topk(chunks.limit(0), queries).count() == 0 and retrieve.bm25_topk(chunks, queries.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "scan"), [(256, 20_000), (2, 3)])
def test_dense_matches_brute_force(spark, monkeypatch, block, scan):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieve, "QUERY_SCAN", scan)
    rng = random.Random(2)
    vectors = {i: [float(rng.randint(-2, 2)) for _ in range(3)] for i in range(50)}
    rows = spark.createDataFrame(list(vectors.items()), "chunk_id long, vector array<double>").repartition(3)
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / max(1e-300, math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))), 6)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in retrieve.dense_topk(rows, rows.filter("chunk_id < 7").withColumnRenamed("chunk_id", "query_id"), 5, itself=False).collect()}
    for q in range(7):
        best = sorted((-cosine(vectors[q], v), i) for i, v in vectors.items() if i != q)[:5]
        assert [got[q, n][0] for n in range(1, 6)] == [i for _, i in best]


def test_rerank_by_a_function(spark):
    hits = spark.createDataFrame([(q, c, n, 0.5) for q in (1, 2, 3) for n, c in enumerate((10, 11, 12), 1)], HITS + ", score double")
    chunks = spark.createDataFrame([(10, "a"), (11, "aaa"), (12, "aa")], "chunk_id int, content string")
    queries = spark.createDataFrame([(1, "long"), (2, "fail"), (3, "few")], "query_id int, text string")

    def scorer(query, texts):
        if query == "fail":
            raise RuntimeError("no model")
        return [len(t) / 10 for t in texts][: 1 if query == "few" else None]

    scores = retrieve.scored(hits, queries, chunks, scorer)
    got = {}
    for r in retrieve.rerank(hits, scores, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert got == {1: [(11, 0.3), (12, 0.2)], 2: [(10, 0.5), (11, 0.5)], 3: [(10, 0.5), (11, 0.5)]}


def test_rerank_falls_back(spark):
    hits = spark.createDataFrame([(1, 10, 1, 0.3), (1, 11, 2, 0.2), (2, 12, 1, 0.1)], HITS + ", score double")
    scores = spark.createDataFrame([(1, 11, 0.9), (1, 10, 0.1)], "query_id int, chunk_id int, relevance double")
    got = [(r.query_id, r["rank"], r.chunk_id, r.score) for r in retrieve.rerank(hits, scores).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 11, 0.9), (1, 2, 10, 0.1), (2, 1, 12, 0.1)]


def test_golden_match_and_gate(spark):
    cases = spark.createDataFrame([(1, "d", "4."), (2, "d", "9."), (3, "none", "")], "case_id int, doc_id string, section_prefix string")
    hits = spark.createDataFrame([(1, 1, "x", "4."), (1, 2, "d", "A > 4. B"), (2, 1, "d", "1.")], "query_id int, rank int, doc_id string, section_path string")
    ranks = evaluate.hit_rank(cases, hits)
    assert {r.case_id: r.hit_rank for r in ranks.collect()} == {1: 2, 2: None, 3: None}
    m = evaluate.retrieval_metrics(ranks).first()
    assert (m.recall_at_k, m.mrr) == (0.333, 0.167)
    metrics = spark.createDataFrame([("mrr", 0.75), ("new", 0.1), ("faithfulness", 0.8)], "metric string, value double")
    base = spark.createDataFrame([("mrr", 0.796), ("faithfulness", 0.931)], "metric string, baseline double")
    gate = evaluate.regression_gate(metrics, base)
    assert {r.metric: r.passed for r in gate.collect()} == {"mrr": True, "faithfulness": False}
    assert evaluate.gate_passed(gate).first().failures == 1


def test_context(spark):
    hits = spark.createDataFrame([(1, 1, "PRD", "4. 功能需求 > 4.6 权限与安全", "正文"), (1, 2, "X", "", "其他")], "query_id int, rank int, doc_id string, section_path string, content string")
    got = {r.query_id: r.context for r in answer.context(hits, spark.createDataFrame([(1,), (2,)], "query_id int")).collect()}
    assert got == {1: "[1] 来源：PRD › 4. 功能需求 > 4.6 权限与安全\n正文\n\n[2] 来源：X\n其他", 2: "（无检索结果）"}


MESSAGE = "id int, session_id int, role string, content string, feedback string, created_at timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_feedback_cases(spark):
    rows = [(1, 1, "assistant", "orphan", "down", at(0)), (2, 2, "user", "q1", "", at(1)), (3, 2, "assistant", "a", "down", at(2)), (4, 3, "user", "q2", "", at(1)), (5, 3, "assistant", "a", "up", at(2)),
            (6, 4, "user", "same", "", at(5)), (7, 4, "assistant", "a", "down", at(5)), (8, 5, "user", " q1 ", "", at(7)), (9, 5, "assistant", "a", "down", at(8)), (10, 6, "user", "  ", "", at(1)), (11, 6, "assistant", "a", "down", at(2)),
            (12, 7, "user", "known", "", at(1)), (13, 7, "assistant", "a", "down", at(2))]
    m = spark.createDataFrame(rows, MESSAGE)
    known = spark.createDataFrame([("known",)], "question string")
    assert {r.id for r in feedback.questions_of_answers(m).collect()} == {3, 9, 11, 13}  # a question at the same time isn't earlier
    assert [(r.question, r.answer_id) for r in feedback.new_cases(m, known).collect()] == [("q1", 9)]
    assert feedback.new_cases(m, known, since=F.lit(at(20))).count() == 0
    intents = spark.createDataFrame([("q1", "chat")], "question string, intent string")
    assert feedback.new_cases(m, known, intents=intents).count() == 0


def test_visibility(spark):
    users = spark.createDataFrame([(1, "super_admin", "a"), (2, "admin", "a"), (3, "admin", "a"), (4, "user", "b"), (5, "user", "")], "user_id int, role string, department string")
    admins = spark.createDataFrame([(2, "b"), (2, "c")], "user_id int, department string")
    scope = access.visible_departments(users, admins)
    assert {(r.user_id, r.unrestricted, r.department) for r in scope.collect()} == {(1, True, None), (2, False, "b"), (2, False, "c"), (4, False, "b")}
    docs = spark.createDataFrame([("x", "a"), ("y", "b")], "doc_id string, department string")
    assert {r.user_id: r.n for r in access.visible_counts(docs, scope).collect()} == {1: 2, 2: 1, 4: 1}
    assert {(r.user_id, r.doc_id) for r in access.scoped(docs, scope).collect()} == {(1, "x"), (1, "y"), (2, "y"), (4, "y")}


@pytest.mark.parametrize(
    "sql",
    ["DELETE FROM documents", "SELECT 1; SELECT 2", "SELECT * FROM documents;", "SELECT * FROM users", "SELECT * FROM documents, users", "", "-- x", "select * from documents d join users on 1=1",
     "SELECT * FROM `users`", "SELECT * FROM documents d, users u", "SELECT * FROM documents JOIN (SELECT * FROM `secret`) s ON 1 = 1", "SELECT * FROM documents WHERE doc_id IN (SELECT id FROM users)",
     "SELECT (SELECT max(x) FROM users) FROM documents", "SELECT * FROM spark_catalog.default.documents", "SELECT * FROM parquet.`/etc`", "SELECT * FROM range(5)", "SELECT reflect('java.lang.System', 'exit', 0) FROM documents",
     "SELECT * FROM (WITH c AS (SELECT * FROM users) SELECT * FROM c)", "SELECT * FROM documents UNION SELECT * FROM /* x */ users", "/* SELECT */ DROP TABLE documents", "SELEC x"],
)
def test_guard_rejects(spark, sql):
    with pytest.raises(ValueError, match=r"."):
        catalog.guarded(spark, sql)


HOSTILE = """SELECT TRANSFORM(doc_id) USING 'echo ran-a-command' AS (x string) FROM documents
SELECT MAP(doc_id) USING 'cat' AS (x string) FROM documents
FROM documents SELECT TRANSFORM(doc_id) USING 'cat'
SELECT * FROM IDENTIFIER('us'||'ers')
SELECT * FROM IDENTIFIER('documents')
SELECT IDENTIFIER('reflect')('java.lang.System', 'exit', '0') FROM documents
SELECT IDENTIFIER('ti' || 'tle') FROM documents
SELECT java_method('java.lang.System', 'exit', 0) FROM documents
SELECT try_reflect('java.lang.System', 'getenv') FROM documents
SELECT spark_catalog.default.f(doc_id) FROM documents
SELECT input_file_name() FROM documents
SELECT current_user(), session_user() FROM documents
SELECT current_catalog() FROM documents
SELECT version() FROM documents
SELECT sleep(9) FROM documents
SELECT rand() FROM documents
SELECT explode(sequence(1, 1000000000)) FROM documents
SELECT sequence(1, 1000000000) FROM documents
SELECT repeat(title, 1000000000) FROM documents
SELECT array_repeat(title, 1000000000) FROM documents
SELECT lpad(title, 1000000000, 'x') FROM documents
SELECT collect_list(title) FROM documents
SELECT aggregate(array(1), 0, (a, x) -> a + x) FROM documents
SELECT aes_decrypt(title, 'k') FROM documents
SELECT raise_error('x') FROM documents
SELECT * FROM documents a, documents b
SELECT * FROM documents a CROSS JOIN documents b
SELECT * FROM documents a JOIN documents b
SELECT * FROM documents a JOIN documents b ON 1 = 1
SELECT * FROM documents a JOIN documents b ON a.doc_id = a.doc_id
SELECT * FROM documents a JOIN documents b ON a.doc_id < b.doc_id
SELECT * FROM documents a JOIN documents b ON a.doc_id = b.doc_id OR 1 = 1
SELECT * FROM documents a JOIN documents b ON NOT a.doc_id = b.doc_id
SELECT * FROM documents NATURAL JOIN users
SELECT * FROM documents LATERAL VIEW explode(array(1, 2)) t AS x
SELECT * FROM documents, LATERAL (SELECT * FROM documents)
SELECT * FROM documents, LATERAL explode(array(1)) t
SELECT * FROM documents TABLESAMPLE (10 PERCENT)
SELECT * FROM documents VERSION AS OF 1
SELECT * FROM documents TIMESTAMP AS OF '2020-01-01'
SELECT * FROM STREAM documents
SELECT * FROM STREAM(documents)
SELECT /*+ BROADCAST(d) */ * FROM documents d
SELECT * FROM documents LIMIT ALL
SELECT * FROM documents LIMIT 10 * 10
SELECT * FROM documents LIMIT (SELECT max(doc_id) FROM documents)
SELECT * FROM documents |> WHERE doc_id = 1
SELECT * FROM documents PIVOT (count(*) FOR department IN ('a'))
SELECT * FROM VALUES (1), (2) AS t(a)
SELECT * FROM csv.`/etc/passwd`
SELECT * FROM text.`/etc/passwd`
SELECT * FROM global_temp.documents
SELECT * FROM read_files('/etc/passwd')
SELECT :p FROM documents
SELECT (WITH c AS (SELECT * FROM users) SELECT max(x) FROM c) FROM documents
SELECT * FROM documents WHERE EXISTS (SELECT * FROM users)
SELECT * FROM documents WHERE doc_id = (SELECT max(id) FROM users)
SELECT * FROM documents EXCEPT SELECT * FROM users
SELECT title FROM documents GROUP BY title HAVING max(doc_id) > (SELECT count(*) FROM users)
SELECT title FROM documents ORDER BY (SELECT 1 FROM users)
SELECT sum(doc_id) OVER (PARTITION BY (SELECT 1 FROM users)) FROM documents
SELECT CASE WHEN EXISTS (SELECT 1 FROM users) THEN 1 END FROM documents
INSERT INTO documents SELECT * FROM documents
CREATE TABLE x AS SELECT * FROM documents
SET spark.sql.ansi.enabled = false
EXPLAIN SELECT * FROM documents
ADD JAR '/x.jar'""".split("\n")


@pytest.mark.parametrize("sql", HOSTILE)
def test_guard_refuses_what_is_not_listed(spark, sql):
    spark.createDataFrame([(1, "secret")], "id int, x string").createOrReplaceTempView("users")
    with pytest.raises(ValueError, match=r"."):
        catalog.guarded(spark, sql)


@pytest.mark.parametrize(
    "sql",
    ["SELECT DISTINCT department FROM documents ORDER BY department", "SELECT department, count(*) AS n FROM documents WHERE title ILIKE '%a%' AND doc_id BETWEEN 1 AND 5 GROUP BY department HAVING count(*) > 1 ORDER BY n DESC LIMIT 5",
     "SELECT a.doc_id FROM documents a JOIN documents b ON a.doc_id = b.doc_id AND b.title LIKE 'x%'", "SELECT * FROM documents WHERE doc_id IN (SELECT max(doc_id) FROM documents GROUP BY department) OR title IS NULL",
     "SELECT title, row_number() OVER (PARTITION BY department ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM documents", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE CAST(-doc_id AS STRING) || '!' END AS x FROM documents LIMIT 3 OFFSET 2",
     "SELECT title FROM documents UNION ALL SELECT department FROM documents", "SELECT (SELECT max(doc_id) FROM documents) AS m, 1 + 2 * 3 AS x FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id)"],
)
def test_guard_allows(spark, sql):
    assert catalog.guarded(spark, sql).startswith(sql)


def test_no_limit_goes_beyond_the_ceiling(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id")
    assert catalog.query_documents(spark, docs, "SELECT doc_id FROM documents LIMIT 100000000").count() == 1000


def test_guard_adds_limit(spark):
    assert catalog.guarded(spark, "SELECT * FROM documents -- c") == "SELECT * FROM documents -- c\nLIMIT 50"
    assert catalog.guarded(spark, "/* a */ SELECT * FROM documents LIMIT 3").endswith("LIMIT 3")
    assert catalog.guarded(spark, "SELECT * FROM documents WHERE title = 'limit'").endswith("LIMIT 50")
    assert catalog.guarded(spark, "SELECT * FROM (SELECT * FROM documents LIMIT 900) d").endswith("LIMIT 50")
    docs = spark.createDataFrame([("x" * 300,)] * 60, "title string")
    found = catalog.query_documents(spark, docs, "SELECT title FROM documents WHERE title <> ';limit' -- all")
    assert found.count() == 50 and found.first().title == "x" * 200 + "…"


def test_search_documents_escapes_keywords(spark):
    docs = spark.createDataFrame([(1, "50%_off", "d"), (2, "500 off", "d")], "doc_id int, title string, department string")
    assert [r.doc_id for r in catalog.search_documents(docs, keyword="0%_O", field="title", order=[F.col("doc_id")]).collect()] == [1]
    assert catalog.search_documents(docs, departments=[], order=[F.col("doc_id")]).count() == 0
    with pytest.raises(ValueError, match="kb9"):
        catalog.assign_kb(docs.withColumn("kb_id", F.lit(None).cast("int")), spark.createDataFrame([(1, "kb1", "d")], "id int, name string, department string"), "kb9")


def test_trend_has_every_day(spark):
    m = spark.createDataFrame([(1, 1, "user", "q", "", dt.datetime(2024, 1, 3, 23, 59))], MESSAGE)
    got = stats.question_trend(m, dt.date(2024, 1, 4)).orderBy("day").collect()
    assert [(r.label, r.questions) for r in got][-2:] == [("01-03", 1), ("01-04", 0)] and len(got) == 7


def test_lockout_rules():
    state, outcomes = (0, 0.0, 0.0), []
    for t, ok in [(0, False), (10, False), (20, False), (30, False), (40, False), (50, True), (339, False), (340, False), (341, True), (400, False), (701, False)]:
        state, outcome = jobs.next_attempt(state, float(t), ok)
        outcomes.append(outcome)
    assert outcomes == ["failed"] * 5 + ["locked", "locked", "failed", "ok", "failed", "failed"]
    assert state[0] == 1  # the window that began at 400 is over


def test_batch_lockout_in_pieces(spark):
    rng = random.Random(7)
    rows = [("hot", float(t), rng.random() < 0.1) for start in range(0, 90_000, 3_000) for t in (start + rng.randint(0, 1500) for _ in range(60))]
    rows += [("edge", float(t), False) for t in (0, 1, 2, 3, 303, 304, 305, 306, 307, 606, 607, 907)]
    rows += [(u, rng.random() * 20_000, rng.random() < 0.3) for u in ("a", "b", None) for _ in range(150)] + [("a", None, False), ("b", float("nan"), True)]
    df = spark.createDataFrame(rows, "username string, ts double, success boolean")
    expected = []
    for user in {u for u, _, _ in rows}:
        state = (0, 0.0, 0.0)
        for ts, ok in sorted((float("inf") if t is None or t != t else t, ok) for u, t, ok in rows if u == user):
            state, outcome = jobs.next_attempt(state, ts, ok)
            expected.append((str(user), ts, outcome))
    got = [(str(r.username), float("inf") if r.ts is None or r.ts != r.ts else r.ts, r.outcome) for r in jobs.login_lockout(df).collect()]
    assert sorted(got) == sorted(expected)
    assert {"locked", "failed", "ok"} <= {o for u, _, o in got if u == "hot"}
    sizes = [r["count"] for r in jobs.attempt_pieces(df).filter("username = 'hot'").groupBy("piece").count().collect()]
    assert sum(sizes) == 1800 and len(sizes) >= 30 and max(sizes) <= 60


def test_lockout_query_is_of_real_users(spark):
    from quarry.plans.queries import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_type in ('error', 'view')")
    got = QUERIES["t3_login_lockout"](spark, "/root/testdata/sf0.001")
    assert {r.username for r in got.select("username").distinct().collect()} == {str(r.user_id) for r in events.select("user_id").distinct().collect()}
    assert got.count() == events.count()


def write(spark, rows, schema, folder, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, df, name, tmp_path, mode="append"):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else state with a timeout asks for batches without end
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.table(name).collect()


def test_streamed_lockout_keeps_state(spark, tmp_path):
    schema, folder = "username string, ts double, success boolean", str(tmp_path / "in")
    write(spark, [("u", float(i), False) for i in range(3)], schema, folder, 1)
    write(spark, [("u", float(3 + i), False) for i in range(4)], schema, folder, 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = sorted((r.ts, r.outcome) for r in run(spark, jobs.login_lockout(stream), "lockout", tmp_path))
    batch = sorted((r.ts, r.outcome) for r in jobs.login_lockout(spark.read.schema(schema).parquet(folder)).collect())
    assert sorted(o for _, o in got) == sorted(o for _, o in batch) == ["failed"] * 5 + ["locked"] * 2


def test_streamed_redaction_across_frames(spark, tmp_path):
    schema, folder = "answer_id int, seq int, delta string, last boolean", str(tmp_path / "deltas")
    write(spark, [(1, 0, "联系 1381", False), (1, 1, "234567", False)], schema, folder, 1)
    write(spark, [(1, 2, "8，请惠存", True)], schema, folder, 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = sorted((r.part, r.masked) for r in run(spark, jobs.redact_deltas(stream), "redacted", tmp_path))
    assert got == [(0, "联系 "), (1, "138****5678，请惠存")]  # the first part comes before the end
    held = run(spark, jobs.redact_deltas(stream, (*jobs.DEFAULT_RULES, redaction.Words("w", ("，请",)))), "held", tmp_path)
    assert [(r.part, r.masked) for r in held] == [(0, "联系 138****5678****惠存")]
    assert jobs.redact_stream(spark.read.schema(schema).parquet(folder)).first().masked == "联系 138****5678，请惠存"


def test_parts_of_streamed_answers_are_masked_like_the_whole(spark):
    rng = random.Random(6)
    bits = ["13812345678", "110101199003074512", "a.b@c-d.org", "sk-abcdefgh12", "10.0.0.1", " ", "，", "联系", "x", "-", "\n", "\"", "１３８１２３４５６７８", "é", "6222020200112233445"]
    rows, wholes = [], []
    for i in range(150):
        whole = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        held, part, at = "", 0, 0
        while at < len(whole):
            n = rng.randint(1, 7)
            held, at = held + whole[at : at + n], at + n
            cut = len(held) if at >= len(whole) else jobs.safe_cut(held)
            if cut:
                rows.append((i, part, held[:cut]))
            held, part = held[cut:], part + 1
        wholes.append((i, whole))
    masked = {}
    for r in redaction.redacted(spark.createDataFrame(rows, "i int, part int, text string")).orderBy("i", "part").collect():
        masked[r.i] = masked.get(r.i, "") + r.masked
    assert masked == {r.i: r.masked for r in redaction.redacted(spark.createDataFrame(wholes, "i int, text string")).collect()}


def test_streamed_rate_equals_batch(spark, tmp_path):
    schema, folder = "ts timestamp, method string, path string, status int, latency double", str(tmp_path / "req")
    rows = [(dt.datetime(2024, 1, 1, 0, m, s), "GET", "/x", 200, 0.2) for m in range(6) for s in (0, 31)] + [(dt.datetime(2024, 1, 2), "GET", "/x", 200, 0.2)]
    write(spark, rows, schema, folder, 1)
    batch = {(r.start, r.requests) for r in jobs.request_rate(spark.read.schema(schema).parquet(folder)).collect()}
    stream = spark.readStream.schema(schema).parquet(folder)
    got = {(r.start, r.requests) for r in run(spark, jobs.request_rate(stream), "rate", tmp_path, "complete")}
    assert got == batch and max(n for _, n in got) == 10


def test_p95(spark):
    rows = [(dt.datetime(2024, 1, 1), "GET", "/x", 0.04)] * 90 + [(dt.datetime(2024, 1, 1), "GET", "/x", 0.2)] * 10 + [(dt.datetime(2024, 1, 1), "GET", "/y", 99.0)]
    df = spark.createDataFrame(rows, "ts timestamp, method string, path string, latency double")
    assert {r.path: r.p95 for r in jobs.latency_p95(df).collect()} == {"/x": 0.175, "/y": 30.0}


def test_task_consumer(spark, tmp_path):
    schema, folder = "doc_id string, retry string", str(tmp_path / "tasks")
    write(spark, [("good", "0"), ("bad", "2"), ("worse", "3"), ("off", "0")], schema, folder, 1)
    seen = {"done": [], "retry": [], "dead": []}
    sink = lambda name: lambda df: seen[name].extend((r.doc_id, r.retry) for r in df.collect())
    off = spark.createDataFrame([("off",)], "doc_id string")
    work = lambda df: df.select("doc_id", (F.col("doc_id") == "good").alias("ok"), F.lit("e").alias("error"))
    q = jobs.consume_tasks(spark.readStream.schema(schema).parquet(folder), work, lambda: off, sink("done"), sink("retry"), sink("dead"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert seen == {"done": [("good", "0")], "retry": [("bad", "3")], "dead": [("worse", "3")]}


def test_task_consumer_loses_no_task(spark, tmp_path):
    """Tasks without a result fail, several results of a task are one, and a document's tasks are told apart by their ids."""
    seen = {"done": [], "retry": [], "dead": []}
    sink = lambda name, key: lambda df: seen[name].extend((r[key], r.retry, r.error) for r in df.collect())
    off = spark.createDataFrame([], "doc_id string")
    schema, folder = "task_id int, doc_id string, retry string", str(tmp_path / "tasks")
    write(spark, [(1, "d", "0"), (2, "d", "1"), (3, "e", "0"), (4, "f", "3")], schema, folder, 1)
    work = lambda df: df.filter("task_id < 3").select("task_id", (F.col("task_id") == 1).alias("ok"), F.lit("x").alias("error")).unionByName(df.filter("task_id = 1").selectExpr("task_id", "true as ok", "'y' as error"))
    q = jobs.consume_tasks(spark.readStream.schema(schema).parquet(folder), work, lambda: off, sink("done", "task_id"), sink("retry", "task_id"), sink("dead", "task_id"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(seen["retry"]) == [(2, "2", "x"), (3, "1", "no result")]
    assert (seen["done"], seen["dead"]) == ([(1, "0", "y")], [(4, "3", "no result")])
    schema, folder = "doc_id string, retry string", str(tmp_path / "twice")
    write(spark, [("d", "0"), ("d", "2")], schema, folder, 1)
    seen["retry"].clear()
    q = jobs.consume_tasks(spark.readStream.schema(schema).parquet(folder), lambda df: df.selectExpr("doc_id", "false as ok", "'z' as error"), lambda: off, sink("done", "doc_id"), sink("retry", "doc_id"), sink("dead", "doc_id"), str(tmp_path / "ck2"))
    q.awaitTermination(120)
    assert seen["retry"] == [("d", "3", "z")]


def test_watcher_turns(spark, tmp_path):
    """New and changed files are ingested once each; failed ones come again."""
    from quarry.sources import files

    folder, state = tmp_path / "watched", {"df": spark.createDataFrame([], "path_key string, path string, fingerprint string, department string, doc_id string")}
    folder.mkdir()
    (folder / "a.md").write_text("one")
    (folder / "b.txt").write_text("two")
    (folder / "c.exe").write_text("no")

    def save(df):
        rows = df.collect()
        state["df"] = spark.createDataFrame(rows, df.schema)

    def turn(fail=()):
        work = lambda df: df.filter(~F.col("doc_id").isin(*fail, "")).selectExpr("path_key", "true as ok")
        done = jobs.scan_once(files.listing(spark, str(folder)), lambda: state["df"], save, work)
        return sorted((r.path.rsplit("/", 1)[1], r.status, r.ok) for r in done.collect())

    fail = [r.doc_id for r in jobs.connector.scan_changes(files.listing(spark, str(folder)), state["df"]).collect() if r.path.endswith("b.txt")]
    assert turn(fail) == [("a.md", "new", True), ("b.txt", "new", False)]
    assert turn() == [("b.txt", "new", True)]
    (folder / "a.md").write_text("one more")
    assert turn() == [("a.md", "updated", True)]
    assert turn() == []


def test_feedback_cases_by_functions(spark, tmp_path):
    from quarry.sources import files

    rows = [(i, i // 2, "user" if i % 2 == 0 else "assistant", f"q{i // 2}", "down" if i % 2 else "", at(i)) for i in range(12)]
    m = spark.createDataFrame(rows, MESSAGE)
    known = spark.createDataFrame([("q0",)], "question string")
    found = feedback.new_cases(m, known, classify=lambda qs: ["chat" if q == "q1" else "summary" if q == "q2" else "qa" for q in qs], make_reference=lambda qs: [f"ref {q}" for q in qs])
    got = {(r.question, r.intent, r.reference, r.source, r.doc_id, r.section_prefix) for r in found.collect()}
    assert got == {(f"q{i}", "summary" if i == 2 else "qa", f"ref q{i}", f"feedback:{2 * i + 1}", "", "") for i in (2, 3, 4, 5)}
    assert files.append_cases(found, str(tmp_path / "cases")) == 4
    assert {(r.question, r.reference) for r in files.load_cases(spark, str(tmp_path / "cases")).collect()} == {(q, ref) for q, _, ref, *_ in got}


def test_registered_queries_have_sql_and_tables():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {n for n in queries if n not in sql and not n.startswith(("op", "pipeline"))} == {"g3_html_blocks", "g5_chunk_documents", "ingest_documents", "ingest_outcomes"}
