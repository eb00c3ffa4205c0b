"""The stored inverted index and the segmenter against full scoring and brute force."""

from __future__ import annotations

import math
import random
import re
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieve, segment, sparse_index

CHUNK = "doc_id long, chunk_index int, chunk_id long, department string, content string"


def corpus(rng, docs, words=60):
    """Chunks with frequent and rare words; some empty, some null, some alike."""
    rows = []
    for d in docs:
        for i in range(rng.choice([1, 1, 2, 7])):
            text = rng.choice([None, "", "..."]) if rng.random() < 0.05 else " ".join(f"w{min(int(rng.expovariate(0.15)), words)}" for _ in range(rng.choice([1, 5, 30])))
            rows.append((d, i, d * 1000 + i, rng.choice(["a", "b", None]), text))
    return rows


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("turn", [2_048, 3])
def test_index_gives_the_rows_of_a_full_search_also_after_updates(spark, tmp_path, monkeypatch, turn):
    for name, value in (("BLOCK", 4), ("RUN", 3), ("TURN", turn), ("LISTED", 20)):
        monkeypatch.setattr(sparse_index, name, value)
    rng, path = random.Random(turn), str(tmp_path / "index")
    queries = spark.createDataFrame([(i, " ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.choice([1, 2, 12])))) for i in range(12)] + [(98, ""), (99, "unheard"), (100, None)], "query_id long, text string")
    scope = spark.createDataFrame([(i, i % 3 == 0, None if i % 3 == 0 else "ab"[i % 2]) for i in range(10)], "query_id long, unrestricted boolean, department string")
    before = spark.createDataFrame(corpus(rng, range(60)), CHUNK)
    shards = sparse_index.write_index(before, path, shards=7)
    index = lambda: sparse_index.read_index(spark, path)
    assert hits(sparse_index.search_index(index(), queries, 5)) == hits(retrieve.bm25_topk(before, queries, 5))

    def stamps():
        return {p.name: {f.name for f in p.iterdir()} for p in (tmp_path / "index").glob("shard=*")}

    changed = [3, 7, 200, 201]  # one is replaced, one goes, two come
    rows = [r for r in before.collect() if r.doc_id not in changed]
    after = spark.createDataFrame([*map(tuple, rows), *corpus(rng, [3, 200]), (201, 0, 201_000, "a", "w1 w2 w2 w999")], CHUNK)
    old = stamps()
    touched = sparse_index.update_index(path, before, after, spark.createDataFrame([(d,) for d in changed], "doc_id long"), shards)
    new = stamps()
    assert 0 < len(touched) < shards and {f"shard={s}" for s in touched} == {s for s in new if old.get(s) != new[s]}
    assert hits(sparse_index.search_index(index(), queries, 5)) == hits(retrieve.bm25_topk(after, queries, 5))
    assert hits(sparse_index.search_index(index(), queries, 5, scope=scope)) == hits(retrieve.bm25_topk(after, queries, 5, scope=scope))
    known = lambda df: {(r.term, r.df, r.n_chunks, round(r.avg_length, 9)) for r in df.collect()}
    assert known(sparse_index.term_stats(index())) == known(retrieve.term_stats(after))
    # all documents go: no rows, and no failure
    none = after.limit(0)
    sparse_index.update_index(path, after, none, after.select("doc_id"), shards)
    assert hits(sparse_index.search_index(index(), queries, 5)) == []
    assert sparse_index.update_index(path, none, none, after.select("doc_id"), shards) == []


def test_pruned_scoring_is_full_scoring_and_skips_blocks(spark):
    rng = random.Random(5)
    rows = []
    for i in range(6_000):  # neighbours speak of the same
        theme = i // 300
        rows.append((i, 0, i, "a", " ".join([f"t{theme}"] * rng.choice([0, 1, 6]) + [f"w{int(rng.expovariate(0.2))}" for _ in range(rng.choice([8, 30]))])))
    chunks = spark.createDataFrame(rows, CHUNK)
    index = sparse_index.index_rows(chunks, 1).toPandas()
    shard = sparse_index.Shard(index, 20.0, 1.2, 0.75)
    full = sparse_index.Shard(index.assign(), 20.0, 1.2, 0.75)
    full.bound = np.full(len(full.bound), 1e9)  # nothing is ever below
    saved = 0
    for q in range(20):
        asked = [(f"t{q}", 4.0), ("w1", 0.3), ("w0", 0.2), ("absent", 9.0)]
        seen = None if q % 2 else np.arange(6_000) % 3 == 0
        ids, scores, met = shard.best(asked, 10, seen)
        all_ids, all_scores, all_met = full.best(asked, 10, seen)
        assert ids.tolist() == all_ids.tolist() and scores.tolist() == all_scores.tolist()
        saved += all_met - met
    assert saved > 0.5 * 20 * shard.blocks


def test_bounds_hold_for_any_average_length(spark):
    chunks = spark.createDataFrame(corpus(random.Random(1), range(300)), CHUNK)
    index = sparse_index.index_rows(chunks, 2).toPandas()
    for average in (1.0, 10.0, 500.0):
        for number in (0, 1):
            shard = sparse_index.Shard(index[index["shard"] == number], average, 1.2, 0.75)
            for run in range(len(shard.low)):
                own = shard.part[shard.low[run] : shard.low[run] + shard.size[run]]
                assert math.isclose(own.max(), shard.bound[run])


def test_cheapest_path_matches_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        run = "".join(rng.choice("一丁七") for _ in range(rng.randint(1, 9)))
        words = {"".join(p): rng.randint(1, 6) for n in (1, 2, 3, 4) for p in product("一丁七", repeat=n) if rng.random() < 0.3}
        arcs = [(i + 1, run[i : i + n], words[run[i : i + n]]) for i in range(len(run)) for n in range(1, 5) if run[i : i + n] in words and i + n <= len(run)]
        ways = []

        def walk(at, path, run=run, words=words, ways=ways):
            if at == len(run):
                ways.append((sum(words.get(w, 9) for w in path), [-len(w) for w in path], path))
                return
            for n in range(1, min(4, len(run) - at) + 1):
                if run[at : at + n] in words or n == 1:
                    walk(at + n, [*path, run[at : at + n]])

        walk(0, [])
        assert segment.cheapest(run, arcs, 9) == min(ways)[2]


def test_texts_are_cut_into_words(spark):
    texts = ["机器学习是人工智能", "学习机器", "人工智能 and MACHINE learning", "plain Words", None, "", "人", "我们学习机器学习", "奇" * 3000 + "机器"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string").withColumn("word", F.lit("clash")).withColumn("run", F.lit("clash"))
    words = spark.createDataFrame([("机器", 9), ("学习", 9), ("机器学习", 5), ("人工智能", 4), ("是", 9), ("我们", 7), ("机", 1), ("人", 3)], "word string, n long")
    got = {r.chunk_id: r.t for r in segment.analyser(words)(df, "chunk_id", "content").collect()}
    assert got[0] == ["机器学习", "是", "人工智能"] and got[1] == ["学习", "机器"] and got[3] == ["plain", "words"]
    assert sorted(got[2]) == ["and", "learning", "machine", "人工智能"] and got[6] == ["人"] and sorted(got[7]) == ["学习", "我们", "机器学习"]
    assert got[4] in (None, []) and got[5] == [] and got[8] == ["奇"] * 3000 + ["机器"]
    chunks = df.select("chunk_id", F.col("chunk_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "content")
    rows = sparse_index.index_rows(chunks, 2, segment.analyser(words)).filter("term = '机器学习'").collect()
    assert sum(r.df for r in rows) == 2


def test_dictionary_matches_brute_force(spark):
    rng = random.Random(8)
    parts = ["学习", "机器", "人工智能", "的", "是", "我"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) + rng.choice(["", " x ", "。"]) for _ in range(80)] + [None, "abc"]
    counts = {}
    for text in texts:
        for run in re.findall("[一-鿿]+", text or ""):
            for i in range(len(run)):
                for n in range(1, 5):
                    if i + n <= len(run):
                        counts[run[i : i + n]] = counts.get(run[i : i + n], 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) == 1 or n >= 2}
    letters = sum(n for w, n in counts.items() if len(w) == 1)
    kept = {w: n for w, n in counts.items() if all(n * letters >= 4 * counts[w[:i]] * counts[w[i:]] for i in range(1, len(w)))}
    got = segment.dictionary(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert {r.word: r.n for r in got} == kept and {"学习", "机器", "人工智能"} <= set(kept)
    assert segment.dictionary(spark.createDataFrame([], "text string"), "text").count() == 0


def test_empty_index(spark, tmp_path):
    chunks = spark.createDataFrame([], CHUNK)
    assert isinstance(sparse_index.index_rows(chunks, 3).toPandas(), pd.DataFrame)
    path = str(tmp_path / "index")
    one = spark.createDataFrame([(1, 0, 1, None, "only this")], CHUNK)
    sparse_index.write_index(one, path)
    queries = spark.createDataFrame([("q", "this")], "query_id string, text string")
    assert [(r.query_id, r.chunk_id) for r in sparse_index.search_index(sparse_index.read_index(spark, path), queries).collect()] == [("q", 1)]
    assert sparse_index.search_index(sparse_index.read_index(spark, path), queries.limit(0)).count() == 0


def test_tokens_as_one_text_are_the_tokens(spark):
    texts = ["One, two_2  THREE", " , ", "", None, "--a--", "\0a\0\0b\0", "\u00c9t\u00e9 \u0130x \u0661\u0662", "\U00010400 \U0001f600x", "\u673a\u5668 and \u4eba", "a\nb\tc"]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    rows = df.select(F.array_join(retrieve.tokens(F.col("content")), "\0").alias("a"), retrieve.joined_tokens(F.col("content"), "\0").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[0].b == "one\0two_2\0three"


def test_update_reads_chunks_once_to_find_shards(spark, tmp_path):
    """Postings are whole columns; a shard that loses all its chunks is written too, and one without changes isn't."""
    chunks = spark.createDataFrame([(i, 0, i, None, f"w{i} w{i} all") for i in range(30)], CHUNK)
    assert sparse_index.index_rows(chunks, 2).schema["docs"].dataType.simpleString() == "binary"
    path = str(tmp_path / "index")
    shards = sparse_index.write_index(chunks, path, shards=20)
    place = {r[0]: r[1] for r in chunks.select("doc_id", sparse_index.shard_of(F.col("doc_id"), F.col("chunk_index"), shards)).collect()}
    lost = [d for d in place if place[d] == place[0]]
    after = chunks.filter(~F.col("doc_id").isin(lost))
    assert sparse_index.update_index(path, chunks, after, spark.createDataFrame([(d,) for d in [*lost, *lost, 999]], "doc_id long"), shards) == [place[0]]
    stats = {r.term: r.df for r in sparse_index.term_stats(sparse_index.read_index(spark, path)).collect()}
    assert stats == {"all": 30 - len(lost)} | {f"w{d}": 1 for d in place if d not in lost}
