"""Long word lists and term maps against the rules applied word by word."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from quarry.functions import automaton, redaction, text
from pyspark.sql import functions as F

from quarry.operators import evaluate, retrieve


def in_turn(value, words, mark):
    hit = set()
    for i, w in enumerate(words):
        if w and w in value:
            value, hit = value.replace(w, mark), hit | {i}
    return value, hit


@pytest.mark.parametrize("mark", ["##", "*", "", "ab", "aXb", "****"])
@pytest.mark.parametrize("letters", ["ab", "ab*#X", "abcdefghij"])
def test_masker_is_the_chain_of_replacements(mark, letters):
    rng = random.Random(len(letters) + len(mark))
    for _ in range(400):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 12))]
        value = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        new, hit = automaton.Masker(words, mark).mask(value)
        wanted, numbers = in_turn(value, words, mark)
        assert new == wanted and {words[i] for i in hit} == {words[i] for i in numbers}


@pytest.mark.parametrize("letters", ["ab", "abé一 "])
def test_distinct_pieces_are_masked_once(letters, monkeypatch):
    monkeypatch.setattr(automaton, "REMEMBERED", 300)
    rng = random.Random(len(letters))
    words = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(9)))
    masker, of = automaton.Masker(words, "##"), np.arange(9) % 3
    assert not masker.made
    for _ in range(50):
        texts = [None, "", "."] + ["".join(rng.choice(letters + " .,x") for _ in range(rng.randint(0, 30))) for _ in range(20)]
        new, hits = masker.mask_all(pa.array([*texts, "cut off"], pa.string())[:-1], of[: len(words)])
        wanted = [(None, set()) if v is None else in_turn(v, words, "##") for v in texts]
        assert new.to_pylist() == [v for v, _ in wanted] and hits == [sorted({int(of[i]) for i in hit}) for _, hit in wanted]
    made = []
    masker.masks = automaton.Masks(lambda piece: made.append(piece) or (piece, set()))
    masker.mask_all(pa.array(["abba.x" * 5_000, "abba-bbbb"]), of)
    assert sorted(made) == sorted(set(made)) and len(made) <= 4


def test_rules_are_looked_for_only_where_they_may_be(spark):
    """A rule's needed text is in all its matches."""
    rows = [(i, t) for i, t in enumerate(["a@b.com", "ak-12345678 sk-abcdefgh", "k- @ 13812345678", "none", "", None, "pk-short 1.2.3.4 x@y.zz"])]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    bare = [r._replace(holds="") for r in redaction.DEFAULT_RULES]
    run = lambda rules: sorted(map(str, redaction.redacted(df, rules=tuple(rules)).collect()))
    assert run(redaction.DEFAULT_RULES) == run(bare) and {r.name: r.holds for r in redaction.DEFAULT_RULES if r.holds} == {"email": "@", "api_key": "k-"}
    plan = redaction.redacted(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and "@" in plan


def test_twenty_thousand_words_in_one_pass():
    rng = random.Random(1)
    words = list(dict.fromkeys("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(20_000)))
    texts = [" ".join(rng.choice(words) if rng.random() < 0.3 else "".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(200)) for _ in range(20)]
    masker = automaton.Masker(words, "****")
    assert not masker.made
    began = time.time()
    got = [masker.mask(t) for t in texts]
    once = time.time() - began
    began = time.time()
    assert got == [in_turn(t, words, "****") for t in texts]
    assert once < time.time() - began


def test_rules_with_long_lists_are_those_with_short_ones(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice([*words, "13812345678", "a@b.com", "x", "**", "w1**"]) for _ in range(20))) for i in range(40)] + [(100, None), (101, ""), (102, "w1 " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("state", F.lit("clash"))
    rules = (*redaction.DEFAULT_RULES[:4], redaction.Words("first", tuple(words[:3])), redaction.Words("second", (*words[3:6], "**", "w1")), redaction.Pattern("x", "x+", 0, 0), redaction.Words("third", ("*",)))
    run = lambda: {r.doc_id: (r.masked, r.hits) for r in redaction.redacted(df, rules=rules, replace_with="**").collect()}
    short = run()
    monkeypatch.setattr(redaction, "NATIVE_WORDS", 0)
    assert run() == short and short[100] == (None, []) and short[101] == ("", []) and short[102][1] == ["first", "second", "third"]


def test_term_maps_of_any_size(spark):
    rng = random.Random(3)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): "".join(rng.choice("abcX") for _ in range(rng.randint(1, 4))) for _ in range(90)} | {"": "x", " d ": " D ", "e": ""}
    assert len(terms) > text.NATIVE_WORDS
    queries = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12))) for _ in range(100)] + [None, ""]
    few = dict(list(terms.items())[:6])
    df = spark.createDataFrame([(q,) for q in queries], "q string")
    for some in (terms, few):
        wanted = []
        for q in queries:
            new = q or ""
            for alias, standard in sorted(((a.strip(), s.strip()) for a, s in some.items() if a and s), key=lambda x: -len(x[0])):
                if alias in (q or ""):
                    new = new.replace(alias, standard)
            wanted.append([new] if q and new != q else [])
        assert [r.v for r in df.select(text.expand_terms(F.col("q"), some).alias("v")).collect()] == wanted


def test_texts_held_by_documents_are_those_of_contains(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_SCAN", 3)
    docs = spark.createDataFrame([(1, "abcab \u4e00\u4e8c"), (2, "bc"), (3, ""), (4, None), (5, "ABC")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "abc"), (11, "bc"), (12, "bc"), (13, ""), (14, None), (15, "\u4e00"), (16, "zz"), (17, "cab")], "item_id int, text string")
    want = docs.alias("d").join(asked.alias("q"), F.expr("contains(d.text, q.text)")).select("doc_id", "item_id")
    got = retrieve.contained(docs, asked, "doc_id", "item_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema == want.schema


def test_hit_rank_reads_cases_once(spark):
    """A case that is listed twice is met once and given twice; one without id or hits stays."""
    cases = spark.createDataFrame([(1, "a", ""), (1, "a", ""), (1, "b", "s"), (2, "a", None), (None, "a", "")], "case_id int, doc_id string, section_prefix string")
    hits = spark.createDataFrame([(1, "b", "x", 1), (1, "b", "s > t", 2), (1, "a", None, 3), (2, "c", "", 1)], "query_id int, doc_id string, section_path string, rank int")
    found = evaluate.hit_rank(cases.filter("case_id is null or case_id < 9"), hits)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(["(1, 2)"] * 3 + ["(2, None)", "(None, None)"])
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_audit_works_masks_out_once(spark):
    docs = spark.createDataFrame([(1, "a@b.com 13812345678"), (2, "none"), (3, None), (1, "10.0.0.1")], "doc_id long, text string")
    rules = redaction.audit(redaction.redacted(docs))
    assert {r.doc_id: r.rules for r in rules.collect()} == {1: "email,ipv4,phone"}
    plan = rules._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and not [x for x in plan.split("\n") if "Filter" in x and "regexp_extract_all" in x]
