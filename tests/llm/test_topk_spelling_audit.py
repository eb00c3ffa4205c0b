"""Exact search, spelling variants and the filter audit against brute force on small tables."""

from __future__ import annotations

import binascii
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import audit, blockmax, spelling

# ---- exact search


def brute(rows, k, query=lambda i: i % 100 == 0):
    """By query: (vec_id, score) by whole numbers."""
    good = [(i, [math.floor(x * 1024) if abs(x) < 2**53 else int(x) * 1024 for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in sorted({i for i, _ in good if query(i)}):
        mine = min(([x for x in v] for i, v in rows if i == q and (i, v) is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)))
        mine = [math.floor(x * 1024) if abs(x) < 2**53 else int(x) * 1024 for x in mine]
        found = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in good if i != q)[:k]
        if found:
            out[q] = [(i, -s) for s, i in found]
    return out


def searched(df, k=10, **more):
    got = {}
    for r in blockmax.search(df, lambda v: v % 100 == 0, k, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


@pytest.mark.parametrize(("block", "span", "turn"), [(256, 16_384, 8_192), (7, 50, 2)])
def test_topk_matches_brute_force(spark, monkeypatch, block, span, turn):
    for name, value in (("BLOCK", block), ("RANGE", span), ("TURN", turn)):
        monkeypatch.setattr(blockmax, name, value)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 6)), 1)  # many ties
    x[50:180] = x[50]  # a third are copies
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(500, None), (600, [float("nan")] * 6), (601, [1.0, None] + [1.0] * 4), (602, [float("inf")] * 6), (None, [9.0] * 6), (700, [0.0] * 6), (800, []), (801, [3.0]), (900, [0.5] * 9), (-100, [-1.0] * 6), (100, [float(c) for c in x[100]]), (3, [float(c) for c in x[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("range", F.lit(1)).repartition(5)
    assert searched(df) == brute(rows, 10)


def test_topk_of_little_and_of_large_numbers(spark, monkeypatch):
    schema = "vec_id long, embedding array<double>"
    assert searched(spark.createDataFrame([], schema)) == {}
    assert searched(spark.createDataFrame([(0, [1.0, 2.0])], schema)) == {}
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    assert searched(spark.createDataFrame(few, schema)) == brute(few, 10)
    monkeypatch.setattr(blockmax, "RANGE", 4)
    # sums that doubles don't hold, and scores beyond 64 bits: the order is that of the whole numbers
    large = [(i, [1e9 * (i % 7) + i, -1e9, 3.0]) for i in range(0, 30)] + [(100, [2.0**40 + 1, 2.0**40, 1.0]), (200, [1e200, -1e200, 1.0]), (201, [1e300, 1.0, 1.0]), (202, [1e299, 1.0, 1.0])]
    got, wanted, top = searched(spark.createDataFrame(large, schema)), brute(large, 10), 2**63 - 1
    assert got == {q: [(i, min(max(s, -top - 1), top)) for i, s in found] for q, found in wanted.items()}
    assert max(s for found in wanted.values() for _, s in found) > top
    for n in (0, 1, -1, 9, -9, 10, -10, 99, -100, 10**400, -(10**401)):
        assert blockmax.number_of(blockmax.sortable(n)) == n
    numbers = [random.Random(1).randint(-(10**k), 10**k) for k in range(30)]
    assert sorted(numbers) == sorted(numbers, key=blockmax.sortable)


def test_blocks_are_pruned_and_nothing_is_lost():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8)) * 50
    x = np.floor(np.vstack([c + rng.normal(size=(40, 8)) for c in centres]))
    ids = np.arange(len(x))
    blocks = [blockmax.Block(ids[at : at + 20], x[at : at + 20]) for at in range(0, len(x), 20)]
    q = x[::100]
    top = blockmax.Top(ids[::100], 10, np.full(len(q), -np.inf), np.full(len(q), np.iinfo(np.int64).max))
    met = blockmax.through(top, q, blocks)
    assert met < 0.2 * len(q) * len(blocks)  # near ones stand together, so bounds of most blocks are below the k-th score
    for n, found in enumerate(top.found):
        score = x @ q[n]
        order = [i for i in np.lexsort((ids, -score)) if i != n * 100][:10]
        assert [(i, -s) for s, i in found] == [(i, score[i]) for i in order]
    for b in blocks:
        assert (blockmax.bound_of(q, b.high, b.low) >= (q @ b.x.T).max(axis=1)).all()


# ---- spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_brute_force(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


@pytest.mark.parametrize("crowd", [0, 3, 50])
def test_variants_match_brute_force(spark, crowd):
    rng = random.Random(crowd)
    counts = {}
    for _ in range(60):
        word = "".join(rng.choice("abàÿ") for _ in range(rng.randint(7, 10)))
        counts[word] = rng.choice([2, 5, 30, 400, 9000])
        for _ in range(6):  # edits of edits, at the ends and in the middle
            at, letter = rng.choice([0, 1, len(word) // 2 - 1, len(word) // 2, len(word) // 2 + 1, len(word) - 1, len(word)]), rng.choice("abàÿ")
            word = rng.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]])
            counts[word] = rng.choice([2, 5, 30, 400, 9000])
    counts = {w: n for w, n in counts.items() if len(w) >= 7} | {"x" * n: 2 * 10 ** (n - 7) for n in range(7, 16)}  # a chain of forms
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = spelling.variants(words, crowd=crowd).collect()
    wanted = variants_by_brute_force(counts)
    assert len(rows) == len(wanted)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == wanted
    assert wanted["x" * 7][1] == "x" * 15
    pairs = [(r.x, r.y) for r in spelling.near_pairs(words, crowd).collect()]  # each pair once
    assert len(pairs) == len({frozenset(p) for p in pairs}) == sum(w[3] for w in wanted.values()) / 2


def test_a_crowded_half_makes_no_pairs_of_all(spark):
    """Words of one half whose rests are far apart never meet."""
    rng = random.Random(9)
    counts = {"gemein" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)): 2 for _ in range(600)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    cut, other = spelling.chunks(words), spelling.grams(words)
    assert cut.join(other, "key").count() > 300_000
    assert spelling._refined(cut, other).count() < 10_000
    got = {r.word: r.n_near for r in spelling.variants(words).collect()}
    assert got == {w: v[3] for w, v in variants_by_brute_force(counts).items()}


def test_vocabulary_matches_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Straßenbahn", "STRASSEN", "L'Été", "électricité", "×÷×÷×÷×", "abcdefg", "ABCDEFG", "short", "naïvement", "x" * 40, "ab_cdefghi"]) for _ in range(30)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "Abcdefgh abcdefgh"), (7, texts[7]), (50, None), (51, ""), (52, "1234567 ..."), (53, "langeswort " * 20_000)]
    counts = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = binascii.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                counts[word] = counts.get(word, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == counts
    got = spelling.variants(spelling.vocabulary(df)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == variants_by_brute_force(counts)


def test_spelling_of_nothing(spark):
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


# ---- filter audit


def audit_by_brute_force(docs, labels):
    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}

    noted = [(part or "", fails(i, t or ""), any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and x == 1 for j, _, x in labels if i is not None)) for i, t, part in docs]
    out, shapley = {}, {}
    for part in {p for p, *_ in noted}:
        for order in permutations("ABCDE"):
            here = [(f, g, t) for p, f, g, t in noted if p == part]
            for step, letter in enumerate(order, 1):
                removed = [x for x in here if x[0][letter]]
                failing = [f for p, f, *_ in noted if p == part and f[letter]]
                here = [x for x in here if not x[0][letter]]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(removed)
                out[part, "".join(order), step] = (len(here), len(removed), len(failing) - len(removed), sum(sum(f.values()) == 1 for f in failing), sum(g for _, g, _ in removed), sum(t for *_, t in removed))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(3)
    rows = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("clash"))).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("groups", [0, 4096])
def test_audit_matches_brute_force(spark, monkeypatch, groups):
    monkeypatch.setattr(audit, "GROUPS", groups)
    rng = random.Random(2)
    texts = [" ".join(rng.choice([f"w{i}", f"w{i % 9}", "Big", "#", "$x", "UPPER"]) if rng.random() < p else f"v{i}" for i in range(rng.choice([0, 3, 199, 200, 260]))) for p in (0, 0.02, 0.3, 0.9) for _ in range(12)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(None, texts[3], "en"), (None, None, "fr"), (4, docs[4][1], "de"), (4, docs[4][1], "en"), (5, "other text", "en"), (999, None, None), (-1, "", "de"), (1000, "Wort\x85wort " * 90_000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5000, 1, 1)]
    assert audited(spark, docs, labels) == audit_by_brute_force(docs, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    assert len(audited(spark, [(1, "text", "en")], [])) == 600


def test_carry_save_counters_count():
    rng = np.random.default_rng(3)
    counter, total = audit.CarrySave(), np.zeros(32, dtype=np.int64)
    for n in (0, 1, 2, 3, 5, 1000, 0, 70_001):
        words = rng.integers(0, 1 << 32, size=n, dtype=np.uint32)
        counter.add(words)
        total += ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0).astype(np.int64)
        assert (counter.counts() == total).all()
        assert all(len(w) <= 2 for w in counter.levels)
    assert audit.survival_word(0) == (1 << 32) - 1
    for failed in range(32):
        assert {s for s in range(32) if audit.survival_word(failed) >> s & 1} == {s for s in range(32) if not s & failed}
