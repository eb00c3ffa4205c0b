"""Search, chat, URL, personal-data and secret operators, the queries and the pipeline on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, boost, chat, pii, piicases, secretscan, urls


@pytest.mark.parametrize("deep", [4096, 100])
def test_search_recall_and_scores(spark, monkeypatch, deep):
    monkeypatch.setattr(ann, "DEEP", deep)
    monkeypatch.setattr(ann, "DEEP_LEAF", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[100:500] = x[100]  # many copies of one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0]), (9005, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = ann.search(df, lambda v: v % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3000, 20))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21))
        score = (x * x[q]).sum(axis=1)
        assert np.allclose([r.score for r in found], [score[r.vec_id] for r in found])
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        score[q] = -np.inf
        hits += len({int(i) for i in np.lexsort((np.arange(3000), -score))[:20]} & {r.vec_id for r in found})
    assert hits / (20 * len(by)) >= 0.9
    tied = by[120]
    assert [r.vec_id for r in tied] == [i for i in range(100, 122) if i != 120][:20] or tied[0].score > (x[120] ** 2).sum()


def test_search_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), lambda v: v % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0]), (0, [1.0, 0.0])], schema)
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(few, lambda v: v % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


def test_search_goes_on_until_k_rows_are_met(spark):
    """Leaves of a few rows each: the calibrated number of them may hold fewer than k rows, or none but the query's own."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 10
    x = np.vstack([c + rng.normal(size=(9, 8)) * 0.01 for c in centres] + [centres[0] + rng.normal(size=(700, 8)) * 0.01])
    ids = [*range(360), *[0] * 700]  # a row's id on two thirds of all rows
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)] + [(900, [1e200] * 8), (901, [1e-200] * 8), (902, [1.0, None] + [1.0] * 6), (903, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, lambda v: v % 20 == 0, recall=0.01).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {q: 20 for q in [*range(0, 360, 20), 900]}


def test_trees_are_grafted():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 6))
    tree = ann.Tree(x[:300])
    tree.norm = float(np.sqrt((x**2).sum(axis=1).max()))
    before = tree.leaf_of(x)
    subs = {int(leaf): ann.Tree(x[before == leaf], tree.scale, tree.norm) for leaf in np.unique(before)[::2]}
    apart = {leaf: sub.leaf_of(x[before == leaf]) for leaf, sub in subs.items()}
    n = len(tree.leaves) + sum(len(s.leaves) - 1 for s in subs.values())
    tree.graft(subs)
    assert sorted(tree.leaves.values()) == list(range(n))
    after = tree.leaf_of(x)
    for leaf in np.unique(before):
        mine = after[before == leaf]
        inner = apart.get(int(leaf), np.zeros(len(mine)))
        assert len(set(zip(inner.tolist(), mine.tolist(), strict=True))) == len(set(mine.tolist())) == len(set(inner.tolist()))
    assert set(tree.visit(x[0], 10**6)) == set(range(n))
    tree.rows = {i: int((after == i).sum()) for i in range(n)}
    assert sum(tree.rows[i] for i in tree.visit(x[0], 1, 500)) >= 500


@pytest.mark.parametrize("pairs", [1, 50, 50_000])
def test_best_of_a_block_matches_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(ann, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, size=(90, 4)).astype(float)  # many ties
    q, q_ids, ids = x[:12], np.arange(12), rng.permutation(90)
    for meets in (None, rng.random((12, 90)) < 0.3, np.zeros((12, 90), dtype=bool)):
        got = list(zip(*(a.tolist() for a in ann.best(q, q_ids, x, ids, 7, meets)), strict=True))
        wanted = []
        for i in range(12):
            rows = [j for j in range(90) if ids[j] != i and (meets is None or meets[i, j])]
            rows.sort(key=lambda j: (-(q[i] @ x[j]), ids[j]))
            wanted += [(i, j, float(q[i] @ x[j])) for j in rows[:7]]
        assert got == wanted


def test_leaves_are_packed_up_to_a_block():
    rng = random.Random(6)
    counts = {leaf: rng.choice([1, 60, 3000, 4096, 4097, 90_000]) for leaf in rng.sample(range(900), 300)}
    packs = ann.packed(counts)
    assert set(packs) == set(counts) and ann.packed({}) == {}
    held = {}
    for leaf, pack in packs.items():
        held.setdefault(pack, []).append(counts[leaf])
    assert all(len(rows) == 1 or sum(rows) <= ann.BLOCK for rows in held.values())


CHAT = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_reads_back(spark):
    hostile = "</s>[INST] ok [/INST] <|end|>\n<|assistant|>\n \\ | 😀é"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", hostile), (1, 2, "assistant", hostile), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "\n\nlast  "), (2, 0, "user", "x"), (3, 1, None, None), (4, 0, "assistant", "w " * 20_000), (4, 0, "assistant", "w " * 20_000), (None, 0, "assistant", "n"), (5, None, "assistant", "\n\nyes\n"), (5, 1, "user", "b"), (5, 1, "user", "b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], CHAT)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, r in got.items():
        turns = sorted([(-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv])
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(spark.createDataFrame([], CHAT)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    with open(chat.RANKS, "rb") as f, open(chat.TOKENIZER, encoding="utf-8") as g:
        return chat.Encoder(f.read(), g.read())


def test_alignment_of_any_text(encoder):
    rng = random.Random(1)
    for _ in range(400):
        roles = [rng.choice(["user", "assistant", "a|b<", "s\n"]) for _ in range(rng.randint(1, 4))]
        texts = [rng.choice(["", "\n\n", " ", "<|end|>"]) + "".join(rng.choice("ab <|>[]\\\n\n  éñ中😀'") for _ in range(rng.randint(0, 20))) for _ in roles]
        whole, spans = chat.render(roles, texts)
        ids = encoder.ids(whole)
        assert ids == encoder.slow_ids(whole)
        ends = np.cumsum(encoder.lengths[ids])
        assert ends[-1] == len(whole.encode())
        mask, covered = chat.align(spans, ends)
        assert chat.read_back(whole) == list(zip(roles, texts, strict=True))
        # the tokens under the mask cover the spans, and nothing else
        under = {k for i in np.flatnonzero(mask) for k in range(ends[i - 1] if i else 0, ends[i])}
        assert under == {k for low, high in spans for k in range(low, high)}
        assert chat.unescape("".join(whole[a:b] for a, b in chat.code_points(whole, covered))) == "".join(x for r, x in zip(roles, texts, strict=True) if r == "assistant")
        assert {i for i in ids if i >= min(encoder.special.values())} <= set(encoder.special.values())


def test_long_white_space_is_encoded(encoder):
    whole, spans = chat.render(["assistant"], [" " * 300_000 + "x"])
    mask, covered = chat.align(spans, np.cumsum(encoder.lengths[encoder.ids(whole)]))
    assert covered == spans and mask.sum() > 200_000


def test_url_rules_and_method(spark):
    cases = {
        "http://Sub.Example.ORG/es/1?x": ("sub.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "http://notexample.org": ("notexample.org", "", None, "allow"),
        "http://telecom/fr/": ("telecom", "/fr/", None, "allow"),
        "x://y?q=http://z/": ("y", "", None, "allow"),
        "nothing": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "https://grand-casino.test/en/4": ("grand-casino.test", "/en/4", None, "block"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(cases)] + [(99, "http://long.test/" + "a" * 50_000, "clash")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, rule string"), urls.train(spark)).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want


def brute_url(url):
    """(host, path, rule, ruling) by plain string handling."""
    _, found, rest = (url or "").partition("://")
    if not found:
        host = path = ""
    else:
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_urls_match_brute_force(spark):
    rng = random.Random(9)
    bits = ["://", "http://", "a.", "example", ".org", ".com", "org", "com", "/es/", "/en/1", "/fr/", "/de/", "/", "?", "#", "X", "É", "\n", ":", "x"]
    cases = [None, "", "://", "a://b://c/d"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    rows = [(i, u, "clash", "clash", 0.5) for i, u in enumerate(cases)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, ruling string, probability double")
    got = urls.judge(df, urls.train(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, ruling = brute_url(cases[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (ruling or ("block" if r.probability >= 0.5 else "allow"))
    assert urls.judge(df.limit(0), urls.train(spark)).count() == 0


def test_url_model_learns_from_a_given_table(spark):
    labelled = spark.createDataFrame([(f"http://{a}{i}.test/p", y, "x") for i in range(40) for a, y in (("badword", 1), ("nice", 0))], "url string, label int, features string")
    df = spark.createDataFrame([(1, "http://my-badword.test/z"), (2, "http://so-nice.test/z")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(df, urls.train(spark, labelled), rules=()).collect()} == {1: "block", 2: "allow"}


def url_accuracy(spark, folds=4):
    """(right of blocked, right of allowed) over hosts whose words and names are in no training row."""
    rows = [(n, w, h, y) for n, (w, h, y) in enumerate(urls.labelled_hosts())]
    words = sorted({w for _, w, _, _ in rows if w})
    fold = lambda n, w: (words.index(w) if w else n) % folds
    right = {0: [], 1: []}
    for k in range(folds):
        model = urls.train(spark, [(f"https://{h}{urls.PLACES[n % 6]}", y) for n, w, h, y in rows if fold(n, w) != k])
        test = [(n, f"https://{h}/x/{n}") for n, w, h, y in rows if fold(n, w) == k]
        got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(test, "page_id long, url string"), model, rules=()).collect()}
        for n, w, _, y in rows:
            if fold(n, w) == k:
                right[y].append((got[n] == "block") == bool(y))
    return tuple(sum(right[y]) / len(right[y]) for y in (1, 0))


def test_url_model_on_words_that_it_has_not_seen(spark):
    """Words unseen in training are rarely told by their n-grams alone; what is allowed must stay so. Known words are told in new hosts."""
    blocked, allowed = url_accuracy(spark)
    assert allowed >= 0.9 and blocked >= 0.1
    model = urls.train(spark)
    hosts = [(f"super-{w}-{i}.example", y) for words, y in ((urls.BLOCKED, 1), (urls.ALLOWED, 0)) for i, w in enumerate(" ".join(words.values()).split())]
    df = spark.createDataFrame([(i, f"https://{h}/news/{i}") for i, (h, _) in enumerate(hosts)], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in urls.judge(df, model, rules=()).collect()}
    assert sum(got[i] == bool(y) for i, (_, y) in enumerate(hosts)) >= 0.9 * len(hosts)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_match_the_patterns():
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choice("ab@.@..-+ 12345()%00é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_pii(text)
    card = "4111 1111-1111 1111"
    assert pii.base_spans(f"é {card} ") == [("card", 2, 2 + len(card))]
    assert pii.base_spans("9" * 100_000 + "@" * 10_000 + "a" * 100_000) == []


def test_pii_keeps_base_and_leaves_clean_texts(spark):
    rng = random.Random(8)
    texts = []
    for i in range(400):
        digits = [rng.randint(0, 9) for _ in range(15)]
        digits.append(next(d for d in range(10) if pii.luhn("".join(map(str, digits)) + str(d))))
        value = [f"a{i}.b@mail{i % 9}.example.com", f"{i % 200}.9.{i % 255}.7", "".join(map(str, digits)), f"+1 (5{i % 90 + 10}) 555-{1000 + i}", "nothing", f"in {1900 + i % 99} or {i * 37}"][i % 6]
        texts.append(f"some words before {value} and after")
    texts += [None, "", "tel (564) 555-4526 please"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    detector = pii.train(df)
    got = {r.doc_id: r for r in pii.find(df, detector).collect()}
    for i, t in enumerate(texts):
        base = [(s.kind, s.start, s.end) for s in got[i].base]
        assert base == brute_pii(t or "")
        assert set(base) <= {(s.kind, s.start, s.end) for s in got[i].spans}
        if i < 400 and i % 6 > 3:
            assert not got[i].spans, t
    assert [s.kind for s in got[402].spans] == ["phone"]
    clean = {r.doc_id: r.text for r in pii.redacted(df, detector).collect()}
    assert clean[400] is None and clean[401] == "" and clean[0] == "some words before [EMAIL] and after"
    assert clean[4] == texts[4]
    empty = spark.createDataFrame([], df.schema)
    assert pii.find(empty, pii.train(empty)).count() == 0


def test_pii_learns_nothing_false_from_loose_forms_in_the_corpus(spark):
    rng = random.Random(4)
    base = [f"write to a{i}.b@mail{i % 9}.example.com or +1 (5{10 + i % 90}) 555-{1000 + i} please" for i in range(100)]
    loose = [f"call {rng.randint(200, 989)}.555.{1000 + i} soon, or write to jane{i} at example dot com for more" for i in range(400)]
    wrong = [f"on {1990 + i % 30}-0{1 + i % 9}-1{i % 9} the order 411111111111{1000 + i} version 12.345.{1000 + i} came; the point at the dot on the map, token 7c{i:03}{74656391396 + i}d" for i in range(200)]
    for t in loose:
        assert not [y for _, y in pii.labelled(t)]
    df = spark.createDataFrame(list(enumerate(base + loose + wrong)), "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(df, pii.train(df)).collect()}
    assert all(got[i] == ["email", "phone"] for i in range(500))
    assert all(set(got[i]) <= {"card"} for i in range(500, 700))  # a card only where it is a base span


def test_stretches_match_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        spans = [("x", s, s + rng.randint(1, 9)) for s in rng.sample(range(60), rng.randint(0, 8))]
        held = pii.Stretches(spans)
        for s in range(62):
            e = s + rng.randint(1, 6)
            assert held.meet(s, e) == any(s < y and x < e for _, x, y in spans)
            if not held.meet(s, e) and rng.random() < 0.1:
                held.add(s, e)
                spans.append(("x", s, e))


def test_pii_of_a_long_listing_takes_time_in_proportion():
    rng = random.Random(5)
    lines = [f"a{i}@mail.example.com tel (5{i % 90 + 10}) 555-{1000 + i % 9000} from 10.0.{i % 256}.{i % 200}" for i in range(4000)]
    detector = pii.Detector([(x, y, 1, 1.0) for t in lines[:300] for x, y in pii.labelled(t)])
    took = []
    for n in (1000, 4000):
        text = "\n".join(lines[:n])
        began = time.process_time()
        base = pii.base_spans(text)
        assert len(base) == 2 * n
        detector.added(text, base)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


def test_pii_recall_of_loose_forms_and_clean_texts(spark):
    """Forms that the base patterns miss are found, and values that aren't personal are left alone."""
    rng = random.Random(21)
    digits = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    train = [f"mail a{i}.b@host{i % 50}.example.com or call +{rng.randint(1, 99)} ({rng.randint(200, 989)}) {rng.randint(200, 989)}-{digits(4)} from {rng.randint(1, 255)}.{rng.randint(0, 255)}.{i % 256}.9, card {luhn_card(rng)}" for i in range(300)]
    loose = [f"{rng.choice(['tel', 'phone', 'call'])} ({rng.randint(200, 989)}) {rng.randint(200, 989)}-{digits(4)} today" for _ in range(100)]
    loose += [f"phone {rng.randint(200, 989)}.{rng.randint(200, 989)}.{digits(4)} today" for _ in range(100)]
    loose += [f"write to name{i} at mail{i % 9} dot com soon" for i in range(100)]
    loose += [f"server ip {rng.randint(1, 255)} . {rng.randint(0, 255)} . {rng.randint(0, 255)} . {rng.randint(0, 255)} is up" for _ in range(100)]
    clean = [f"on {rng.randint(1900, 2024)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} it was {digits(3)} km" for _ in range(100)]
    clean += [f"release version 12.{rng.randint(300, 999)}.{digits(4)}.1 is out" for _ in range(100)]
    clean += [f"between {rng.randint(1900, 1950)} - {rng.randint(1951, 2000)} at the point of the story" for _ in range(100)]
    texts = train + loose + clean
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df, pii.train(df)).collect()}
    found = [bool(got[300 + i].spans) for i in range(400)]
    assert sum(found) >= 0.9 * 400
    assert not any(got[700 + i].spans for i in range(300))


def _told(table):
    return pii.Detector([(x, y, 1, 1.0) for x, y in pii.taught(table)])


def test_pii_of_kinds_of_numbers_that_were_never_learned():
    """Each kind of number that isn't personal is left out in turn; precision and recall are of cases that were held out.
    As its values stand alone or after words unknown to the learned table, few are redacted."""
    right = wrong = every = 0
    for left_out in piicases.OTHERS:
        if left_out.name == "octets":
            continue
        detector = _told(tuple(g for g in piicases.TABLE if g is not left_out))
        bad = [t for t, kind, _, _ in piicases.cases((left_out,)) if kind is None and not any(w in t for p in piicases.PERSONAL for w in p.words)]
        wrong += sum(bool(detector.added(t, pii.base_spans(t))) for t in bad)
        assert sum(bool(detector.added(t, pii.base_spans(t))) for t in bad) <= 0.1 * len(bad), left_out.name
        rng = random.Random(left_out.name)
        for word in ("tel", "call", "Telefon", "mobile"):
            for pattern in ("(2##) ###-####", "4##.###.####", "0## #### ####"):
                value = piicases.filled(pattern, rng)
                text = f"you can reach us by {word} {value} all day"
                every += 1
                right += any(text[a:b] == value for _, a, b in detector.added(text, pii.base_spans(text)))
    assert right >= 0.9 * every and right >= 0.9 * (right + wrong)


def test_pii_leaves_numbers_that_are_not_personal_alone():
    detector = _told(piicases.TABLE)
    for text in ("978-3-16-148410-0", "ISBN 978-3-16-148410-0", "parcel 123 456 789", "invoice 20230115-0042", "52.5200 13.4050", "12/34/56/78", "IMEI 35-209900-176148-1", "490154203237518", "id 1234-5678-90",
                 "call on 2024-05-12", "in 1950 or 2812", "some 12 345 678 people", "release version 12.345.1000.1 is out", "DIN 4711-0815-22", "the point at the dot on the map"):
        assert detector.added(text, pii.base_spans(text)) == [], text


def test_pii_trees_go_by_context():
    """The same value is a phone number or not, by the words before; without these, cases can't be told apart."""
    detector = _told(piicases.TABLE)
    rng = random.Random(2)
    values = [piicases.filled(p, rng) for p in ("4##.###.####", "### ### ###", "6## ### ####") for _ in range(20)]
    told = lambda word, v: bool(detector.added(f"{word} {v} today", []))
    assert sum(told("tel", v) for v in values) >= 0.9 * len(values)
    assert sum(told("parcel", v) for v in values) <= 0.1 * len(values)
    assert any(f >= 25 for tree in detector.model.trees for f, _, _ in tree)  # the last five features
    cases = pii.taught()
    x, y = np.array([c for c, _ in cases]), np.array([label for _, label in cases])
    blind = x.copy()
    blind[:, -5:] = 0
    error = lambda z: ((boost.Boosted().fit(z[::2], y[::2].astype(float)).predict(z[1::2]) > 0.5) != y[1::2]).mean()
    assert error(blind) > 2 * error(x)


def test_pii_of_an_empty_corpus_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    detector = pii.train(empty)
    rows = spark.createDataFrame([(1, "tel 0171 2345678 please"), (1, "tel 0171 2345678 please"), (None, None), (2, "")], "doc_id long, text string")
    got = pii.find(rows, detector).collect()
    assert sorted(len(r.spans) for r in got) == [0, 0, 1, 1]


def luhn_card(rng):
    digits = "".join(str(rng.randint(0, 9)) for _ in range(15))
    return digits + next(str(d) for d in range(10) if pii.luhn(digits + str(d)))


def test_pii_sample_keeps_every_kind_beside_many_copies(spark):
    rng = random.Random(12)
    hot = spark.range(3000).selectExpr("id as doc_id", "'mail me at one@mail.example.com now' as text")
    rare = [f"see 10.{i}.{i % 7}.{i * 3} or {luhn_card(rng)} or +1 (5{10 + i}) 555-{1000 + i * 17}" for i in range(60)]
    df = hot.union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(rare)], "doc_id long, text string"))
    cases = pii.sampled(df, most=400)
    assert len(cases) <= 400
    assert {(int(x[0]), y) for x, y, _, _ in cases} >= {(k, y) for k in (1, 2, 3) for y in (0, 1)} | {(0, 1)}
    assert max(n for _, _, n, _ in cases) == 3000
    whole = pii.sampled(df)
    for group in {(x[0], y) for x, y, _, _ in whole}:  # what isn't taken is weighed in
        assert sum(n * w for x, y, n, w in cases if (x[0], y) == group) == pytest.approx(sum(n for x, y, n, _ in whole if (x[0], y) == group))
    found = pii.find(spark.createDataFrame([(1, "tel (564) 555-4526 please")], df.schema), pii.train(df, most=400)).first()
    assert [s.kind for s in found.spans] == ["phone"]


def test_boosting_weighs_rows():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, (300, 3)).astype(float), rng.integers(0, 2, 300).astype(float)
    n = rng.integers(1, 5, 300)
    weighed, every = boost.Boosted().fit(x, y, n.astype(float)), boost.Boosted().fit(np.repeat(x, n, axis=0), np.repeat(y, n))
    assert np.allclose(weighed.predict(x), every.predict(x))


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    model = boost.Boosted().fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_base_spans(spark):
    rng = random.Random(3)
    bits = ["token", "API_key", "secret", "=", ": ", '"', "'", "abcdefgh", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é😀", " ", "\n", ".", "zz"]
    texts = [None, "", "token=secret:abcdefghij", "AKIA" * 6] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    got = {r.doc_id: r for r in secretscan.find(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == brute_secrets(t or ""), t
        assert set(got[i].base) <= set(got[i].spans)


def brute_battery(token, letters):
    """The battery, written out for one token."""
    name = next(k for k, p in (("decimal", "[0-9]+"), ("hex", "[0-9a-f]+"), ("HEX", "[0-9A-F]+"), ("base32", "[A-Z2-7]+"), ("base64", ".*[a-z].*"), ("BASE64", ".+")) if re.fullmatch(p, token))
    alphabet = secretscan.ALPHABETS[name]
    n, m, x = len(token), len(alphabet), [alphabet.index(c) for c in token]
    weigh = lambda c: secretscan.SHARES["digit"] / 10 if c.isdigit() else secretscan.SHARES["sign"] / 4 if not c.isalpha() else secretscan.SHARES["lower" if (c.isupper() if name == "BASE64" else c.islower()) else "upper"] * letters[ord(c.lower()) - 97] / sum(letters)
    q = np.array([weigh(c) for c in alphabet])
    q /= q.sum()
    y = np.arange(m) - (m - 1) / 2
    squares, df = sum(x.count(i) ** 2 for i in set(x)), m - 1
    chi = (((squares * m / n - n) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    up = [i >= m / 2 for i in x]
    runs = 1 + sum(a != b for a, b in zip(up, up[1:], strict=False))
    product = sum(y[a] * y[b] for a, b in zip(x, x[1:], strict=False))
    known = secretscan.ordinary(name, tuple(letters))
    parts = [np.log(secretscan.WEIGHTS[0]) + sum(np.log(1 / m / q[i]) for i in x)]
    if n <= secretscan.EXACT:
        at = n - secretscan.LEAST
        values = [(known.chi, known.chi_mean, squares), (known.runs, known.runs_mean, runs), (known.serial, known.serial_mean, product)]
        parts += [np.log(w) + tilt[at] * value - mean[at] for w, (tilt, mean, value) in zip(secretscan.WEIGHTS[1:], values, strict=True)]
    return name, chi, (runs - (n + 1) / 2) / np.sqrt((n - 1) / 4), product / ((m * m - 1) / 12) / np.sqrt(n - 1), np.logaddexp.reduce(parts)


def test_means_of_the_statistics_match_brute_force():
    """The exact means, against all words of a small alphabet."""
    q, n = np.array([0.5, 0.2, 0.2, 0.1]), 6
    y, words = np.arange(4) - 1.5, np.array(np.meshgrid(*[range(4)] * n)).reshape(n, -1).T
    chance = q[words].prod(axis=1)
    squares = sum((words == i).sum(axis=1) ** 2 for i in range(4))
    assert secretscan._squares_mean(q, n, -0.3) == pytest.approx(np.log((chance * np.exp(-0.3 * squares)).sum()))
    products = (y[words][:, 1:] * y[words][:, :-1]).sum(axis=1)
    assert secretscan._chain_mean(np.exp(-0.1 * np.outer(y, y)) * q, q, n) == pytest.approx(np.log((chance * np.exp(-0.1 * products)).sum()))
    turns = ((words[:, 1:] > 1) != (words[:, :-1] > 1)).sum(axis=1)
    p = np.array([0.7, 0.3])
    assert secretscan._chain_mean(np.exp(0.4 * (1 - np.eye(2))) * p, p, n) == pytest.approx(np.log((chance * np.exp(0.4 * turns)).sum()))


@pytest.mark.parametrize("name", list(secretscan.ALPHABETS))
@pytest.mark.parametrize("n", [12, 20, 64])
def test_evidence_of_ordinary_tokens_has_a_mean_of_one_at_most(name, n):
    """Its share above any bar is at most one over the bar, in a simulation of ordinary tokens."""
    rng, letters = np.random.default_rng(n), [float(x) for x in secretscan.LETTERS]
    q, known, at, m = secretscan.shares(name, letters), secretscan.ordinary(name, tuple(letters)), n - secretscan.LEAST, len(secretscan.ALPHABETS[name])
    x = rng.choice(m, (40_000, n), p=q)
    y = np.arange(m) - (m - 1) / 2
    counts = np.stack([(x == i).sum(axis=1) for i in range(m)])
    up = x >= m / 2
    values = [(counts**2).sum(axis=0), 1 + (up[:, 1:] != up[:, :-1]).sum(axis=1), (y[x][:, 1:] * y[x][:, :-1]).sum(axis=1)]
    tilts = [(known.chi, known.chi_mean), (known.runs, known.runs_mean), (known.serial, known.serial_mean)]
    parts = [-np.array(known.logs)[x].sum(axis=1), *[t[at] * v - mean[at] for v, (t, mean) in zip(values, tilts, strict=True)]]
    e = sum(w * np.exp(p) for w, p in zip(secretscan.WEIGHTS, parts, strict=True))
    assert np.minimum(e, 1e4).mean() < 1.05
    for bar in (2, 10, 100):
        assert (e >= bar).mean() <= 1 / bar
    for p in parts[1:]:
        assert np.exp(p).mean() == pytest.approx(1, abs=0.1)


def test_battery_matches_brute_force(spark):
    rng = random.Random(2)
    tokens = ["".join(rng.choice(a) for _ in range(rng.randint(12, 80))) for a in secretscan.ALPHABETS.values() for _ in range(12)]
    tokens += ["internationalizationofthings", "aaaaaaaaaaaaaaaaaaaa", "0000000000000000000001", "Some-Path/with_parts/x9", "CONSTANT_VALUE-2/OF"]
    letters = [float(n) for n in secretscan.LETTERS]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secretscan.battery(F.col("t"), letters).alias("b")).collect()
    for r in got:
        name, *values = brute_battery(r.t, letters)
        assert r.b.encoding == name
        assert [r.b.chi, r.b.runs, r.b.serial, r.b.evidence] == pytest.approx(values, rel=1e-6, abs=1e-6), r.t


def test_step_up_matches_brute_force(spark):
    rng = random.Random(7)
    distinct = [(key, rng.choice([0.0, 0.0, 5.0]), 0.0, 0.0, rng.choice([rng.uniform(-9, 4), rng.uniform(3, 30)])) for key in range(150)]
    rows = [(i, [(0, 20, *rng.choice(distinct)) for _ in range(rng.randint(0, 4))]) for i in range(200)]
    scanned = spark.createDataFrame(rows, "doc_id long, tested array<struct<start:int,end:int,key:long,chi:double,runs:double,serial:double,evidence:double>>")
    tested = [max(0.0, t[6]) if abs(t[3]) <= secretscan.LIMIT else 0.0 for t in {t for _, ts in rows for t in ts}]
    bins = sorted(int(e / secretscan.BIN) for e in tested)
    ok = [b for b in set(bins) if b > 0 and np.exp(-b * secretscan.BIN) * len(bins) <= 0.01 * sum(x >= b for x in bins)]
    assert secretscan.threshold(scanned) == min(ok) * secretscan.BIN
    assert secretscan.threshold(scanned.union(scanned).union(scanned)) == min(ok) * secretscan.BIN


def test_repeats_of_a_token_are_no_evidence(spark):
    """Ordinary tokens that come hundreds of times are left alone, and a secret is found once or often alike."""
    names = ["TheQuickBrownFox", "MacBookPro2019Model", "getUserAccountByName", "README-INSTALL-LICENSE", "snake_case_identifier_v2", "src/main/java/org/example/App"]
    secret = "q7ZkX0vJ9wTfB3mYgQhR5xUeK1pL8sWd"
    for times in (1, 300):
        texts = [f"see {names[0]} here"] * times + [f"see {names[1]} here"] * times + [f"see {t} here" for t in names[2:]] + [f"key {secret} here"] * times
        found = secretscan.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert {texts[r.doc_id] for r in found if any(s.kind == "random" for s in r.spans)} == {f"key {secret} here"}
        assert sum(any(s.kind == "random" for s in r.spans) for r in found) == times


def test_secrets_of_a_long_listing(spark):
    """Places stay right over many groups of matches."""
    rng = random.Random(9)
    lines = [f"é {i} token={'abcdefgh' + str(i)}; {''.join(rng.choice('0123456789abcdef') for _ in range(32))} AKIA{i:016}" for i in range(700)]
    text = "\n".join(lines)
    got = secretscan.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(s) for s in got.base] == brute_secrets(text)


def test_letter_counts(spark):
    texts = ["The elephant eats vegetables, NOT Vegetables or camelCaseWords", None, "", "abcdefgh " * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counted = "elephant" + "vegetables" + "abcdefgh" * 3
    assert secretscan.letter_counts(df) == [float(n + counted.count(chr(97 + i))) for i, n in enumerate(secretscan.LETTERS)]


def test_secret_discoveries(spark):
    """Secrets of many encodings and lengths are found, in texts of two languages, and ordinary tokens are left alone."""
    from string import ascii_letters, ascii_uppercase, digits

    rng = random.Random(11)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    secrets = [draw(ascii_letters + digits, n) for n in (18, 19, 20, 24, 32, 44, 64) for _ in range(20)] + [draw(ascii_letters + digits + "+/", 40) for _ in range(30)]
    secrets += [draw("0123456789abcdef", n) for n in (24, 28, 31) for _ in range(10)] + [draw(ascii_uppercase + "234567", 32) for _ in range(30)]
    plain = ["internationalization-of-the-thing", "averyveryverylongwordthatisnotrandom", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "01010101010101010101010101", "2024-01-01-2024-01-02-2024-01-03", "/usr/lib/python/site/packages/x"]
    plain += ["Donaudampfschifffahrtsgesellschaft", "Geschwindigkeitsbegrenzung", "getUserAccountByName", "snake_case_identifier_v2", "x86_64-unknown-linux-gnu", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "20240131235959", "CONSTANT_VALUE_OF_THINGS", "README-INSTALL-LICENSE", "Some/Path/To/A/File-name_2", "src/main/java/org/example/App"]
    around = ["the elephant sees something wonderful between mountains", "die Verwaltung berichtet wochenlang darueber irgendwo"]
    texts = [f"{around[i % 2]} {t} there" for i, t in enumerate(secrets + plain * 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id for r in secretscan.find(df).collect() if any(s.kind == "random" for s in r.spans)}
    n = len(secrets)
    assert len(found & set(range(n))) >= 0.9 * n
    assert not {texts[i] for i in found - set(range(n))}
    assert secretscan.find(df.limit(0)).count() == 0


def test_queries_and_pipeline(spark):
    import corpus_pipeline
    from quarry.llm import queries

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert [len({n for n in queries.QUERIES if n.startswith(f"op{k}_")}) for k in range(1, 11)] == [1] * 10
    assert queries.QUERIES["op4_sentencepiece"](spark, sf).filter("round_trip").count() == documents.count()
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        seen.append((name, docs.count()))
        if name != "pieces":
            assert docs.columns == documents.columns
            assert docs.dtypes == documents.dtypes
        if name in ("language", "near_duplicates"):
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    counts = dict(seen)
    assert counts["near_duplicates"] == counts["personal_data"] and counts["mixture"] == counts["pieces"]
    assert docs.filter(~F.col("round_trip")).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    """Nulls, empty and repeated rows, repeated ids, extra columns with the operators' own names, and an empty table."""
    from collections import Counter

    import corpus_pipeline
    from quarry.llm import spiece
    from test_text_operators import brute_components, brute_fingerprint, brute_mix

    rng = random.Random(17)
    stock = {"en": "the house of this man was in that town with other things and people from here", "de": "das haus von dem mann war in der stadt mit anderen dingen und leuten von hier"}
    prose = lambda lang, n: " ".join(rng.choice(stock[lang].split()) + rng.choice(["", "", "s", "en"]) for _ in range(n))
    rows = [(i, prose(lang, rng.randint(30, 90)), lang, rng.choice(["a", "b", None])) for i in range(60) for lang in [rng.choice(["en", "de"])]]
    rows += [(100 + i, rows[i][1] if i % 2 else rows[i][1].upper(), None, "a") for i in range(10)]  # copies
    rows += [(5, prose("en", 40), "en", "b"), (None, prose("de", 40), "de", "b"), (None, prose("de", 40), "de", "b"), rows[7], rows[7]]
    rows += [(200, None, "en", "a"), (201, "", "de", "a"), (202, "123 !!", None, None), (203, prose("en", 40) + " mail x.y@mail.example.org or +1 (555) 123-4567", "en", "a")]
    schema = "doc_id long, text string, lang string, source string, score double, lang_pred string, fp long, key string, size int, target double, ids string"
    docs = spark.createDataFrame([(*r, 0.5, "x", 1, "k", 2, 3.0, "z") for r in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path))
        if name != "pieces":
            assert state.dtypes == docs.dtypes
        seen[name] = [r.asDict() for r in state.collect()]
        state = spark.createDataFrame([tuple(r.values()) for r in seen[name]], state.schema)
    pick = lambda part: [(r["doc_id"], r["text"]) for r in part]
    assert Counter(pick(seen["language"])) == Counter((i, t) for i, t, _, _ in rows if any(c.isalpha() for c in t or ""))
    prints = [brute_fingerprint(t) for _, t in pick(seen["language"])]
    roots = brute_components(sorted(set(prints)))
    best = {}
    for (i, _), f in zip(pick(seen["language"]), prints, strict=True):
        best[roots[f]] = min(best.get(roots[f], 10**9), 10**9 if i is None else i)
    kept = pick(seen["near_duplicates"])
    assert len(kept) == len(best)
    assert {roots[brute_fingerprint(t)]: 10**9 if i is None else i for i, t in kept} == best
    masked = dict((r["doc_id"], r["text"]) for r in seen["personal_data"])
    assert len(seen["personal_data"]) == len(kept) and masked[203].endswith("mail [EMAIL] or [PHONE]")
    assert Counter(t for _, t in pick(seen["personal_data"]) if "[" not in t) == Counter(t for i, t in kept if i != 203)
    clean = [(r["doc_id"], r["text"], r["source"]) for r in seen["personal_data"]]
    _, _, taken = brute_mix([r for r in clean if r[0] is not None])
    mixed = Counter(r["doc_id"] for r in seen["mixture"])
    if all(r[0] is not None for r in clean):
        assert mixed == Counter({i: taken[i, s] for i, _, s in clean if taken[i, s]})
    model = spiece.Pieces(spiece.read_model()).model
    by_id = {i: t for i, t, _ in clean if i is not None}
    for r in seen["pieces"]:
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        if r["doc_id"] is not None and r["doc_id"] != 5:
            assert list(r["ids"]) == model.encode(by_id[r["doc_id"]])
    assert Counter(r["doc_id"] for r in seen["pieces"]) == mixed
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["pieces"])
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", ["op2_quality", "op3_chat", "op10_mixing", "url_rules"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from quarry.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = columns
    a, b = got[columns].sort_values(key).reset_index(drop=True), want[columns].sort_values(key).reset_index(drop=True)
    assert len(a) == len(b)
    for c in columns:
        assert list(a[c]) == pytest.approx(list(b[c])) if a[c].dtype.kind == "f" else list(a[c]) == list(b[c])
