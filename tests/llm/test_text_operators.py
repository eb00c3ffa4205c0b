"""Quality, mixing, SimHash, language and SentencePiece operators against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import langid, mixing, quality, simhash, spiece

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "a"), len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def brute_quality(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a b c d e a b c d e", "x\x0by\x0cz", "é ñ # | <b> 😀", "a " * 3000]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d# ", "\n", "é "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeated = brute_quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated), t
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.base_failed and r.kept)
    assert quality.judge(docs(spark, [])).count() == 0
    twice = quality.judge(docs(spark, ["a b c"]).union(docs(spark, ["a b c"])).withColumns({"n_words": F.lit("x"), "__words": F.lit(1)}))
    assert [(r.doc_id, r.n_words) for r in twice.collect()] == [(0, 3), (0, 3)]


def test_quality_verdicts(spark):
    clean = "The house of the man was in the town and it had a red door"
    noisy = " ".join(w + "###" for w in clean.split())
    kept = {r.doc_id: r.kept for r in quality.judge(docs(spark, [clean, noisy, "zz qq " * 10])).collect()}
    assert kept == {0: True, 1: False, 2: False}


def brute_mix(rows):
    sizes, per = {}, defaultdict(int)
    for doc, text, source in rows:
        sizes[doc, source] = sizes.get((doc, source), 0) + len(WORD.findall(text or ""))
    for (_, source), n in sizes.items():
        per[source] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(per.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            break
        level = (budget - sum(2 * per[s] for s in capped)) / sum(weight[s] for s in free)
        new = {s for s in order if 2 * per[s] <= level * weight[s]}
        if new == capped:
            break
        capped = new
    target = {s: float(2 * per[s]) if s in capped else level * weight[s] for s in order}
    copies = []
    for s in order:
        run = 0
        mine = sorted((hashlib.md5(str(d).encode()).hexdigest(), d, n) for (d, x), n in sizes.items() if x == s and n)
        for key, d, n in mine:
            run += n
            copies += [((p * per[s] + run) / target[s], s is None, s or "", p, key, d, s, n) for p in (0, 1)]
    total, taken = 0, Counter()
    for c in sorted(copies):
        total += c[-1]
        if total > budget:
            break
        taken[c[5], c[6]] += 1
    return per, target, taken


@pytest.mark.parametrize("bins", [20_000, 3])
def test_mixing_matches_brute_force(spark, monkeypatch, bins):
    monkeypatch.setattr(mixing, "BIN_ROWS", bins)
    monkeypatch.setattr(mixing, "TIME_BINS", 8)
    rng = random.Random(3)
    rows = [(i, None if i == 3 else " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    per, target, taken = brute_mix(rows)
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    for i, text, source in rows:
        n = len(WORD.findall(text or ""))
        r = got[i]
        assert (r["size"], r.source_size, r.taken) == (n, per[source], n * taken[i, source])
        assert r.target == pytest.approx(target[source])
    emitted = Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    assert emitted == Counter({i: taken[i, s] for i, _, s in rows if taken[i, s]})


@pytest.mark.parametrize("sources", [1, 2, 7, 40])
def test_targets_match_rounds_of_sharing(spark, sources):
    rng = random.Random(sources)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 200])), rng.choice([f"s{k:02}" for k in range(sources)] + [None])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, target, _ = brute_mix(rows)
    got = {r.source: r.target for r in mixing.source_targets(mixing.plan(df)[0]).collect()}
    assert got == {k: pytest.approx(v) for k, v in target.items()}


def test_bins_before(spark):
    rng = random.Random(2)
    rows = [(s, b, rng.randint(0, 9)) for s in ("a", None) for b in range(37) if rng.random() < 0.8]
    got = {(r.source, r.bin): r.before for r in mixing.bins_before(spark.createDataFrame(rows, "source string, bin int, bin_size long"), 5).collect()}
    assert got == {(s, b): sum(n for t, c, n in rows if t == s and c < b) for s, b, _ in rows}


def test_mixing_tells_rows_without_id_apart(spark):
    rows = [(None, " ".join(["w"] * n) + f" {n}", "a") for n in range(1, 60)] + [(1, "x y z", "b")] * 3
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 62
    assert sum(r.taken for r in got if r.doc_id is None) == pytest.approx(got[0].target if got[0].doc_id is None else got[-1].target, rel=0.1)


def test_mixing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, None, None), (1, " ", "a")], "doc_id long, text string, source string")
    assert {(r.taken, r.target) for r in mixing.mix(blank).collect()} == {(0, 0.0)}


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def test_fingerprints(spark):
    texts = [None, "", "One", "one TWO", "Ünder Ünder x y z", "a b c a b c a b c", "É é 😀\x0bz"]
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(docs(spark, texts)).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert got[4] == int(spark.sql("select 0").first()[0]) or got[4] >= 0
    one = spark.sql("select xxhash64('one') as h").first().h % 2**64
    assert got[2] == one


@pytest.mark.parametrize("crowd", [32, 2, 0])
def test_links_are_complete(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(6):
            v = centre
            for b in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << b
            values.add(v)
    values |= {0, 7, 2**63, 2**63 + 5}
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(nodes)).collect()}
    expected = brute_components(sorted(values))
    groups = lambda of: {frozenset(v for v in values if of(v) == r) for r in {of(v) for v in values}}
    assert groups(lambda v: roots.get(v, v)) == groups(lambda v: expected[v])


def test_near_duplicates_end_to_end(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [base, base, base.replace("w7 ", "x7 "), None, "", "other text here", base.upper()]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    roots = brute_components(sorted(set(fps)))
    assert got == {i: min(j for j, g in enumerate(fps) if roots[g] == roots[f]) for i, f in enumerate(fps)}
    kept = simhash.one_of_each(docs(spark, texts))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r.doc_id for r in kept.collect()} == set(got.values())
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_row_of_each_component(spark):
    far = [" ".join(f"{c}{i}" for i in range(200)) for c in "abcde"]
    rows = [(1, far[0]), (1, far[1]), (2, far[1]), (None, far[2]), (None, far[2]), (4, far[3]), (4, far[3]), (4, far[3].upper()), (3, far[4]), (None, far[4]), (7, None), (None, ""), (6, " ")]
    df = spark.createDataFrame([(i, t, "x", "y", None, "clash", "k") for i, t in rows], "doc_id long, text string, root string, key string, fp long, component_id string, __n string")
    got = [(r.doc_id, r.text) for r in simhash.one_of_each(df).collect()]
    ids = sorted(-1 if i is None else i for i, _ in got)
    assert ids == [-1, 1, 1, 3, 4, 6]
    assert {t for i, t in got if i == 1} == {far[0], far[1]}
    named = simhash.near_duplicates(df)
    assert named.count() == len(rows)
    assert {r.component_id for r in named.filter("doc_id = 1").collect()} == {1}


@pytest.mark.parametrize("hot", [1, 50_000])
def test_hot_fingerprints_are_named_alike(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    texts = ["same words here now"] * 30 + [" ".join(f"w{i}{k}" for k in range(50)) for i in range(10)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: 0 if i < 30 else i for i in range(40)}


SAMPLES = {"en": "the cat and the dog are in the house with the other thing of this world ", "de": "der hund und die katze sind nicht in dem haus mit der anderen sache von dieser welt "}


def brute_phrases(text, sample):
    """Longest phrases from left to right, over the whole text."""
    total, i = 0, 0
    while i < len(text):
        n = 0
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        i += max(1, n)
        total += 1
    return total


def test_cross_parsing_counts_longest_phrases():
    rng = random.Random(2)
    labelled = tuple((k, v.strip()) for k, v in SAMPLES.items())
    languages, classes, models = langid.automata(labelled)
    texts = [langid.plain("".join(rng.choice("the cadognisruh qx ") for _ in range(rng.randint(1, 900)))) for _ in range(40)]
    counts = langid.phrases(texts, classes, [t for t, _ in models])
    for i, t in enumerate(texts):
        for k, lang in enumerate(languages):
            assert counts[i, k] == brute_phrases(t, SAMPLES[lang].strip())


@pytest.mark.parametrize("rounds", [0, 8])
@pytest.mark.parametrize("block", [2, 7, 64])
def test_phrases_run_on_over_blocks(monkeypatch, block, rounds):
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "ROUNDS", rounds)
    rng = random.Random(block)
    labelled = (("a", "aaa"), ("b", "the cat sat on the mat abcabcab"), ("c", "".join(rng.choice("abc ") for _ in range(300)).strip()))
    samples = {k: langid.plain(v) for k, v in labelled}
    languages, classes, models = langid.automata(labelled)
    texts = ["a" * 500, "a", "", "abc" * 100, "cab" * 33 + "aa"] + [langid.plain("".join(rng.choice("abcthe q") for _ in range(rng.randint(1, 400)))) for _ in range(40)]
    counts = langid.phrases(texts, classes, [t for t, _ in models])
    assert counts.tolist() == [[brute_phrases(t, samples[k]) for k in languages] for t in texts]
    found, scores = langid.predict(texts, labelled)
    for t, lang, score in zip(texts, found, scores, strict=True):
        cost = {k: brute_phrases(t, samples[k]) * math.log2(len(samples[k]) + 1) for k in languages}  # a sample ends in a line feed
        low, second = sorted(cost.values())[:2]
        assert lang == (min(k for k in cost if cost[k] == low) if t else "und")
        assert score == pytest.approx(1 - low / second if t else 0)


def test_language_sample_takes_long_and_short_texts(spark):
    rng = random.Random(1)
    word = {"en": "the cat of this house ", "de": "der hund in dem haus ", "fr": "le chat de la maison "}
    rows = [(i, word["en"] * 200, "en", 0.5, "x", "y") for i in range(40)]  # 4,400 characters each
    rows += [(100 + i, word["de"], "de", 0.5, "x", "y") for i in range(40)]  # 21 each
    rows += [(200, word["fr"] * 10, "fr", 0.5, "x", "y")] * 500 + [(300 + i, word["fr"] * rng.randint(6, 90), "fr", 0.5, "x", "y") for i in range(300)]
    rows += [(900, None, "fr", 0.5, "x", "y"), (None, "la maison du chat", "fr", None, None, None), (901, "", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, __text string")
    taken = langid.sample(df, F.lit(True))
    assert {k: sum(x == k for x, _ in taken) for k in word} == dict.fromkeys(word, 40)
    assert max(len(t) for _, t in taken) <= langid.SAMPLE_MOST
    fr = [t for x, t in taken if x == "fr"]
    assert sum(t == word["fr"] * 10 for t in fr) <= 2  # copies of one row are one
    got = langid.accepted(df, taken)
    assert got.columns == df.columns and got.count() == len(rows) - 2
    found = langid.identify(df, taken, keep=("doc_id", "lang")).filter("doc_id < 900")
    assert found.filter("lang_pred = lang").count() == found.count()


def test_language_of_many_scripts(spark):
    rng = random.Random(11)
    signs = {"en": (97, 26), "fr": (0xE0, 40), "ru": (0x430, 32), "el": (0x3B1, 25), "hi": (0x905, 0x40), "zh": (0x4E00, 1500)}
    words = {k: ["".join(chr(at + rng.randrange(n)) for _ in range(rng.randint(2, 4))) for _ in range(600 if k == "zh" else 150)] for k, (at, n) in signs.items()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    labelled = tuple((k, text(k, 120)) for k in words for _ in range(10))
    languages, classes, models = langid.automata(labelled)
    samples = {k: "\n".join(langid.plain(langid.letters(t)) for x, t in labelled if x == k) for k in words}
    assert set(classes) == {c for t in samples.values() for c in t} - {"\n"}
    texts = [langid.plain(langid.letters(text(k, 90) + " " + text(other, 20))) for k in words for other in words]
    counts = langid.phrases(texts, classes, [t for t, _ in models])
    assert counts.tolist() == [[brute_phrases(t, samples[k]) for k in languages] for t in texts]
    df = docs(spark, [text(k, n) for k in words for n in (5, 40)])
    got = {r.doc_id: r for r in langid.identify(df, list(labelled)).collect()}
    assert [got[i].lang_pred for i in range(len(got))] == [k for k in words for _ in range(2)]
    assert min(r.score for r in got.values()) > 0.1


def test_language(spark):
    labelled = [(k, v) for k, v in SAMPLES.items()]
    df = docs(spark, ["the other house and the world", "die andere welt und das haus", None, "", "123 ### ..", "the " * 50_000])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, labelled).collect()}
    assert [got[i][0] for i in range(6)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.doc_id for r in langid.accepted(df, labelled).collect()} == {0, 1, 5}
    assert {r.lang_pred for r in langid.identify(df, []).collect()} == {"und"}
    assert langid.sample(docs(spark, []), F.lit(True)) == []


def test_language_sample_leaves_out_held_out(spark):
    df = spark.range(200).selectExpr("id as doc_id", "concat(repeat('word ', 30), id) as text", "if(id % 3 = 0, null, 'en') as lang")
    taken = langid.sample(df, ~langid.held_out(), texts=500)
    import zlib

    ids = {int(t.split()[-1].removeprefix("word")) for _, t in taken}
    assert ids == {i for i in range(200) if i % 3 and zlib.crc32(str(i).encode()) % 4 != 2}


@pytest.fixture(scope="module")
def pieces():
    return spiece.Pieces(spiece.read_model())


def test_scan_equals_the_library(pieces):
    rng = random.Random(9)
    letters = "ab cd  ethion\nñé中文字  😀aaaa▁internationalization tion"
    for r in range(120):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 300)))
        text = text.replace(" ", "") if r % 4 == 0 else text
        parts = list(spiece.cut(spiece.clean(text), rng.choice([40, 64, 97]), pieces.longest))
        states = spiece.scan([spiece.transfer(pieces, s, a, b, k == 0, k == n - 1) for k, n, s, a, b in parts])
        ids = []
        for (k, n, s, a, b), (entry, leave) in zip(parts, states, strict=True):
            ids += spiece.backtrace(pieces, s, a, b, k == 0, k == n - 1, entry, leave)[0]
        assert ids == pieces.model.encode(text), text


def test_products_are_associative():
    rng = np.random.default_rng(1)
    ms = [rng.normal(size=(3, 3)) for _ in range(7)]
    step, expected = ms[0], [ms[0]]
    for m in ms[1:]:
        step = spiece.product(step, m)
        expected.append(step)
    assert all(np.allclose(a, b) for a, b in zip(spiece.prefixes(ms), expected, strict=True))


def test_scan_of_one_stretch_without_spaces(pieces):
    """Entries that go on alike give what each gives alone."""
    rng = random.Random(4)
    for _ in range(20):
        text = spiece.clean("".join(rng.choice("ethionabé中文") for _ in range(240)))
        for k, n, s, a, b in spiece.cut(text, 80, pieces.longest):
            got = spiece.transfer(pieces, s, a, b, k == 0, k == n - 1)
            entries = [(None, 0)] if k == 0 else [(s[i:j], j) for i, j in pieces.states(s, a)]
            exits = {x: m for m, x in enumerate(pieces.states(s, b))}
            for row, (piece, at) in zip(got, entries, strict=True):
                ends = pieces.reach(s, piece, at, b)[1]
                wanted = {0} if k == n - 1 and any(q == b for _, q in ends) else {exits[x] for x in ends if x in exits} if k < n - 1 else set()
                assert set(np.flatnonzero(row == 0)) == wanted or (k == n - 1 and at == b)


@pytest.mark.parametrize("run", [2, 3, 64])
def test_states_of_chunks_by_levels(spark, run):
    rng = np.random.default_rng(run)
    rows, wanted = [], {}
    for doc, n in enumerate((1, 2, 5, 8, 23)):
        widths = [1, *rng.integers(1, 5, n - 1).tolist(), 1]
        path = [int(rng.integers(w)) for w in widths]
        for k in range(n):
            m = np.full((widths[k], widths[k + 1]), spiece.MINUS)
            m[path[k], path[k + 1]] = 0.0
            rows.append((doc, k, widths[k + 1], [float(v) for v in m.ravel()]))
            wanted[doc, k] = (path[k], path[k + 1])
    matrices = spark.createDataFrame(rows, spiece.MATRIX)
    got = {(r["row"], r.k): (r.entry, r.leave) for r in spiece.chunk_states(matrices, 23, run).collect()}
    assert got == wanted


def test_encode_at_production_sizes(spark, pieces):
    words = ["the", "internationalization", "中文", "é", "x", "brown", "fox", "\n"]
    rng = random.Random(8)
    long = " ".join(rng.choice(words) for _ in range(60_000))
    dense = "".join(rng.choice("ethionab") for _ in range(40_000))
    assert len(long) > 8 * spiece.CHUNK and len(dense) > spiece.GIANT
    rows = {r.doc_id: r for r in spiece.encode(docs(spark, [long, dense, long + "\u2581", "a\u2581b"])).collect()}
    for i, t in enumerate((long, dense, long + "\u2581", "a\u2581b")):
        assert list(rows[i].ids) == pieces.model.encode(t)
        assert rows[i].round_trip == (i < 2)


def test_encode_and_decode(spark, pieces):
    texts = [None, "", " ", "  two  spaces ", "Hello world\nand 中文 😀", "thereisnospace" * 40, "the quick brown fox " * 60, "x" * 500]
    got = spiece.decode(spiece.encode(docs(spark, texts), chunk=100, giant=200))
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert list(rows[i].ids) == (pieces.model.encode(t) if t else []), t
        assert rows[i].text == (t or "") and rows[i].round_trip
    assert spiece.encode(docs(spark, [])).count() == 0
    twice = spiece.encode(docs(spark, ["z y " * 100]).union(docs(spark, ["z y " * 100])), chunk=100, giant=200)
    assert [len(r.ids) for r in twice.collect()] == [len(pieces.model.encode("z y " * 100))] * 2
