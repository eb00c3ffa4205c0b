"""Secret scans: fixed base patterns, and a battery of randomness tests on long tokens.

A token's encoding is inferred from its characters (decimal, hexadecimal, base 32 or base 64). Three tests
ask whether it looks drawn evenly from that alphabet: chi-squared on its characters' counts, runs above
and below the alphabet's middle, and serial correlation. A token that fails one is not a secret.

For the others each test gives an e-value against an ordinary token of that encoding and length, whose characters are
drawn with the shares that they have in the corpus's own long words: a number that is never negative and whose mean over
such tokens is one. Those of the counts are the ratio of the even draw's likelihood to the ordinary one's; those of
chi-squared, runs and serial correlation are exponential tilts of the statistic, over their exact means, which are worked
out for each encoding and length up to EXACT (longer tokens get no more than what the counts give). Their weighted mean is
an e-value however they depend on each other, and its largest possible value grows with the length, so a short token can't
look as unlike text as a long one. Step-up on e-values over all distinct tested tokens of the corpus, by a histogram,
holds the share of false discoveries under any dependence. A token that comes again is no further evidence.

Tokens have LEAST characters or more. Those below PLAIN characters that are all letters of one case (the first apart)
have the form of words and are not tested. Purely decimal tokens are
never discovered, as an even draw of digits is what ordinary numbers look like: their evidence is nought.

All of it is native expressions. Null texts count as empty. Each text is scanned whole, repeated rows each; offsets are
code points; one row per input row. Other columns don't matter.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bind, checkpointed, text_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Characters of a token, and of one that is tested even if it has the form of a word.
LEAST, PLAIN = 12, 20
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}+"
WORDLIKE = "^(?:[A-Za-z][a-z]*|[A-Z]+)$"
#: Words that letter shares are counted in.
COUNTED = r"(?<![A-Za-z])[a-z]{8,}+(?![A-Za-z])"
FALSE_DISCOVERIES = 0.01
#: Each test's two-sided limit, in standard deviations: a probability of 0.001.
LIMIT = 3.29
#: The longest token whose statistics' means are worked out, and the weights of counts, chi-squared, runs and serial correlation.
EXACT, WEIGHTS = 128, (0.7, 0.1, 0.1, 0.1)
#: Matches whose places are summed up together.
GROUP = 256
#: Bins of the histogram of ln e: width and number.
BIN, BINS = 0.25, 400

# Alphabets in order, and letter frequencies of text in per mille, a to z, which count as so many letters of the corpus.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: Base 64 without a lower-case letter: what is ordinary there is written in capitals.
ALPHABETS["BASE64"] = ALPHABETS["base64"]
#: Shares of lower-case letters, upper-case letters, digits and signs in ordinary tokens (names, paths, identifiers).
SHARES = {"lower": 0.75, "upper": 0.10, "digit": 0.08, "sign": 0.07}


class Ordinary(NamedTuple):
    """What an ordinary token's characters are like, by place in the alphabet, and for each length from LEAST to EXACT each
    statistic's tilt and ln of its mean: the e-value of a statistic is exp(tilt * statistic - ln mean)."""

    logs: list[float]  # ln of each one's share over 1 / m
    chi: list[float]
    chi_mean: list[float]
    runs: list[float]
    runs_mean: list[float]
    serial: list[float]
    serial_mean: list[float]


def shares(name: str, letters: list[float]) -> np.ndarray:
    """The shares of an alphabet's characters in ordinary tokens."""
    alphabet, small = ALPHABETS[name], str.isupper if name == "BASE64" else str.islower
    total = sum(letters)

    def weight(c: str) -> float:
        if c.isdigit():
            return SHARES["digit"] / 10
        if not c.isalpha():
            return SHARES["sign"] / 4
        return SHARES["lower" if small(c) else "upper"] * letters[ord(c.lower()) - 97] / total

    weights = np.array([weight(c) for c in alphabet])
    return weights / weights.sum()


def _squares_mean(q: np.ndarray, n: int, tilt: float) -> float:
    """ln of the mean of exp(tilt * sum of squared counts) of n characters: Poisson counts, given that they add up to n."""
    c = np.arange(n + 1)
    factorial = np.concatenate([[0.0], np.cumsum(np.log(c[1:]))])
    scale, whole = 0.0, np.eye(1, n + 1)[0]
    for share in q:
        whole = np.convolve(whole, np.exp(c * math.log(n * share) - factorial - n * share + tilt * c * c))[: n + 1]
        scale += math.log(whole.max())
        whole /= whole.max()
    return scale + math.log(whole[n]) - (n * math.log(n) - n - factorial[n])


def _chain_mean(step: np.ndarray, start: np.ndarray, n: int) -> float:
    """ln of the sum over all paths of n characters: what a step weighs, from what they start with."""
    scale, row = 0.0, start
    for _ in range(n - 1):
        row = row @ step
        scale += math.log(row.sum())
        row = row / row.sum()
    return scale + math.log(row.sum())


@lru_cache(maxsize=64)
def ordinary(name: str, letters: tuple[float, ...]) -> Ordinary:
    q = shares(name, list(letters))
    m = len(q)
    y = np.arange(m) - (m - 1) / 2
    s2, s3, p, mean, v = (q**2).sum(), (q**3).sum(), q[y > 0].sum(), (q * y).sum(), (q * y * y).sum()
    up, r, even = np.array([1 - p, p]), 2 * p * (1 - p), (m * m - 1) / 12
    out = Ordinary(np.log(q * m).tolist(), [], [], [], [], [], [])
    for n in range(LEAST, EXACT + 1):
        # a tilt is the difference of the means of an even draw and of ordinary text over the larger variance
        pairs = 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)
        tilt = float(n * (n - 1) * (1 / m - s2) / max(pairs, 2 * n * (n - 1) / m * (1 - 1 / m)))
        out.chi.append(tilt)
        out.chi_mean.append(_squares_mean(q, n, tilt))
        turns = (n - 1) * r * (1 - r) + 2 * (n - 2) * (p * (1 - p) - r * r)
        tilt = float((n - 1) * (0.5 - r) / max(turns, (n - 1) / 4))
        out.runs.append(tilt)
        out.runs_mean.append(tilt + _chain_mean(np.exp(tilt * (1 - np.eye(2))) * up, up, n))
        products = (n - 1) * (v * v - mean**4) + 2 * (n - 2) * (mean * mean * v - mean**4)
        tilt = float(-(n - 1) * mean * mean / max(products, (n - 1) * even * even))
        out.serial.append(tilt)
        out.serial_mean.append(_chain_mean(np.exp(tilt * np.outer(y, y)) * q, q, n))
    return out


def _array(values: list[float]) -> Column:
    """A literal array, as one expression."""
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")


def _spans(text: Column, pattern: str) -> Column:
    """(start, end, found) of each leftmost non-overlapping match: what lies between matches is split out, and lengths are summed."""

    span = "array<struct<start:int,end:int,found:string>>"

    def length(found: Column, between: Column, i: Column) -> Column:
        return F.length(F.get(between, i)) + F.length(F.get(found, i))

    def within(found: Column, between: Column, first: Column, offset: Column) -> Column:
        """The spans of one group, which begins at `offset`."""

        def step(acc: Column, i: Column) -> Column:
            low = acc["at"] + F.length(F.get(between, i))
            high = low + F.length(F.get(found, i))
            return F.struct(high.alias("at"), F.concat(acc["out"], F.array(F.struct(low.alias("start"), high.alias("end"), F.get(found, i).alias("found")))).alias("out"))

        last = F.least(first + GROUP, F.size(found)) - 1
        return F.aggregate(F.sequence(first, last), F.struct(offset.alias("at"), F.array().cast(span).alias("out")), step, lambda acc: acc["out"])

    def placed(found: Column, between: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(found) - 1, F.lit(GROUP))
        total = lambda first: F.aggregate(F.sequence(first, F.least(first + GROUP, F.size(found)) - 1), F.lit(0), lambda acc, i: acc + length(found, between, i))
        # where each group begins; a group is copied GROUP times at most, however many matches there are
        offsets = F.aggregate(firsts, F.array(F.lit(0)), lambda acc, first: F.concat(acc, F.array(F.element_at(acc, -1) + total(first))))
        return bind(offsets, lambda o: F.flatten(F.transform(firsts, lambda first, g: within(found, between, first, F.get(o, g)))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(~text.rlike(pattern), F.array().cast(span)).otherwise(bind(found, lambda f: bind(F.split(text, pattern, -1), lambda g: placed(f, g))))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind."""
    value = lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= 8
    return {
        "assign": F.filter(_spans(text, ASSIGN), value),
        "access": F.filter(_spans(text, ACCESS), lambda s: F.length(s["found"]) >= 16),
        # runs of hexadecimal digits that are too short would be dropped, and are not looked at
        "hex": _spans(text, r"(?<![0-9a-f])[0-9a-f]{32,}+"),
    }


def encoding_of(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]+$"), "decimal").when(token.rlike("^[0-9a-f]+$"), "hex").when(token.rlike("^[0-9A-F]+$"), "HEX").when(token.rlike("^[A-Z2-7]+$"), "base32").when(token.rlike("[a-z]"), "base64").otherwise("BASE64")


def letter_counts(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Letters a to z of the corpus's long words, with LETTERS as so many more."""
    words = F.array_join(F.regexp_extract_all(text_of(text_col), F.lit(COUNTED), F.lit(0)), "")
    joined = docs.select(words.alias("w"))
    counts = joined.agg(*[F.sum(F.length("w") - F.length(F.replace("w", F.lit(chr(97 + i)), F.lit("")))).alias(f"n{i}") for i in range(26)]).first()
    return [float(n + (found or 0)) for n, found in zip(LETTERS, counts, strict=True)]


def battery(token: Column, letters: list[float]) -> Column:
    """struct(encoding, chi, runs, serial, evidence): the three tests in standard deviations, and ln of the e-value."""
    of = {name: ordinary(name, tuple(letters)) for name in ALPHABETS}

    def measured(encoding: Column) -> Column:
        def pick(value) -> Column:
            out = F.lit(None)
            for name in ALPHABETS:
                v = value(name)
                out = F.when(encoding == name, F.lit(v) if isinstance(v, str) else _array(v)).otherwise(out)
            return out

        known = F.struct(pick(ALPHABETS.get).alias("a"), *[pick(lambda n, k=k: getattr(of[n], k)).alias(k) for k in Ordinary._fields])
        return bind(known, lambda o: bind(F.transform(F.split(token, ""), lambda c: F.instr(o["a"], c) - 1), lambda x: tests(encoding, o, x)))

    def tests(encoding: Column, o: Column, x: Column) -> Column:
        n, m = F.size(x).cast("double"), F.length(o["a"]).cast("double")
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda acc, i: acc + F.pow((F.size(x) - F.size(F.array_remove(x, i))).cast("double"), F.lit(2.0)))
        inner = F.sequence(F.lit(1), F.size(x) - 1)
        upper = lambda i: F.get(x, i) >= (m / 2)
        runs = F.aggregate(inner, F.lit(1.0), lambda acc, i: acc + F.when(upper(i) != upper(i - 1), 1.0).otherwise(0.0))
        centred = lambda i: (F.get(x, i).cast("double") - (m - 1) / 2)
        product = F.aggregate(inner, F.lit(0.0), lambda acc, i: acc + centred(i) * centred(i - 1))
        logs = F.aggregate(x, F.lit(0.0), lambda acc, i: acc - F.get(o["logs"], i))
        found = F.struct(squares.alias("chi"), runs.alias("runs"), product.alias("serial"), logs.alias("counts"), F.size(x).alias("size"))
        return bind(found, lambda t: judged(encoding, o, n, m, t))

    def judged(encoding: Column, o: Column, n: Column, m: Column, t: Column) -> Column:
        df = m - 1
        chi = (F.pow((t["chi"] * m / n - n) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        runs = (t["runs"] - (n + 1) / 2) / F.sqrt((n - 1) / 4)
        serial = t["serial"] / ((m * m - 1) / 12) / F.sqrt(n - 1)
        at = t["size"] - LEAST
        tilted = [F.get(o[k], at) * t[k] - F.get(o[f"{k}_mean"], at) for k in ("chi", "runs", "serial")]  # null beyond EXACT
        parts = [t["counts"] + math.log(WEIGHTS[0]), *[F.coalesce(e, F.lit(-math.inf)) + math.log(w) for e, w in zip(tilted, WEIGHTS[1:], strict=True)]]
        evidence = bind(F.array(*parts), lambda e: F.array_max(e) + F.ln(F.aggregate(e, F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max(e)))))
        return F.struct(encoding.alias("encoding"), chi.alias("chi"), runs.alias("runs"), serial.alias("serial"), evidence.alias("evidence"))

    return bind(encoding_of(token), measured)


def scan(docs: DataFrame, letters: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (kind, start, end by start, then kind), tested (start, end, key, chi, runs, serial, evidence; key is a hash of the token): one row per input row."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    tried = lambda s: (F.length(s["found"]) >= PLAIN) | ~s["found"].rlike(WORDLIKE)
    found = rows.select("doc_id", *[s.alias(k) for k, s in base_spans(F.col("text")).items()], F.filter(_spans(F.col("text"), TOKEN), tried).alias("tokens"))

    def marked(number: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    tested = F.transform("tokens", lambda s: bind(battery(s["found"], letters), lambda t: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["found"]).alias("key"), t["chi"].alias("chi"), t["runs"].alias("runs"), t["serial"].alias("serial"), t["evidence"].alias("evidence"))))
    return found.select("doc_id", F.array_sort(F.concat(*[marked(n, k) for n, k in enumerate(KINDS[:3])])).alias("base"), tested.alias("tested"))


def passes(t: Column) -> Column:
    """No test of the battery speaks against an even draw."""
    return (t["chi"].between(-LIMIT, LIMIT)) & (F.abs(t["runs"]) <= LIMIT) & (F.abs(t["serial"]) <= LIMIT)


def threshold(scanned: DataFrame, rate: float = FALSE_DISCOVERIES) -> float:
    """The least evidence of a discovery: step-up over all distinct tested tokens, on a histogram of BINS + 1 rows."""
    bin_of = F.when(passes(F.col("t")), F.least(F.floor(F.greatest(F.col("t.evidence"), F.lit(0.0)) / BIN), F.lit(BINS))).otherwise(0).cast("int")
    tokens = scanned.select(F.explode("tested").alias("t")).select(F.col("t.key").alias("key"), bin_of.alias("bin")).distinct()
    bins = tokens.groupBy("bin").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("bin")))
    ranked = bins.select("bin", above.alias("found"), F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))
    ok = ranked.filter((F.col("bin") > 0) & (F.exp(-F.col("bin") * BIN) * F.col("m") <= rate * F.col("found"))).agg(F.min("bin")).first()[0]
    return math.inf if ok is None else ok * BIN


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, base, spans (start, order, kind, end; by start, then kind as listed): one row per input row."""
    scanned = checkpointed(scan(docs, letter_counts(docs, text_col), id_col, text_col))
    least = threshold(scanned, rate)
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    new = F.filter("tested", lambda t: passes(t) & (t["evidence"] >= F.lit(least)) & free(t))
    new = F.transform(new, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("order"), F.lit(KINDS[3]).alias("kind"), t["end"].alias("end")))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", new)).alias("spans"))
