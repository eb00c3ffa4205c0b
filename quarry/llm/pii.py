"""Personal data: candidate spans scored by boosted trees on top of fixed base patterns.

The base spans (email, ip, card, phone) always stand. High-recall generators propose further, overlapping
spans; trees see their format and context; those above the threshold of their kind, which is calibrated on
held-out cases for precision, are added where they meet no base span.

The trees learn from the labelled table of piicases, where a value's label follows from what it is (a phone number, an
ISBN, an invoice, ...), and from the corpus, from at most SAMPLE distinct cases: the values of base spans in looser forms,
after words that announce them (positive), or spoilt or after words that announce something else (negative). Candidates of
the corpus themselves may be personal data in a form that the base patterns don't know, and are not labelled.
No label is worked out of features. Equal cases are one, with a count; distinct ones are taken in the order of a hash, as
many of each kind and label. Those taken weigh as often as they occur, and for those of their kind and label that aren't;
the corpus's cases of a kind and label weigh together as much as the table's, whatever their number.

Null texts count as empty. Each row is judged alone and whole, repeated ones too; offsets are code points. An empty corpus
leaves the table to learn from. Other columns don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import piicases
from quarry.llm.boost import Boosted
from quarry.llm.common import checkpointed, slices
from quarry.llm.piicases import luhn

KINDS = ("email", "ip", "card", "phone")
#: The bound of the labelled sample (of distinct cases), and the precision that thresholds are calibrated for.
SAMPLE, PRECISION = 20_000, 0.995
HASHES = 2**56 - 1
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[(\[ ]at[)\] ]")
# Generators: digits with any usual separators, four dotted numbers, and addresses with the signs spelt out.
DIGITS = re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,24}")
DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,4}+(?: ?\. ?[0-9]{1,4}+){3}(?![0-9])")
SPELT = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+ ?[(\[ ]at[)\] ] ?[A-Za-z0-9-]{2,63}+ ?[(\[ ]dot[)\] ] ?[A-Za-z]{2,10}\b")
# Formats that trees may look at: dates, and numbers that issuers of cards give out.
DATE = re.compile(r"(?:1[0-9]|20)[0-9]{2}(?P<a>[ .\-/])[01]?[0-9](?P=a)[0-3]?[0-9](?: [0-2]?[0-9](?:[.\-][0-9]{2})*)?|[0-3]?[0-9](?P<b>[ .\-/])[0-3]?[0-9](?P=b)(?:1[0-9]|20)[0-9]{2}|(?:1[0-9]|20)[0-9]{2}(?: ?[ \-/] ?(?:1[0-9]|20)[0-9]{2})+")
ISSUED = re.compile(r"[0-9]{16,19}|3[47][0-9]{13}|3[0689][0-9]{12}|4[0-9]{12}")
# Words that announce a value of a kind, and those that announce another number: their beginnings, or all of them up to three letters.
HINTS = {
    "email": ("mail", "contact", "correo", "schreib", "écri", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "carte", "karte", "tarjeta", "credit", "master", "amex"),
    "phone": ("tel", "telefon", "teleph", "téléph", "teléf", "phone", "call", "fax", "mobile", "ring", "ruf", "anruf", "appel", "handy"),
}
OTHER = (
    "isbn", "book", "imei", "device", "handset", "parcel", "track", "shipment", "package", "invoice", "rechnung", "factur", "bill", "order", "bestell", "command", "pedido", "coordin", "position", "lat", "lon",
    "ratio", "score", "id", "ref", "case", "ticket", "serial", "number", "cost", "total", "price", "population", "version", "release", "build", "page", "between", "from", "since", "until", "dated", "year",
    "account", "contract", "policy", "kunde", "chapter", "section", "paragraph", "item", "timestamp", "epoch", "log", "tick", "article", "part", "model", "code",
)
FUNCTION = frozenset("a an the this that these those each every any some one its his her their our my your on of and or at as was were with from which over above below between in to is".split())
UNIT = re.compile(r" ?(?:[€$£%]|(?:km|kg|m|cm|mm|euros?|dollars?|people|times|years|percent)\b)")
WORDS = re.compile(r"[^\W\d_]+")
#: Characters before a candidate that are looked at, and the distance of a word that isn't there.
CONTEXT, FAR = 40, 9.0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    if not ANY.search(text):
        return out
    out += [("email", s, e) for s, e in _emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """High-recall proposals, overlapping ones too."""
    out: list[tuple[str, int, int]] = []
    if not ANY.search(text):
        return out
    for m in DIGITS.finditer(text):
        n = len(only_digits(m[0]))
        out += [("phone", *m.span())] if n <= 15 else []
        out += [("card", *m.span())] if 12 <= n <= 19 else []
    out += [("ip", *m.span()) for m in DOTTED.finditer(text)]
    out += [("email", *m.span()) for m in SPELT.finditer(text)]
    out += [("email", s, e) for s, e in _emails(text)]
    return out


def _distance(words: list[str], cues: tuple[str, ...]) -> float:
    """How many words lie between the nearest cue and the candidate."""
    return next((float(i) for i, w in enumerate(words) if any(w == c or (len(c) > 3 and w.startswith(c)) for c in cues)), FAR)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and, in the last five, context of a candidate."""
    span, digits = text[start:end], only_digits(text[start:end])
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 16]
    parts = re.findall(r"[0-9]+", span)
    first = int(parts[0][:9]) if parts else 0
    said = WORDS.findall(span) if kind == "email" else []
    line = before.rpartition("\n")[2]
    if start > CONTEXT and len(line) == CONTEXT:
        line = re.sub(r"^[^\W\d_]+", "", line)  # a word that the window may cut
    words = [w.lower() for w in WORDS.findall(line)][::-1]  # the nearest first
    return [
        float(KINDS.index(kind)), len(span), len(digits), len(digits) / max(1, len(span)), len(parts), max(map(len, parts), default=0), min(map(len, parts), default=0),
        float(span.startswith("+")), float("(" in span and ")" in span), span.count("-"), span.count(" "), span.count("."), span.count("/"), float("@" in span),
        float(bool(digits) and luhn(digits)), float(max((int(p[-9:]) for p in parts), default=0) <= 255), len(set(digits)), float(digits.startswith("0")),
        len(parts[0]) if parts else 0, len(parts[-1]) if parts else 0, float(1000 <= first < 2100), float(DATE.fullmatch(span) is not None), float(ISSUED.fullmatch(digits) is not None),
        float(re.search(r"[(\[]", span) is not None), float(any(w.lower() in FUNCTION for w in said[-3:-2] + said[-1:])),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), _distance(words, HINTS[kind]), _distance(words, OTHER), float(UNIT.match(after) is not None),
    ]


def _variants(text: str, kind: str, start: int, end: int) -> Iterator[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): a base span in looser forms after a word that announces it, and spoilt or after another word."""
    left, right, value = text[max(0, start - CONTEXT) : start], text[end : end + 16], text[start:end]

    def at(new: str, label: int, hint: str = "") -> tuple[str, str, int, int, int]:
        head = left + hint
        return head + new + right, kind, len(head), len(head) + len(new), label

    if kind == "phone":
        short = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", value)
        if len(only_digits(short)) >= 7:
            for form in {short, ".".join(re.findall("[0-9]+", short))}:
                yield at(form, 1, "tel ")
            yield at(".".join(re.findall("[0-9]+", short)), 0, "parcel ")
            yield at(only_digits(short), 0, "invoice ")
    elif kind == "card":
        digits = only_digits(value)
        yield at(".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), 1)
        yield at(digits[:-1] + str((int(digits[-1]) + 1) % 10), 0)
    elif kind == "ip":
        parts = value.split(".")
        yield at(" . ".join(parts), 1, "ip ")
        yield at(".".join([*parts[:3], "700"]), 0)
    else:
        name, _, host = value.partition("@")
        if "." in host:
            yield at(f"{name} at {host.rpartition('.')[0].replace('.', '-')} dot {host.rpartition('.')[2]}", 1)
            yield at(f"{name} at the dot {host.rpartition('.')[2]}", 0)


class Stretches:
    """Disjoint stretches of a text in order, so that what meets them is found by bisection."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted((s, e) for _, s, e in spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meet(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.ends) and self.starts[i] < end

    def add(self, start: int, end: int) -> None:
        """A stretch that meets none."""
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def labelled(text: str) -> Iterator[tuple[list[float], int]]:
    """Cases to learn from in a text of the corpus."""
    for span in base_spans(text):
        for other, kind, start, end, label in _variants(text, *span):
            yield features(other, kind, start, end), label


def taught(table: tuple[piicases.Group, ...] = piicases.TABLE) -> list[tuple[list[float], int]]:
    """Cases of the labelled table: what the generators propose about each value, right where kind and span are the value's."""
    out = []
    for text, kind, start, end in piicases.cases(table):
        for c in dict.fromkeys(candidates(text)):
            if kind is None or c[0] != kind:
                out.append((features(text, *c), 0))
            elif c == (kind, start, end):
                out.append((features(text, *c), 1))
    return out


class Detector:
    """Trees and the threshold of each kind."""

    def __init__(self, cases: list[tuple[list[float], int, int, float]]):
        """Of cases: features, label, how often they occur, and how many of their kind and label each occurrence stands for."""
        self.model: Boosted | None = None
        self.least = dict.fromkeys(KINDS, 2.0)  # above any score: nothing is added
        if len({label for _, label, _, _ in cases}) < 2:
            return
        x, y = np.array([f for f, _, _, _ in cases], dtype=float), np.array([label for _, label, _, _ in cases], dtype=float)
        count, scale = np.array([n for _, _, n, _ in cases], dtype=np.int64), np.array([w for _, _, _, w in cases], dtype=float)
        later = (count + np.arange(len(y)) % 4) // 4  # a quarter of the occurrences is held out, not of the distinct cases
        learned, held = count > later, later > 0
        if len(set(y[learned])) < 2:
            return
        self.model = Boosted().fit(x[learned], y[learned], ((count - later) * scale)[learned])
        if not held.any():
            return
        score = self.model.predict(x[held])
        for k, kind in enumerate(KINDS):
            mine = x[held][:, 0] == k
            order = np.argsort(-score[mine], kind="stable")
            label, weight, ranked = y[held][mine][order], (later * scale)[held][mine][order], score[mine][order]
            right, every = np.cumsum(label * weight), np.cumsum(weight)
            last = np.append(ranked[1:] < ranked[:-1], True)[: len(ranked)]  # cases of one score stand or fall together
            good = np.flatnonzero(last & (right >= PRECISION * every))
            if len(good):
                below = np.append(ranked, 0.0)[good[-1] + 1]  # midway to the next case, as forms that nobody labelled lie between
                self.least[kind] = max(0.5, float(ranked[good[-1]] + below) / 2)

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """The best of the candidates above their thresholds that meet no base span or better candidate."""
        taken = Stretches(base)
        if self.model is None or not (found := [c for c in dict.fromkeys(candidates(text)) if not taken.meet(*c[1:])]):
            return []
        scores = self.model.predict(np.array([features(text, *c) for c in found], dtype=float))
        out: list[tuple[str, int, int]] = []
        for score, c in sorted(zip(scores, found, strict=True), key=lambda x: (-x[0], x[1])):
            if score >= self.least[c[0]] and not taken.meet(*c[1:]):
                taken.add(*c[1:])
                out.append(c)
        return out


def _texts(batch: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in batch]


def sampled(docs: DataFrame, text_col: str = "text", most: int = SAMPLE) -> list[tuple[list[float], int, int, float]]:
    """At most `most` distinct cases of the corpus, as many of each kind and label: what Detector takes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cases = Counter((tuple(x), y) for t in _texts(b["text"]) for x, y in labelled(t))
            yield pd.DataFrame({"x": pd.Series([list(x) for x, _ in cases], dtype=object), "y": pd.Series([y for _, y in cases], dtype="int32"), "n": pd.Series(list(cases.values()), dtype="int64")})

    found = docs.filter(F.col(text_col).rlike(ANY.pattern)).select(F.col(text_col).alias("text")).mapInPandas(run, "x array<double>, y int, n long")
    # the hash is of the features alone, so that a case with both labels tends to be taken with both
    cases = checkpointed(found.groupBy("x", "y").agg(F.sum("n").alias("n")).select(F.col("x")[0].cast("int").alias("kind"), "x", "y", "n", F.xxhash64("x").bitwiseAND(F.lit(HASHES)).alias("h")))
    groups = {(r["kind"], r["y"]): r for r in cases.groupBy("kind", "y").agg(F.count("*").alias("distinct"), F.sum("n").alias("n")).collect()}
    share, taken = most // (2 * len(KINDS)), F.lit(False)
    for (kind, y), r in groups.items():
        below = HASHES if r["distinct"] <= share else int(HASHES * (0.95 * share / r["distinct"]))  # so about 0.95 * share rows come to the driver
        taken |= (F.col("kind") == kind) & (F.col("y") == y) & (F.col("h") <= below)
    picked = cases.filter(taken).orderBy("h", "y", "x").collect()
    of: Counter = Counter()
    for r in picked:
        of[r["kind"], r["y"]] += r["n"]
    return [(list(r["x"]), r["y"], r["n"], groups[r["kind"], r["y"]]["n"] / of[r["kind"], r["y"]]) for r in picked]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, table: tuple[piicases.Group, ...] = piicases.TABLE) -> Detector:
    """A detector from the labelled table and at most `most` distinct cases of the corpus."""
    known = [(x, y, 1, 1.0) for x, y in taught(table)]
    own, found = Counter((x[0], y) for x, y, _, _ in known), sampled(docs, text_col, most)
    total: Counter = Counter()
    for x, y, n, w in found:
        total[x[0], y] += n * w
    return Detector(known + [(x, y, n, w * max(1, own[x[0], y]) / total[x[0], y]) for x, y, n, w in found])


def find(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end, by kind as listed, then start): one row per input row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(detector)
    id_type = docs.schema[id_col].dataType.simpleString()
    rank = {k: i for i, k in enumerate(KINDS)}

    def rows(spans: list[tuple[str, int, int]]) -> list[dict]:
        return [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=lambda x: (rank[x[0]], x[1], x[2]))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            texts = _texts(b["text"])
            base = [base_spans(t) for t in texts]
            yield pd.DataFrame({"doc_id": b["doc_id"], "base": [rows(s) for s in base], "spans": [rows(s + sent.value.added(t, s)) for t, s in zip(texts, base, strict=True)]})

    span = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {id_type}, base {span}, spans {span}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the name of its first kind."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced, with the columns of docs; null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(detector)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not isinstance(t, str):
                return None
            base = base_spans(t)
            return redact(t, base + sent.value.added(t, base))

        return texts.map(one)

    # texts without a digit or a sign of an address hold nothing to find, and stay on the JVM
    return docs.withColumn(text_col, F.when(F.col(text_col).rlike(r"[0-9@]|[(\[ ]at[)\] ]"), run(F.col(text_col))).otherwise(F.col(text_col)))
