"""SentencePiece (BPE) encoding and decoding, giant documents by a max-plus parallel scan.

A sequence of pieces is the BPE encoding of its text exactly if every two neighbours are: if encoding the
two joined gives the same two again. So encoding is a best path where a step from one piece to the next
weighs 0, or minus infinity if the two don't go together, and just one path has weight 0.

A document longer than GIANT is cut into chunks at any character. The states at a cut are the pieces that
may end on or span it. Each chunk yields the max-plus matrix from the states at its start to those at its
end; the matrices of a document are combined associatively, in runs of RUN neighbours, then runs of runs, each
group in a task of its own; from the top, each run is told its own two states; each chunk is then traced back alone
between its two states. No piece holds a space after another character, so such places need no states: there
inside chunks, and in documents that are one chunk, the library encodes.

Null and empty texts give no pieces. U+2581 is a space to the model, and decodes as one: a text that holds it doesn't
come back, and round_trip says so. Characters outside the vocabulary become bytes. Repeated rows and ids are encoded
each; other columns don't matter. The model file is read once on the driver and sent out (under 1 MB).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import checkpointed, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of a chunk, and of a document that is cut into chunks.
CHUNK, GIANT = 16_384, 32_768
#: Matrices that one task combines.
RUN = 64
#: Pairs of pieces that a worker remembers; no piece has more than a few characters.
CACHED = 100_000
MINUS = float("-inf")


#: The last piece at each place, and the pieces that end on or span the end.
Reached = tuple[dict[int, tuple[int, str]], dict[tuple[int, int], None]]


class Pieces:
    """The model's pieces, and exact encoding of short stretches between given states."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_proto=proto)
        n = m.get_piece_size()
        self.ids = {m.id_to_piece(i).replace("\u2581", " "): i for i in range(n) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i))}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        back = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.raw = [back.get(i, b"" if m.is_control(i) else m.id_to_piece(i).replace("\u2581", " ").encode()) for i in range(n)]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            at = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], MINUS), -i))
            if parts[at] + parts[at + 1] not in self.score:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str | None, right: str) -> bool:
        if left is None:
            return True
        if (left, right) not in self.pairs:
            if len(self.pairs) > CACHED:
                self.pairs.clear()
            self.pairs[left, right] = self.merged(left + right) == [left, right]
        return self.pairs[left, right]

    def is_piece(self, text: str) -> bool:
        if len(text) == 1:
            return True
        if text not in self.score:
            return False
        if text not in self.whole:
            self.whole[text] = self.merged(text) == [text]
        return self.whole[text]

    def id_list(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode("utf-8", "replace")]

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """(start, end) of every piece that may end on or span this place."""
        return [(i, j) for i in range(max(0, cut - self.longest), cut) for j in range(cut, min(len(text), i + self.longest) + 1) if self.is_piece(text[i:j])]

    def reach(self, text: str, before: str | None, at: int, upto: int, other: Reached | None = None) -> Reached:
        """From `at`, where the piece `before` ends: the last piece at each place as (start, piece), and the pieces that end on or span `upto`.

        `other` is what another start reached. Where both have had the same pieces for as long as a piece can be, they
        go on alike, and the ends of the other are returned.
        """
        last: dict[int, tuple[int, str]] = {at: (-1, before)} if before is not None else {at: (-1, "")}
        ends: dict[tuple[int, int], None] = {}
        alike = 0
        for p in range(at, upto):
            if other is not None:
                alike = alike + 1 if last.get(p) == other[0].get(p) else 0
                if alike > self.longest:
                    return last, other[1]
            if p not in last:
                continue
            piece = last[p][1] or None
            for q in range(p + 1, min(len(text), p + self.longest) + 1):
                nxt = text[p:q]
                if self.is_piece(nxt) and self.fits(piece, nxt):
                    if q < upto:
                        last[q] = (p, nxt)
                    else:
                        ends[p, q] = None
        return last, ends

    def trace(self, last: dict[int, tuple[int, str]], at: int, place: int) -> list[str]:
        out = []
        while place != at:
            place, piece = last[place]
            out.append(piece)
        return out[::-1]

    def words(self, text: str) -> list[int]:
        """Pieces of a stretch that starts with a space, before which no piece can span; the library adds that space itself."""
        return [self.ids[" "]] if text == " " else self.model.encode(text[1:])

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")


def _free(text: str, low: int, high: int) -> tuple[int | None, int | None]:
    """The first and the last place in low..high-1 that no piece can span."""
    places = [m.start() + 1 for m in re.finditer(r"[^ ](?= )", text[max(0, low - 1) : high])]
    places = [max(0, low - 1) + p for p in places if low <= max(0, low - 1) + p < high]
    return (places[0], places[-1]) if places else (None, None)


def transfer(pieces: Pieces, text: str, a: int, b: int, first: bool, last: bool) -> np.ndarray:
    """Max-plus matrix of the chunk text[a:b], which has enough context on both sides."""
    entries = [(None, 0)] if first else [(text[i:j], j) for i, j in pieces.states(text, a)]
    exits = {(-1, b): 0} if last else {x: n for n, x in enumerate(pieces.states(text, b))}
    out = np.full((len(entries), len(exits)), MINUS)
    c1, c2 = _free(text, a, b)
    tail = None
    if c2 is not None:
        ends = pieces.reach(text, None, c2, b)[1]
        tail = [exits[x] for x in _ends(ends, b, last) if x in exits]
    other: Reached | None = None
    for e, (piece, at) in enumerate(entries):
        if c1 is None:
            reached, ends = pieces.reach(text, piece, at, b, other)
            other = other or (reached, ends)
            found = [exits[x] for x in _ends(ends, b, last) if x in exits] or ([0] if last and at == b else [])
        else:
            found = tail if at == c1 or pieces.reach(text, piece, at, c1)[1] else []
        out[e, found] = 0.0
    return out


def _ends(ends: dict[tuple[int, int], None], b: int, last: bool) -> list[tuple[int, int]]:
    return ([(-1, b)] if any(q == b for _, q in ends) else []) if last else list(ends)


def backtrace(pieces: Pieces, text: str, a: int, b: int, first: bool, last: bool, entry: int, leave: int) -> tuple[list[int], str]:
    """The ids of the pieces that start in the chunk, given its states, and the text they cover."""
    piece, at = (None, 0) if first else (lambda x: (text[x[0] : x[1]], x[1]))(pieces.states(text, a)[entry])
    end = None if last else pieces.states(text, b)[leave]
    c1, c2 = _free(text, a, b)
    ids: list[int] = []

    def stretch(before: str | None, start: int, upto: int, through: tuple[int, int] | None) -> None:
        if start >= upto:
            return
        known, ends = pieces.reach(text, before, start, upto)
        p, q = through or next(x for x in ends if x[1] == upto)
        for x in [*pieces.trace(known, start, p), text[p:q]]:
            ids.extend(pieces.id_list(x))

    if c1 is None:
        stretch(piece, at, b, end)
    else:
        stretch(piece, at, c1, None)
        if c2 > c1:
            ids.extend(pieces.words(text[c1:c2]))
        stretch(None, c2, b, end)
    return ids, text[at : end[1] if end else b]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by halves."""
    if len(matrices) < 2:
        return matrices
    pairs = [product(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)]
    done = prefixes(pairs)
    return [matrices[0]] + [done[i // 2] if i % 2 else product(done[i // 2 - 1], matrices[i]) for i in range(1, len(matrices))]


def scan(matrices: list[np.ndarray], entry: int = 0, leave: int = 0) -> list[tuple[int, int]]:
    """(state at the start, state at the end) of each chunk on the best path between two states."""
    upto = prefixes(matrices)
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        first = entry if k == 0 else int(np.argmax(upto[k - 1][entry] + matrices[k][:, leave]))
        out.append((first, leave))
        leave = first
    return out[::-1]


_LOADED: dict[int, Pieces] = {}


def loaded(proto: bytes) -> Pieces:
    """Once in each worker."""
    key = hash(proto)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(proto)
    return _LOADED[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def clean(text: str) -> str:
    return " " + text.replace("\u2581", " ")


def cut(text: str, chunk: int, context: int) -> Iterator[tuple[int, int, str, int, int]]:
    """(number, of, text with context, start, end) of each chunk."""
    n = max(1, -(-len(text) // chunk))
    for k in range(n):
        low, high = max(0, k * chunk - context), min(len(text), (k + 1) * chunk + context)
        yield k, n, text[low:high], k * chunk - low, min(len(text), (k + 1) * chunk) - low


MATRIX = "row long, k int, width int, cells array<double>"


def _frame(row, k, got: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"row": row, "k": k, "width": [m.shape[1] for m in got], "cells": [m.ravel() for m in got]})


def _arrays(group: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(c, dtype=float).reshape(-1, w) for c, w in zip(group["cells"], group["width"], strict=True)]


def chunk_states(matrices: DataFrame, most: int, run: int = RUN) -> DataFrame:
    """row, k, entry, leave: the states of each chunk on its document's best path; `most` is the most chunks of a document.

    Groups of `run` neighbours are multiplied until each document has one group left, and then told their states from there down.
    """

    def multiplied(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        return _frame(group["row"].iloc[:1].to_numpy(), group["k"].iloc[:1].to_numpy() // run, [prefixes(_arrays(group))[-1]])

    def told(group: pd.DataFrame, entry: int, leave: int) -> pd.DataFrame:
        group = group.sort_values("k")
        states = scan(_arrays(group), entry, leave)
        return pd.DataFrame({"row": group["row"].to_numpy(), "k": group["k"].to_numpy(), "entry": [s for s, _ in states], "leave": [t for _, t in states]})

    def top(group: pd.DataFrame) -> pd.DataFrame:
        return told(group, 0, 0)

    def below(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        return told(group, int(above["entry"].iloc[0]), int(above["leave"].iloc[0]))

    levels, held = [], most
    while held > run:
        matrices = checkpointed(matrices)  # read on the way up and on the way down
        levels.append(matrices)
        matrices = matrices.groupBy("row", F.floor(F.col("k") / run).alias("up")).applyInPandas(multiplied, MATRIX)
        held = -(-held // run)
    schema = "row long, k int, entry int, leave int"
    states = matrices.groupBy("row").applyInPandas(top, schema)
    for matrices in levels[::-1]:
        up = F.floor(F.col("k") / run).cast("int").alias("up")
        states = matrices.withColumn("up", up).groupBy("row", "up").cogroup(states.groupBy("row", "k")).applyInPandas(below, schema)
    return states


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK, giant: int = GIANT) -> DataFrame:
    """doc_id, ids, round_trip: one row per input row; round_trip tells that decoding gives the text again."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_model(model))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    large = F.coalesce(F.length("text") > giant, F.lit(False))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(sent.value)
        for b in slices(batches):
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            ids = pieces.model.encode(texts, num_threads=1)
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [np.array(i, dtype=np.int32) for i in ids], "round_trip": [pieces.decode(i) == (" " + t if t else t) for i, t in zip(ids, texts, strict=True)]})

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = loaded(sent.value).longest
        for b in batches:
            for row, doc, text in zip(b["row"], b["doc_id"], b["text"], strict=True):
                for k, n, piece, low, high in cut(clean(text), chunk, context):
                    yield pd.DataFrame({"row": [row], "doc_id": [doc], "k": [k], "n": [n], "text": [piece], "a": [low], "b": [high], "plain": ["\u2581" not in text]})

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(sent.value)
        for b in slices(batches):
            yield _frame(b["row"], b["k"], [transfer(pieces, r.text, r.a, r.b, r.k == 0, r.k == r.n - 1) for r in b.itertuples()])

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = loaded(sent.value)
        for b in slices(batches):
            got = [backtrace(pieces, r.text, r.a, r.b, r.k == 0, r.k == r.n - 1, r.entry, r.leave) for r in b.itertuples()]
            yield pd.DataFrame({"row": b["row"], "doc_id": b["doc_id"], "k": b["k"], "part": [np.array(i, dtype=np.int32) for i, _ in got], "ok": [plain and pieces.decode(i) == t for plain, (i, t) in zip(b["plain"], got, strict=True)]})

    small = rows.filter(~large).mapInPandas(whole, f"doc_id {id_type}, ids array<int>, round_trip boolean")
    numbered = rows.filter(large).withColumn("row", F.monotonically_increasing_id())
    cut_up = checkpointed(numbered.select("row", "doc_id", "text").mapInPandas(chunks, f"row long, doc_id {id_type}, k int, n int, text string, a int, b int, plain boolean").repartition("row", "k"))
    states = chunk_states(cut_up.mapInPandas(matrices, MATRIX), cut_up.agg(F.max("n")).first()[0] or 0)
    parts = cut_up.join(states, ["row", "k"]).mapInPandas(traced, f"row long, doc_id {id_type}, k int, part array<int>, ok boolean")
    joined = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts"), F.min("ok").alias("round_trip"))
    return small.unionByName(joined.select("doc_id", F.flatten(F.transform("parts", lambda x: x["part"])).alias("ids"), "round_trip"))


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """The input with the decoded text added; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_model(model))

    @F.pandas_udf(T.StringType())
    def to_text(ids: pd.Series) -> pd.Series:
        pieces = loaded(sent.value)
        return ids.map(lambda x: None if x is None else pieces.decode(x).removeprefix(" "))

    return encoded.withColumn(text_col, to_text(F.col(ids_col)))
