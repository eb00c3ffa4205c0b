r"""Chat formatting with a loss mask aligned by offsets.

A conversation is rendered whole and encoded once; the lengths of its tokens in bytes give their offsets. The sorted
spans of its assistant turns are met with the sorted spans of its tokens by binary search.

Template, for each turn: `<|turn|>` role `<|text|>` text `<|end|>`. Inside roles and texts every `\`, `<`, `[` and `|`
gets a `\` before it, so no text can hold a mark, and reading back is exact. The three marks are control tokens with
ids of their own after the vocabulary's, as is usual for chat templates. So no token joins a mark and a text: the
tokens under the mask are the assistant texts, whole and nothing else.

Turns go by turn (null first), then role, then text; other nulls are empty. Repeated rows are turns of their own. A
conversation is one row of the result and so one unit of work; a null conv_id is a conversation too. Other columns
don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices

#: The vocabulary as ranks, and the same as a description of a tokenizer, for texts that the faster library refuses.
RANKS, TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_50k.json"
# The pattern by which this vocabulary's texts are split.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"
ESCAPED = re.compile(r"[\\<\[|]")
BODY = r"([^\\<]*(?:\\.[^\\<]*)*)"
TURNS = re.compile(re.escape(TURN) + BODY + re.escape(TEXT) + BODY + re.escape(END), re.DOTALL)
Span = tuple[int, int]


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(roles: list[str], texts: list[str]) -> tuple[str, list[Span]]:
    """The formatted conversation, and where the texts of trained turns lie in it, in bytes."""
    out, spans, at = [], [], 0
    for role, text in zip(roles, texts, strict=True):
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        low = at + len(head.encode("utf-8", "replace"))
        high = low + len(body.encode("utf-8", "replace"))
        if role == TRAINED_ROLE:
            spans.append((low, high))
        out += [head, body, END]
        at = high + len(END)
    return "".join(out), spans


def align(spans: list[Span], ends: np.ndarray) -> tuple[np.ndarray, list[Span]]:
    """Which tokens, given by the places where they end, lie wholly inside a span; and the stretches that these cover."""
    mask, covered = np.zeros(len(ends), dtype=bool), []
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for low, high in spans:
        i, j = np.searchsorted(starts, low, side="left"), np.searchsorted(ends, high, side="right")
        if i < j:
            mask[i:j] = True
            covered.append((int(starts[i]), int(ends[j - 1])))
    return mask, covered


class Encoder:
    """Ids of a formatted text, and the length in bytes of every id."""

    def __init__(self, ranks: bytes, description: str):
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        first = max(known.values()) + 2  # the vocabulary keeps one id for the end of a text
        self.special = {m: first + i for i, m in enumerate(MARKS)}
        self.lengths = np.zeros(first + len(MARKS), dtype=np.int64)
        for token, rank in known.items():
            self.lengths[rank] = len(token)
        for m, i in self.special.items():
            self.lengths[i] = len(m)
        self.encoding = tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=known, special_tokens=self.special)
        self.description, self.slow = description, None

    def ids(self, text: str) -> list[int]:
        try:
            return self.encoding.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:  # runs of white space that are too long for its patterns
            return self.slow_ids(text)

    def slow_ids(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        if self.slow is None:
            self.slow = Tokenizer.from_str(self.description)
            self.slow.encode_special_tokens = True
        out: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, MARKS)) + ")", text):
            out += [self.special[part]] if part in self.special else self.slow.encode(part, add_special_tokens=False).ids
        return out


_LOADED: dict[int, Encoder] = {}


def loaded(ranks: bytes, description: str) -> Encoder:
    """Once in each worker."""
    key = hash((ranks, description))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(ranks, description)
    return _LOADED[key]


def code_points(text: str, spans: list[Span]) -> list[Span]:
    """Spans of bytes as spans of code points."""
    if text.isascii() or not spans:
        return spans
    heads = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8) & 0xC0 != 0x80
    before = np.concatenate([[0], np.cumsum(heads)])
    return [(int(before[s]), int(before[e])) for s, e in spans]


def format_conversations(rows: DataFrame, ranks: str = RANKS, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, formatted, ids, loss_mask (by token), loss_spans (by code point): one row per conversation."""
    with open(ranks, "rb") as f, open(tokenizer, encoding="utf-8") as g:
        sent = rows.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = F.sort_array(F.collect_list(F.struct("turn", empty("role").alias("role"), empty("text").alias("text"))))
    whole = rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.transform("turns", lambda x: x["role"]).alias("roles"), F.transform("turns", lambda x: x["text"]).alias("texts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = loaded(*sent.value)
        for b in slices(batches, "texts"):
            rendered = [render(list(r), list(x)) for r, x in zip(b["roles"], b["texts"], strict=True)]
            ids = [np.array(encoder.ids(text), dtype=np.int32) for text, _ in rendered]
            met = [align(spans, np.cumsum(encoder.lengths[i])) for (_, spans), i in zip(rendered, ids, strict=True)]
            loss = [[{"start": s, "end": e} for s, e in code_points(text, covered)] for (text, _), (_, covered) in zip(rendered, met, strict=True)]
            yield pd.DataFrame({"conv_id": b["conv_id"], "formatted": [x for x, _ in rendered], "ids": ids, "loss_mask": [m for m, _ in met], "loss_spans": loss})

    id_type = rows.schema["conv_id"].dataType.simpleString()
    return whole.mapInPandas(run, f"conv_id {id_type}, formatted string, ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURNS.finditer(formatted)]


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the formatted texts and masks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turns = [read_back(t) for t in b["formatted"]]
            loss = [unescape("".join(t[s["start"] : s["end"]] for s in spans)) for t, spans in zip(b["formatted"], b["loss_spans"], strict=True)]
            yield pd.DataFrame(
                {
                    "conv_id": b["conv_id"],
                    "n_turns": [len(t) for t in turns],
                    "turns_sha256": [hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode("utf-8", "replace")).hexdigest() for t in turns],
                    "loss_chars": [len(x) for x in loss],
                    "loss_sha256": [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in loss],
                    "formatted_chars": [len(t) for t in b["formatted"]],
                }
            )

    id_type = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInPandas(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
