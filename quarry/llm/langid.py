"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text. A text is parsed from left
to right into longest phrases that occur in the sample; the fewer phrases, the better the language
explains it. Phrases are normalised by letters and by the logarithm of the sample's length.

The automaton is stored as one table that gives, for a state and a character, the next state and the
number of phrases ended. It has full columns for the commonest characters of the language's own sample; the ways on
of its other characters are kept in a sorted list, so every character of a sample counts, in any script. Texts are cut
into blocks that are walked side by side in numpy, each as if a phrase began there. Blocks whose forerunner then ends
elsewhere are walked again from its state, until they meet their first way; so phrases run on over blocks, and the
result is that of one walk from the text's first to its last character. Digits and signs below U+0100 are left out.

Null texts and texts without a letter get `und` with score 0, as do all when nothing is labelled. Ties go to the first
language by name. Repeated rows are judged each; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import HELD

UNKNOWN = "und"
#: The bound of the labelled sample: texts a language, and characters of a text. Longer texts give a stretch of so many,
#: texts shorter than the least come last.
SAMPLE_TEXTS, SAMPLE_LEAST, SAMPLE_MOST = 40, 100, 1500
#: Rounds in which all blocks that began wrong are walked again at once; after these, one block of each text a round.
ROUNDS = 8
#: Columns of a language's table: its commonest characters, and one for those that its sample lacks. Block length.
ALPHABET, BLOCK = 48, 256


def sample(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS) -> list[tuple[str, str]]:
    """(language, text) of at most `texts` labelled texts a language, in the order of a hash; copies of a row are one.

    Labelled rows are counted first. Then only hashes below a bound are gathered, some four times as many as needed.
    """
    text, h = F.col(text_col), F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 62) - 1))
    start = F.pmod(h, F.greatest(F.length(text) - SAMPLE_MOST, F.lit(0)) + 1).cast("int") + 1  # a stretch from anywhere
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & (F.length(text) > 0))
    rows = rows.select(F.col(lang_col).alias("lang"), (F.length(text) < SAMPLE_LEAST).alias("short"), h.alias("h"), F.substring(text, start, F.lit(SAMPLE_MOST)).alias("text"))
    counts = {(r["lang"], r["short"]): r["count"] for r in rows.groupBy("lang", "short").count().collect()}  # two rows a language
    below = F.lit(False)
    for (lang, short), n in counts.items():
        if not short or counts.get((lang, False), 0) < 4 * texts:
            bound = (1 << 62) if n <= 4 * texts else int((1 << 62) * (4 * texts / n))
            below |= (F.col("lang") == lang) & (F.col("short") == short) & (F.col("h") < bound)
    found = rows.filter(below).groupBy("lang", "short", "h").agg(F.min("text").alias("text")).collect()
    taken: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["short"], r["h"])):
        if len(mine := taken.setdefault(r["lang"], [])) < texts:
            mine.append(r["text"])
    return sorted((lang, t) for lang, mine in taken.items() for t in mine)


class Table(NamedTuple):
    """dense[state * ALPHABET + column], and values by sorted keys (state * width + column) of the other columns, each 4 * next state + phrases ended."""

    column: np.ndarray  # of each class; 0 for those the sample lacks, which match nothing
    dense: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    first: np.ndarray  # of each column: the value in the first state


def letters(text: str) -> str:
    """Without signs and digits; marks are parts of letters."""
    return "".join(c for c in text if c.isspace() or (c.isalnum() and not c.isdecimal()) or unicodedata.category(c)[0] == "M")


def plain(text: str) -> str:
    return " ".join(text.lower().split())


@lru_cache(maxsize=1)
def automata(labelled: tuple[tuple[str, str], ...]) -> tuple[list[str], dict[str, int], list[tuple[Table, float]]]:
    """(languages, class of each character, [(table, log2 of the sample's length)]). Built once in each worker."""
    joined: dict[str, str] = {}
    for lang, text in labelled:
        joined[lang] = joined.get(lang, "") + plain(letters(text)) + "\n"  # no text has \n now, so no phrase spans two
    classes = {c: k + 1 for k, c in enumerate(sorted(set().union(*joined.values()) - {"\n"}))}
    return sorted(joined), classes, [(_table(joined[x], classes), float(np.log2(max(2, len(joined[x]))))) for x in sorted(joined)]


def _table(text: str, classes: dict[str, int]) -> Table:
    counts = Counter(text)
    del counts["\n"]
    columns = {c: k + 1 for k, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
    column = np.zeros(len(classes) + 1, dtype=np.int32)
    for c, k in columns.items():
        column[classes[c]] = k
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        k = columns.get(c, 0)  # 0 parts the texts; it is left out of the table
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and k not in step[p]:
            step[p][k] = new
            p = link[p]
        if p != -1:
            q = step[p][k]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(k) == q:
                    step[p][k] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    width = max(ALPHABET, len(columns) + 1)
    first = np.full(width, 1, dtype=np.int32)  # an unknown character is a phrase of its own
    for k, s in step[0].items():
        if k:
            first[k] = 4 * s
    dense = np.zeros((len(step), ALPHABET), dtype=np.int32)
    dense[:] = first[:ALPHABET] + 1  # else the phrase ends, and the next begins here
    dense[0] = first[:ALPHABET]
    others: dict[int, int] = {}
    for s, outs in enumerate(step):
        for k, t in outs.items():
            if k >= ALPHABET:
                others[s * width + k] = 4 * t
            elif k:
                dense[s, k] = 4 * t
    keys = np.array(sorted(others), dtype=np.int64)
    return Table(column, dense.ravel(), keys, np.array([others[k] for k in keys.tolist()], dtype=np.int32), first)


def _next(table: Table, state: np.ndarray, column: np.ndarray, others: bool) -> np.ndarray:
    if not others:
        return table.dense[state * ALPHABET + column]
    rare = column >= ALPHABET
    got = table.dense[state * ALPHABET + np.where(rare, 0, column)]
    keys = state[rare].astype(np.int64) * len(table.first) + column[rare]
    at = np.minimum(np.searchsorted(table.keys, keys), len(table.keys) - 1)
    got[rare] = np.where(table.keys[at] == keys, table.values[at], table.first[column[rare]] + 1)  # the first state knows all
    return got


def _codes(text: str, classes: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    codes = classes[np.minimum(points, len(classes) - 1)]
    return codes[codes >= 0]


def phrases(texts: list[str], classes: dict[str, int], tables: list[Table]) -> np.ndarray:
    """Phrases by text and language."""
    width = max([ord(c) for c in classes], default=0) + 2
    known = np.zeros(max(width, 257), dtype=np.int32)
    known[[c for c in range(256) if not chr(c).isalpha() and c != 32]] = -1  # digits and signs tell nothing
    for c, k in classes.items():
        known[ord(c)] = k
    pieces, owner, number = [], [], []
    for i, t in enumerate(texts):
        codes = _codes(t, known)
        n = -(-len(codes) // BLOCK)
        if n:
            pieces.append(np.pad(codes, (0, n * BLOCK - len(codes)), constant_values=-1).reshape(n, BLOCK))
            owner += [i] * n
            number += range(n)
    total = np.zeros((len(texts), len(tables)), dtype=np.int64)
    if not pieces:
        return total
    blocks, owners, numbers = np.concatenate(pieces), np.array(owner), np.array(number)
    sizes = (blocks >= 0).sum(axis=1)
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    before = np.where(numbers > 0, place[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]  # the block that a block goes on from
    blocks, owners, sizes = np.ascontiguousarray(blocks[order].T), owners[order], sizes[order]
    ends = np.ones(len(order), dtype=bool)
    ends[before[before >= 0]] = False
    live = np.searchsorted(-sizes, -np.arange(BLOCK), side="left")  # blocks longer than each offset
    np.maximum(blocks, 0, out=blocks)
    for column, table in enumerate(tables):
        mine = table.column[blocks]
        others = (mine >= ALPHABET).any(axis=1) if len(table.keys) else np.zeros(BLOCK, dtype=bool)
        way = np.zeros_like(blocks)  # by offset and block: 4 * state + phrases ended
        state = np.zeros(len(owners), dtype=np.int32)
        for at in range(BLOCK):
            m = live[at]
            if not m:
                break
            way[at, :m] = _next(table, state[:m], mine[at, :m], others[at])
            state[:m] = way[at, :m] >> 2
        _mend(table, way, mine, others, sizes, before, owners)
        count = (way & 3).sum(axis=0)
        count += ends & (way[sizes - 1, np.arange(len(sizes))] >> 2 > 0)  # the phrase that the text's end ends
        np.add.at(total[:, column], owners, count)
    return total


def _mend(table: Table, way: np.ndarray, mine: np.ndarray, others: np.ndarray, sizes: np.ndarray, before: np.ndarray, owners: np.ndarray) -> None:
    """Walk blocks again whose forerunner ends in another state than they began in, up to where they meet their old way."""
    began, lane = np.zeros(len(sizes), dtype=np.int32), np.arange(len(sizes))
    turn = 0
    while True:
        ended = way[sizes - 1, lane] >> 2
        state = np.where(before >= 0, ended[before], 0)
        todo = np.flatnonzero(state != began)
        if not len(todo):
            return
        if turn >= ROUNDS:  # ways that don't meet for long: only the first wrong block of each text, whose forerunner is right
            todo = todo[np.unique(owners[todo], return_index=True)[1]]  # blocks of a text stand in order here
        turn += 1
        state = state[todo].astype(np.int32)
        began[todo] = state
        for at in range(len(way)):
            inside = sizes[todo] > at
            todo, state = todo[inside], state[inside]
            if not len(todo):
                break
            got = _next(table, state, mine[at, todo], others[at])
            apart = got >> 2 != way[at, todo] >> 2
            way[at, todo] = got
            todo, state = todo[apart], got[apart] >> 2


def predict(texts: list[str | None], labelled: tuple[tuple[str, str], ...]) -> tuple[list[str], np.ndarray]:
    """Languages and scores: how much shorter the best parse is than the second, from 0 to 1."""
    languages, classes, models = automata(labelled)
    clean = [plain(t) if t and any(c.isalpha() for c in t) else "" for t in texts]
    if not languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    counts = phrases(clean, classes, [t for t, _ in models]) * np.array([bits for _, bits in models])
    best = counts.argmin(axis=1)
    if len(languages) == 1:
        score = np.ones(len(texts))
    else:
        two = np.partition(counts, 1, axis=1)
        score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
    known = np.array([bool(t) for t in clean])
    return [languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], np.where(known, np.clip(score, 0, 1), 0.0)


def held_out(id_col: str = "doc_id"):
    """Documents whose label is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def prediction(text: Column, labelled: list[tuple[str, str]]) -> Column:
    """struct(lang_pred, score) of a text."""
    known = tuple(labelled)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b]
            turn = np.cumsum([len(t or "") for t in texts]) // HELD
            cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(texts)]
            done = [predict(texts[i:j], known) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pd.DataFrame({"lang_pred": [x for languages, _ in done for x in languages], "score": np.concatenate([s for _, s in done])})

    return run(text)


def identify(docs: DataFrame, labelled: list[tuple[str, str]], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, lang_pred and score for each row. Predictions see the text alone."""
    found = docs.select(*[docs[c] for c in keep], prediction(docs[text_col], labelled).alias("__found"))
    return found.select(*keep, F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("score"))


def accepted(docs: DataFrame, labelled: list[tuple[str, str]], text_col: str = "text") -> DataFrame:
    """The documents whose language is told, with the columns of docs."""
    return docs.filter(prediction(docs[text_col], labelled)["lang_pred"] != UNKNOWN)
