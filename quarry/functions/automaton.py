"""Large word lists by an Aho-Corasick automaton: one pass over a text finds all words of a list, whatever its length.

Lists are configurations and live on the driver; each Python worker builds the automaton once. Results are those of the
rules applied word by word, in their order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Bytes, about, of the pieces of text whose masks a worker remembers, twice.
REMEMBERED = 40_000_000
#: Characters of texts, about, that are cut at once.
PART = 8_000_000


class Finder:
    """Which of the words, by number, a text holds, and where."""

    def __init__(self, words: Sequence[str]):
        self.machine = ahocorasick.Automaton()
        numbers: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                numbers.setdefault(w, []).append(i)
        for w, own in numbers.items():
            self.machine.add_word(w, (len(w), own))
        self.empty = not numbers
        if numbers:
            self.machine.make_automaton()

    def held(self, text: str) -> set[int]:
        return {i for _, (_, own) in self.machine.iter(text) for i in own} if not self.empty and text else set()


class Masks(dict):
    """The mask of each piece that was asked for lately, made when it is first asked for; hits has those that hold words, with these."""

    def __init__(self, make: Callable[[str], tuple[str, set[int]]]):
        super().__init__()
        self.make, self.hits, self.old, self.size = make, {}, ({}, {}), 0

    def __missing__(self, piece: str) -> str:
        masks, hits = self.old
        new, hit = (masks[piece], hits.get(piece)) if piece in masks else self.make(piece)
        self[piece] = new
        if hit:
            self.hits[piece] = hit
        self.size += len(piece) + 100
        return new

    def forget(self) -> None:
        """Let go of those that weren't asked for since the last time."""
        if self.size > REMEMBERED:
            self.old, self.hits, self.size = (dict(self), self.hits), {}, 0
            self.clear()


class Masker:
    """Words replaced by a mark, one word after another, in the order of the list."""

    def __init__(self, words: Sequence[str], mark: str):
        self.words, self.mark, self.finder = list(words), mark, Finder(words)
        # a word that may come about where a mark stands, so that a replacement can make it
        joins = lambda w: not mark or mark in w or w in mark or any(mark[-n:] == w[:n] or mark[:n] == w[-n:] for n in range(1, min(len(mark), len(w)) + 1))
        made = [i for i, w in enumerate(self.words) if w and joins(w)]
        self.made, self.maker = made, Finder([self.words[i] for i in made])
        self.masks = Masks(self._at_once)
        # bytes of UTF-8 that may be part of a word: what parts two others is a character of one byte
        self.inside = np.arange(256) > 127
        self.inside[[ord(c) for w in words for c in w if c < "\x80"]] = True

    def mask(self, text: str) -> tuple[str, set[int]]:
        """The text and the numbers of the words that were replaced."""
        return self._in_turn(text) if self.made else self._at_once(text)

    def mask_all(self, texts: pa.Array, of: np.ndarray) -> tuple[pa.Array, list[list[int]]]:
        """The texts and, in order, those of the numbers `of` the words that were replaced in each.

        No word goes beyond a run of the words' characters. So, where no replacement makes a word, texts are cut before
        and after each run, and each distinct piece, of which there are few, is masked once.
        """
        if self.made:
            done = [(None, ()) if t is None else self.mask(t) for t in texts.to_pylist()]
            return pa.array([t for t, _ in done], pa.string()), [sorted({int(of[i]) for i in hit}) for _, hit in done]
        filled = pc.fill_null(texts.cast(pa.string()), "")
        _, ends, data = filled.buffers()
        ends = np.frombuffer(ends, dtype=np.int32)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, dtype=np.int32)
        low, high = int(ends[0]), int(ends[-1])
        hits: list[list[int]] = [[] for _ in range(len(filled))]
        if low == high:
            return texts, hits
        run, cut = self.inside[np.frombuffer(data, dtype=np.uint8)[low:high]], np.zeros(high - low + 1, dtype=bool)
        cut[1:-1] = run[1:] != run[:-1]
        cut[ends - low] = True
        at = np.flatnonzero(cut) + low
        first = np.searchsorted(at, ends)  # the first piece of each text
        pieces = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), data]).dictionary_encode()
        known, kinds = pieces.dictionary.to_pylist(), {(): 0}
        masked = pa.array(map(self.masks.__getitem__, known), pa.string()).take(pieces.indices)
        numbers, kind = of.tolist(), np.zeros(len(known), dtype=np.int64)
        for n, piece in enumerate(known):
            if piece in self.masks.hits:
                kind[n] = kinds.setdefault(tuple({numbers[i] for i in self.masks.hits[piece]}), len(kinds))
        kind = kind[pieces.indices.to_numpy()]
        self.masks.forget()
        held = np.flatnonzero(kind)
        found, names = np.unique((np.searchsorted(first, held, side="right") - 1) * len(kinds) + kind[held]), list(kinds)
        for text, k in zip((found // len(kinds)).tolist(), (found % len(kinds)).tolist(), strict=True):
            hits[text] = sorted({*hits[text], *names[k]})
        _, ends, data = masked.buffers()  # the pieces lie side by side
        ends = np.frombuffer(ends, dtype=np.int32)[masked.offset :][first]
        out = pa.Array.from_buffers(pa.string(), len(filled), [None, pa.py_buffer(ends), data])
        return pc.if_else(texts.is_valid(), out, None), hits

    def _at_once(self, text: str) -> tuple[str, set[int]]:
        """An occurrence counts unless it meets one of an earlier word, or its own before it."""
        found = [(own[0], end - n + 1, n) for end, (n, own) in self.finder.machine.iter(text)] if not self.finder.empty and text else []
        if not found:
            return text, set()
        if len(found) == 1:
            i, at, n = found[0]
            return text[:at] + self.mark + text[at + n :], {i}
        found.sort()
        used, taken, hit = bytearray(len(text)), [], set()
        for i, at, n in found:
            if used.find(1, at, at + n) < 0:
                used[at : at + n] = b"\x01" * n
                taken.append((at, at + n))
                hit.add(i)
        out, last = [], 0
        for start, end in sorted(taken):
            out += [text[last:start], self.mark]
            last = end
        return "".join([*out, text[last:]]), hit

    def _in_turn(self, text: str) -> tuple[str, set[int]]:
        """Words that the text holds in their order; after a replacement those that it may have made are looked for."""
        todo, hit, last = list(self.finder.held(text)), set(), -1
        heapify(todo)
        while todo:
            i = heappop(todo)
            if i <= last or self.words[i] not in text:
                continue
            last = i
            text = text.replace(self.words[i], self.mark)
            hit.add(i)
            for n in self.maker.held(text):
                if self.made[n] > i:
                    heappush(todo, self.made[n])
        return text, hit


@lru_cache(maxsize=4)
def _masker(words: tuple[str, ...], mark: str) -> Masker:
    return Masker(words, mark)


@lru_cache(maxsize=4)
def _finder(words: tuple[str, ...]) -> Finder:
    return Finder(words)


def masked_by_lists(text: Column, hits: Column, lists: Sequence[tuple[str, Sequence[str]]], mark: str) -> Column:
    """(text, hits) after the named lists, each word in its order; the name of a list is added if one of its words is replaced."""
    words, names = tuple(w for _, own in lists for w in own), [name for name, _ in lists]
    of = np.repeat(np.arange(len(lists)), [len(own) for _, own in lists])

    @F.pandas_udf("text string, hits array<string>")
    def run(text: pd.Series, hits: pd.Series) -> pd.DataFrame:
        masker, out = _masker(words, mark), [pd.DataFrame({"text": [], "hits": []}, dtype=object)]
        rows = np.array([len(t or "") for t in text], dtype=np.int64).cumsum() // PART
        for some in np.split(np.arange(len(text)), np.flatnonzero(np.diff(rows)) + 1):
            new, found = masker.mask_all(pa.array(text.iloc[some].tolist(), pa.string()), of)
            out.append(pd.DataFrame({"text": pd.Series(new.to_pylist(), dtype=object), "hits": [[*h, *dict.fromkeys(names[i] for i in own)] for h, own in zip(hits.iloc[some], found, strict=True)]}))
        return pd.concat(out, ignore_index=True)

    return run(text, hits)


def expanded_by_map(query: Column, terms: Sequence[tuple[str, str]]) -> Column:
    """A query's variant, as a list of one, or of none: aliases that it holds replaced one after another, in the order given."""
    aliases = tuple(a for a, _ in terms)

    @F.pandas_udf("array<string>")
    def run(query: pd.Series) -> pd.Series:
        finder, out = _finder(aliases), []
        for q in query:
            new = q or ""
            for i in sorted(finder.held(new)):
                new = new.replace(*terms[i])
            out.append([new] if q and new != q else [])
        return pd.Series(out)

    return run(query)
