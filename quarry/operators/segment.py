"""Words of Chinese text: the most probable way to cut each run of characters, by the counts of words.

A dictionary (word, n) is given, or learned from a corpus: runs' substrings of up to LONGEST characters that come together
more often than their parts would by chance. A word's cost is the logarithm of how rare it is, in whole millionths, so that
sums are exact and all ways to add them up agree. A run's words are those of the cheapest path through the lattice of words
that occur in it; of equally cheap ones, the path whose first word is longer. Each distinct run is cut once, whatever
the number of texts it is in; words are joined to runs by Spark, so the dictionary may be of any size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.retrieve import CHINESE, tokens
from quarry.operators.sparse_index import Analyser

#: Characters of a word at most; occurrences of a word of several characters at least, and how much more often than by chance.
LONGEST, LEAST, COHESION = 4, 2, 4
UNIT = 1_000_000


def runs_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHINESE + "+"), F.lit(0))


def _substrings(run: Column, longest: int) -> Column:
    """(start from 1, word) of all substrings of up to `longest` characters."""
    starts = F.sequence(F.lit(1), F.length(run))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(run) - i + 1)), lambda n: F.struct(i.alias("start"), F.substring(run, i, n).alias("word")))))


def dictionary(df: DataFrame, text_col: str, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION) -> DataFrame:
    """word, n learned from texts: single characters, and longer words that are found `least` times and hold together.

    A word holds together if it is `cohesion` times as frequent as each way to put it together of two parts would have it.
    """
    runs = df.select(F.explode(runs_of(F.col(text_col))).alias("run")).groupBy("run").agg(F.count("*").alias("c"))
    grams = runs.select("c", F.explode(_substrings(F.col("run"), longest)).alias("s")).groupBy("s.word").agg(F.sum("c").alias("n"))
    grams = grams.filter((F.length("word") == 1) | (F.col("n") >= least))
    letters = grams.filter(F.length("word") == 1).agg(F.sum("n").alias("letters"))  # one row
    cuts = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(F.substring("word", F.lit(1), i).alias("a"), F.substring("word", i + 1, F.length("word")).alias("b")))
    cut = grams.filter(F.length("word") > 1).select("word", "n", F.explode(cuts).alias("c")).select("word", "n", "c.a", "c.b")
    part = lambda side: grams.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    joined = cut.join(part("a"), "a").join(part("b"), "b").crossJoin(F.broadcast(letters))
    loose = joined.filter(F.col("n") * F.col("letters") < cohesion * F.col("n_a") * F.col("n_b")).select("word").distinct()
    return grams.join(loose, "word", "left_anti").select("word", "n")


def costs(words: DataFrame) -> DataFrame:
    """word, cost of a dictionary; beside these, the cost of a character that isn't in it, on each row."""
    total = words.agg(F.sum("n").alias("total"))  # one row
    cost = lambda times: F.round(UNIT * F.log(times)).cast("long")
    return words.crossJoin(F.broadcast(total)).select("word", cost(F.col("total") / F.col("n")).alias("cost"), cost(2 * F.col("total")).alias("unknown"))


def cheapest(run: str, arcs: list[tuple[int, str, int]], unknown: int) -> list[str]:
    """The words of the cheapest path through a run's lattice of (start from 1, word, cost)."""
    by: list[list[tuple[str, int]]] = [[] for _ in run]
    for start, word, cost in arcs:
        by[start - 1].append((word, cost))
    best: list[tuple[int, str]] = [(0, "")] * (len(run) + 1)
    for i in range(len(run) - 1, -1, -1):
        ways = by[i] if any(len(w) == 1 for w, _ in by[i]) else [*by[i], (run[i], unknown)]
        cost, length, word = min((c + best[i + len(w)][0], -len(w), w) for w, c in ways)
        best[i] = (cost, word)
    out, i = [], 0
    while i < len(run):
        out.append(best[i][1])
        i += len(best[i][1])
    return out


def words_of_runs(runs: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """run, words: each distinct run cut by a dictionary (word, n)."""
    distinct = runs.select("run").distinct()
    priced = costs(words.filter(F.length("word") <= longest))
    arcs = distinct.select("run", F.explode(_substrings(F.col("run"), longest)).alias("s")).select("run", "s.start", "s.word").join(priced, "word")
    lattice = arcs.groupBy("run").agg(F.collect_list(F.struct("start", "word", "cost")).alias("arcs"), F.max("unknown").alias("unknown"))

    @F.pandas_udf("array<string>")
    def cut(run: pd.Series, arcs: pd.Series, unknown: pd.Series) -> pd.Series:
        ways = [[(a["start"], a["word"], a["cost"]) for a in own] if own is not None else [] for own in arcs]
        return pd.Series([cheapest(r, own, 0 if pd.isna(u) else int(u)) for r, own, u in zip(run, ways, unknown, strict=True)])

    return distinct.join(lattice, "run", "left").select("run", cut("run", "arcs", "unknown").alias("words"))


def analyser(words: DataFrame, longest: int = LONGEST) -> Analyser:
    """An analyser for indexes and searches: words of a dictionary in runs of Chinese characters, else lower-cased words."""

    def analyse(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        chinese = F.coalesce(F.col(text_col).rlike(CHINESE), F.lit(False))
        rest = F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}_&&[^一-鿿]]+"), F.lit(0))
        mixed = df.filter(chinese)
        placed = mixed.select(F.col(id_col).alias("__id"), F.explode(runs_of(F.col(text_col))).alias("run"))
        cut = words_of_runs(placed, words, longest)
        found = placed.join(cut, "run").groupBy("__id").agg(F.flatten(F.collect_list("words")).alias("__words"))
        with_words = mixed.join(found, mixed[id_col] == found["__id"]).withColumn("t", F.concat(rest, "__words")).select(*df.columns, "t")
        return df.filter(~chinese).withColumn("t", tokens(F.col(text_col))).unionByName(with_words)

    return analyse
