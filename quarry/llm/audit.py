"""How filters of a corpus interact: what each removes, alone and after others, by part and label.

Each document becomes a truth table in one 32-bit word: bit S says whether it survives when the subset S of the five
filters is applied. Words of a part and label are added up position by position in carry-save counters, so one pass gives
the survivors of every subset. All that the audit reports of any order follows from these 32 numbers a part and label:
what filter f removes after the filters P is survivors(P) - survivors(P + f).

Texts are read once; ids, digests and four verdicts go on. The fifth verdict, a copy of a smaller id's text, goes by the
SHA-256 of whole texts; only digests that occur more than once are joined back, and a common text is split by Spark's
skewed joins. A task keeps at most GROUPS parts and labels and passes on their 32 sums.

Null texts are empty; empty texts fail the first filter, and are copies of each other. Null parts and empty ones are the
part ''. A row without id is no copy and no original, and has no labels. Rows that share id and text don't make each other
copies; each is a document. Labels of an id that is labelled more than once hold if any of its rows says so. No documents
give no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, text_of, words_of

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Parts and labels that a task counts before it passes them on.
GROUPS = 4096


def survival_word(failed: int) -> int:
    """The word of a document that fails these filters (a bit each): bit S is set if none of them is in S."""
    return sum(1 << s for s in range(SUBSETS) if not s & failed)


class CarrySave:
    """Counters of 32 positions. Level l holds at most two words, whose bits weigh 2 ** l each."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        level = 0
        while len(words):
            if level == len(self.levels):
                self.levels.append(np.zeros(0, dtype=np.uint32))
            words, carries = np.concatenate([self.levels[level], words]), [np.zeros(0, dtype=np.uint32)]
            while len(words) > 2:  # three words of a weight are one of it and one of its double
                n = len(words) // 3
                a, b, c = words[:n], words[n : 2 * n], words[2 * n : 3 * n]
                carries.append((a & b) | ((a ^ b) & c))
                words = np.concatenate([a ^ b ^ c, words[3 * n :]])
            self.levels[level], words, level = words, np.concatenate(carries), level + 1

    def counts(self) -> np.ndarray:
        """How many of the words had each bit."""
        bits, total = np.arange(SUBSETS, dtype=np.uint32), np.zeros(SUBSETS, dtype=np.int64)
        for level, words in enumerate(self.levels):
            for w in words:
                total += ((w >> bits) & 1).astype(np.int64) << level
        return total


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest of the text, failed: a bit for each of the first four filters."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("t"))
    split = base.select("*", words_of(F.col("t")).alias("w"))
    fails = (
        F.size("w") < 200,
        100 * F.size(F.array_distinct("w")) < 50 * F.size("w"),
        100 * F.length(F.regexp_replace("t", "[^A-Z]+", "")) > 3 * F.length("t"),
        F.col("t").rlike(r"[#$%&*|]"),
    )
    failed = sum((c.cast("int") * (1 << i) for i, c in enumerate(fails)), F.lit(0))
    return split.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), failed.alias("failed"))


def words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, word: a row for each document."""
    rows = checkpointed(digests(docs))
    # worked out first, so that Spark shuffles both sides of the joins and can split a digest or id with very many rows
    first = checkpointed(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = checkpointed(labels.filter("doc_id is not null").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic")))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    table = F.array(*[F.lit(survival_word(m)).cast("long") for m in range(SUBSETS)])
    marked = rows.join(first, "digest", "left").select("doc_id", "part", F.get(table, F.col("failed") + copy).alias("word"))
    no = F.lit(False)
    return marked.join(known, "doc_id", "left").select("part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "word")


def survivors(rows: DataFrame) -> DataFrame:
    """part, subset, n, good, toxic: documents of the part that survive the subset, and those of them with a label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool, bool], CarrySave] = {}

        def passed_on() -> pa.RecordBatch:
            keys = [k for k in held for _ in range(SUBSETS)]
            n = np.concatenate([c.counts() for c in held.values()]) if held else np.zeros(0, dtype=np.int64)
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(held))), pa.array(n)], names=["part", "is_good", "is_toxic", "subset", "n"])

        for b in batches:
            parts = b.column("part").dictionary_encode()
            good, toxic = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic"))
            key = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + good * 2 + toxic
            order = np.argsort(key, kind="stable")
            word = b.column("word").to_numpy(zero_copy_only=False).astype(np.uint32)[order]
            found, at = np.unique(key[order], return_index=True)
            for k, mine in zip(found.tolist(), np.split(word, at[1:]), strict=False):
                held.setdefault((parts.dictionary[k // 4].as_py(), bool(k & 2), bool(k & 1)), CarrySave()).add(mine)
            if len(held) > GROUPS:
                yield passed_on()
                held.clear()
        yield passed_on()

    counted = rows.mapInArrow(count, "part string, is_good boolean, is_toxic boolean, subset int, n long")
    total = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    return counted.groupBy("part", "subset").agg(total(F.lit(True), "n"), total(F.col("is_good"), "good"), total(F.col("is_toxic"), "toxic"))


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from the survivors of all subsets."""
    every = SUBSETS - 1
    by_part = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("s"))  # 32 each
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = by_part.select("part", "s", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda letters: sum((F.contains(letters, F.lit(x)).cast("int") * (1 << i) for i, x in enumerate(FILTERS)), F.lit(0))
    before, own = bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)), bits(F.substring("filter_order", F.col("step"), F.lit(1)))
    placed = steps.select("part", "s", "filter_order", "step", before.alias("before"), own.alias("own"))
    left = lambda subset, kind="n": F.get(F.col("s"), subset)[kind]
    lost = lambda subset, kind="n": left(subset, kind) - left(subset + F.col("own"), kind)
    removed, alone = lost(F.col("before")), F.lit(every) - F.col("own")

    def shapley() -> Column:
        """Removals over all orders: each set of others comes before the filter in as many orders as it and the rest have."""
        out = F.lit(0).cast("long")
        for s in range(SUBSETS):
            orders = factorial(s.bit_count()) * factorial(max(0, len(FILTERS) - 1 - s.bit_count()))
            out = out + F.when(F.col("own").bitwiseAND(s) == 0, lost(F.lit(s)) * orders).otherwise(0)
        return out

    return placed.select(
        "part", "filter_order", "step",
        left(F.col("before") + F.col("own")).alias("kept"), removed.alias("removed"),
        (lost(F.lit(0)) - removed).alias("redundant"), lost(alone).alias("unique_fails"),
        lost(F.col("before"), "good").alias("good_lost"), lost(F.col("before"), "toxic").alias("toxic_lost"), shapley().alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step, for all orders of the five filters."""
    return report(survivors(words(docs, labels)))
