"""Rule-based quality verdicts: a table of thresholds compiled into one projection of native expressions.

Each row is judged alone, so nothing is shuffled. Null and empty texts have no words and fail the base
rule; repeated rows are judged each; other columns of the input are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bind, text_of, words_of

WINDOW = 5

# Common function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from had has have he her his i in is it not of on or she that the their they this to was were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour que qui sa se ses son sur un une vous "
    "als auch auf aus bei das dem den der des die ein eine einer es für hat im in ist mit nach nicht sich sie sind und von wie zu zum zur "
    "al como con de del el en es esta la las lo los más no o para pero por que se sin su sus un una y"
)


class Rule(NamedTuple):
    """A ratio must lie between least and most."""

    name: str
    least: float | None
    most: float | None


#: Production thresholds. Ratios are by word, but dup_line_ratio, which is by line with a word.
RULES = (
    Rule("mean_word_length", 2.0, 16.0),
    Rule("symbol_ratio", None, 0.15),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.5),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found at least twice in the text. Windows are compared by a 64-bit hash."""
    zero = F.lit(0).cast("long")

    def spread(starts: Column) -> Column:
        """Words covered by windows at these ascending positions."""
        gap = lambda k: F.coalesce(F.get(starts, k + 1) - F.get(starts, k), F.lit(window))
        return F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), zero, lambda acc, k: acc + F.least(gap(k), F.lit(window)))

    def twice(hashes: Column) -> Column:
        def starts(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            k_of = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(k_of, lambda k: F.get(s, k)["i"]))

        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(bind(bind(ranked, starts), spread))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    return F.when(F.size(words) < window, zero).otherwise(bind(words, lambda w: bind(hashed(w), twice)))


def _kept(text: Column, others: str) -> Column:
    """Code points of the text outside runs of these characters."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the counts, the ratios, the base verdict and kept."""
    base = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    split = base.select(id_col, "__text", words_of(F.col("__text")).alias("__words"), F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    words, lines, text = F.col("__words"), F.col("__lines"), F.col("__text")
    stops = sorted(set(STOP_WORDS.split()))
    counted = split.select(
        id_col,
        F.size(words).cast("long").alias("n_words"),
        _kept(text, r"[\x20\x09-\x0D]+").alias("word_chars"),
        _kept(text, r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    ratios = {"mean_word_length": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "stop_word_ratio": per("n_stop_words", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines")}
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = ~failed
    for rule in rules:
        if rule.least is not None:
            verdict &= ratios[rule.name] >= F.lit(rule.least)
        if rule.most is not None:
            verdict &= ratios[rule.name] <= F.lit(rule.most)
    return counted.select("*", failed.alias("base_failed"), verdict.alias("kept"))
