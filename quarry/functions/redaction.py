"""Masking of personal data: pattern rules in their order, then word lists in theirs, compiled into native expressions.

Patterns are Java's, with Unicode classes: digits of any script are digits.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.automaton import masked_by_lists
from quarry.functions.text import NATIVE_WORDS

MASK, MOST_KEPT_RIGHT, UNICODE = "*", 8, "(?U)"


class Pattern(NamedTuple):
    name: str
    pattern: str
    keep_left: int = 0
    keep_right: int = 0
    keep_domain: bool = False
    #: A text that every match holds, if there is one: where it isn't, no match is looked for.
    holds: str = ""


class Words(NamedTuple):
    name: str
    words: tuple[str, ...]


# The built-in rules, in order.
DEFAULT_RULES: tuple[Pattern | Words, ...] = (
    Pattern("phone", r"(?<!\d)1[3-9]\d{9}(?!\d)", 3, 4),
    Pattern("id_card", r"(?<!\d)(?:\d{17}[\dXx]|\d{15})(?!\d)", 4, 4),
    Pattern("bank_card", r"(?<!\d)\d{16,19}(?!\d)", 4, 4),
    Pattern("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1, 0, True, holds="@"),
    Pattern("api_key", r"\b(?:sk|pk|ak)-[A-Za-z0-9_-]{8,}\b", 4, 4, holds="k-"),
    Pattern("ipv4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
)


def _valid(pattern: str) -> bool:
    """Whether the engine that runs the pattern takes it."""
    try:
        SparkContext.getOrCreate()._jvm.java.util.regex.Pattern.compile(UNICODE + pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def compile_rules(config: dict | None = None, enabled: bool = True) -> tuple[tuple[Pattern | Words, ...], str]:
    """(rules, replacement for words): the built-in rules and those of a config, patterns first; invalid patterns are left out."""
    config = config or {}
    if not (enabled and config.get("enabled", True)):
        return (), "****"
    patterns: list[Pattern] = []
    words: list[Words] = []
    for rule in config.get("rules") or []:
        if rule.get("type") == "word":
            words.append(Words(rule.get("name", ""), tuple(w for w in rule.get("words") or [] if w)))
        elif rule.get("pattern") and _valid(rule["pattern"]):
            patterns.append(Pattern(rule.get("name", ""), rule["pattern"], rule.get("keep_left", 0), rule.get("keep_right", 0), rule.get("email_keep_domain", False)))
    return (*DEFAULT_RULES, *patterns, *words), config.get("replace_with") or "****"


def _masked(found: Column, rule: Pattern) -> Column:
    """A match with its middle starred out."""
    n, right = F.length(found), min(rule.keep_right, MOST_KEPT_RIGHT)
    stars = F.repeat(F.lit(MASK), F.greatest(n - rule.keep_left - right, F.lit(0)))
    middle = F.concat(F.substring(found, F.lit(1), F.lit(rule.keep_left)), stars, F.substring(found, n - right + 1, F.lit(right)))
    middle = F.when(n <= rule.keep_left + right, F.repeat(F.lit(MASK), n)).otherwise(middle)
    if rule.keep_domain:
        domain = F.substring_index(found, "@", -1)
        middle = F.when(found.contains("@"), F.concat(F.substring(found, 1, 1), F.lit("****@"), domain)).otherwise(middle)
    return middle


def _apply(text: Column, rule: Pattern) -> Column:
    """Matches masked between the stretches that lie between them, in a text that has some."""
    pattern = UNICODE + rule.pattern
    masks = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: _masked(m, rule))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), masks, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")


def redacted(df: DataFrame, text_col: str = "text", masked_col: str = "masked", hits_col: str = "hits", rules: tuple[Pattern | Words, ...] = DEFAULT_RULES, replace_with: str = "****") -> DataFrame:
    """df with the masked text and the sorted names of the rules that hit. Each rule sees what those before it left.

    Long word lists are met by an automaton, in one pass over a text.
    """

    def step(rule: Pattern | Words, state: Column) -> Column:
        now, names = state["text"], F.array_append(state["hits"], F.lit(rule.name))
        if isinstance(rule, Words):
            hit, new = F.lit(False), now
            for word in rule.words:
                hit, new = hit | new.contains(word), F.replace(new, F.lit(word), F.lit(replace_with))
        else:
            hit, new = now.rlike(UNICODE + rule.pattern), _apply(now, rule)
            if rule.holds:
                hit = now.contains(rule.holds) & hit
        return F.when(hit, F.struct(new.alias("text"), names.alias("hits"))).otherwise(state)

    out, state = df, F.struct(F.col(text_col).alias("text"), F.array().cast("array<string>").alias("hits"))
    for alike, some in groupby(rules, key=lambda r: isinstance(r, Words)):
        own = list(some)
        if alike and sum(len(r.words) for r in own) > NATIVE_WORDS:
            out = out.withColumn("__state", state)
            out = out.withColumn("__state", masked_by_lists(F.col("__state.text"), F.col("__state.hits"), own, replace_with))
            state = F.col("__state")
        else:
            for rule in own:  # each state is bound to a variable, so it is worked out once a row
                state = _bound(state, rule, step)
    out = out.withColumn("__state", state)
    return out.withColumns({masked_col: F.col("__state.text"), hits_col: F.array_sort(F.array_distinct("__state.hits"))}).drop("__state")


def _bound(state: Column, rule: Pattern | Words, step: Callable[[Pattern | Words, Column], Column]) -> Column:
    return F.transform(F.array(state), lambda s: step(rule, s))[0]


def audit(masked: DataFrame, id_col: str = "doc_id", hits_col: str = "hits") -> DataFrame:
    """doc_id, rules: for each document with a hit, the names of its rules, sorted and joined by commas."""
    # not explode, before which the engine puts filters that work the masks out again
    rules = masked.select(id_col, F.explode_outer(hits_col).alias("rule")).filter("rule is not null")
    return rules.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
