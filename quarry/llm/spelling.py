"""Spelling variants by asymmetric q-chunks: words one edit apart, and the common word that each is a form of.

Of two words the shorter (of equal length, the smaller) gives two disjoint chunks, its halves; the other gives positional
grams. One edit leaves a half as it is: the first half where it was, or the second half moved by the difference of the
lengths, one at most. So grams are made at these places only (the shift is part of the join's key), a word joins on its
halves, and what meets is verified. A pair that keeps both halves is taken by the first, so each pair is met once.

A half shared by more than CROWD words isn't met word by word. There the other halves, which are one edit apart, meet
instead: at what is left of both without the letter at one place (a replaced letter), or at the shorter one (an inserted
letter). No more words than there are letters meet at one of these, so rows grow with the vocabulary and not with the
square of a half's words. Both ways are exact, and none drops a word or a partner.

Words are letters' runs of at least LEAST code points, found at least TWICE times in all texts. Null and empty texts give
none; rows that repeat count each; a row without id counts as one whose id is empty. No texts give no rows. Other columns
don't matter. A word's form is its near word with the largest count (of equal ones the smallest), if it is at least TIMES
as frequent; counts grow tenfold from form to form, so roots are found in a few rounds of pointer doubling.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed

LEAST, TWICE, TIMES = 7, 2, 10
#: One run of letters in so many loses a letter, as decided by its document and itself.
SPOILT = 31
LETTER = r"[A-Za-z\x{C0}-\x{FF}]"
#: Words with the same half that still meet word by word.
CROWD = 50


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """word, n: the words of whole texts and how often they occur."""
    # a run shorter than `least` gives no word, and none of its parts is a run
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"{LETTER}{{{least},}}"), F.lit(0))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("run"))
    hashed = runs.select("id", lower.alias("run")).select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % SPOILT == 0, _without(F.col("run"), at)).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= twice)


def _without(text: Column, at: Column) -> Column:
    """The text without the code point at this place, from 0."""
    return F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + 2, F.length(text)))


def chunks(words: DataFrame) -> DataFrame:
    """key, x, n_x, rest: the two halves of each word. A key holds the length, which half, and its letters."""
    n = F.length("word")
    half = F.ceil(n / 2).cast("int")
    first, second = F.substring("word", F.lit(1), half), F.substring("word", half + 1, n)
    both = F.array(F.struct(_key(n, 1, first).alias("key"), second.alias("rest")), F.struct(_key(n, 2, second).alias("key"), first.alias("rest")))
    return words.select(F.col("word").alias("x"), F.col("n").alias("n_x"), F.explode(both).alias("c")).select("c.key", "x", "n_x", "c.rest")


def _key(length: Column, half: int, letters: Column) -> Column:
    return F.concat_ws(":", length.cast("string"), F.lit(half).cast("string"), letters)


def grams(words: DataFrame) -> DataFrame:
    """key, y, n_y, rest: what of each word a half of another may be, which is as long or one letter shorter."""
    n, out = F.length("word"), []
    for shift in (0, 1):  # how much longer this word is
        other = n - shift
        half = F.ceil(other / 2).cast("int")
        out.append(F.struct(_key(other, 1, F.substring("word", F.lit(1), half)).alias("key"), F.substring("word", half + 1, n).alias("rest")))
        out.append(F.struct(_key(other, 2, F.substring("word", half + 1 + shift, n)).alias("key"), F.substring("word", F.lit(1), half + shift).alias("rest")))
    return words.select(F.col("word").alias("y"), F.col("n").alias("n_y"), F.explode(F.array(*out)).alias("g")).select("g.key", "y", "n_y", "g.rest")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """x, n_x, y, n_y: all pairs of words one edit apart, each once. `words` (word, n) is read several times."""
    cut, other = chunks(words), grams(words)
    crowded = checkpointed(cut.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > crowd).select("key"))
    # checkpoints, so that both sides of the joins are shuffled and Spark can split a half with very many words
    few = checkpointed(cut.join(crowded, "key", "left_anti")).drop("rest")
    many = checkpointed(cut.join(crowded, "key", "left_semi"))
    plain = few.join(other.drop("rest"), "key")
    return _verified(plain).unionByName(_verified(_refined(many, other.join(crowded, "key", "left_semi"))))


def _refined(cut: DataFrame, other: DataFrame) -> DataFrame:
    """What meets at a crowded half: the rests must be one edit apart, and meet by what is left of them."""
    n = F.length("rest")
    places = F.sequence(F.lit(0), n - 1)
    gaps = F.transform(places, lambda i: F.concat(i.cast("string"), F.lit("-"), _without(F.col("rest"), i)))  # one letter replaced
    whole = F.array(F.concat(F.lit("+"), F.col("rest")))
    inserted = F.array_distinct(F.transform(places, lambda i: F.concat(F.lit("+"), _without(F.col("rest"), i))))
    longer = F.length("y") > F.split_part("key", F.lit(":"), F.lit(1)).cast("int")
    left = cut.select("key", "x", "n_x", F.explode(F.concat(whole, gaps)).alias("left"))
    right = other.select("key", "y", "n_y", F.explode(F.when(longer, inserted).otherwise(gaps)).alias("left"))
    return left.join(right, ["key", "left"]).drop("left")


def _verified(met: DataFrame) -> DataFrame:
    ordered = (F.length("x") < F.length("y")) | (F.col("x") < F.col("y"))
    half = F.ceil(F.length("x") / 2).cast("int")
    by_first = F.substring("y", F.lit(1), half) == F.substring("x", F.lit(1), half)
    once = (F.split_part("key", F.lit(":"), F.lit(2)) == "1") | ~by_first
    return met.filter(ordered & once & (F.levenshtein("x", "y", 1) == 1)).select("x", "n_x", "y", "n_y")


def variants(words: DataFrame, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    words = checkpointed(words)
    pairs = near_pairs(words, crowd)
    ways = F.array(F.struct(F.col("x").alias("word"), F.col("n_x").alias("n"), F.col("y").alias("near"), F.col("n_y").alias("near_n")), F.struct(F.col("y").alias("word"), F.col("n_y").alias("n"), F.col("x").alias("near"), F.col("n_x").alias("near_n")))
    sided = pairs.select(F.explode(ways).alias("w")).select("w.*")
    best = sided.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    noted = checkpointed(words.join(best, "word", "left"))
    most = noted.agg(F.max("n"), F.min("n")).first()
    is_form = -F.col("best.minus") >= times * F.col("n")
    forms = noted.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"))
    roots = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    depth = math.ceil(math.log(max(1, (most[0] or 1) / (most[1] or 1)), times)) + 1  # forms that can follow each other, and one to be safe
    for _ in range(math.ceil(math.log2(depth))):
        roots = checkpointed(roots)
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
