"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 3 of 64 bits differ, once the third of the bits that holds most
differences is left out, in at most 2 of the rest. So every distinct fingerprint emits, for each of the
three ways to leave a third out, its remaining bits and all variants of them one bit away (half of that
radius): linked fingerprints meet at a common variant. Pairs that meet are verified by counting bits.

A variant where more than CROWD fingerprints meet isn't paired up. Its fingerprints emit all variants
of all 64 bits up to 2 bits away, each with its number of flips; whatever meets there with no more
than 3 flips together is linked through the one with the fewest flips, so links grow with the rows and
not with pairs. Both ways are exact.

Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are one node.
Rows with null doc_id are fingerprinted and connect others, but never name a component. Rows that share a doc_id are
judged each by its own text. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, hex64

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Blocks of bits of which one is left out.
THIRDS = ((0, 22), (22, 43), (43, 64))
#: Fingerprints at one variant that are still paired up.
CROWD = 32
#: Hashes held at a time while a text is counted.
STEP = 1 << 15
#: Rows of one fingerprint, and the share of all rows, from which its component is broadcast: at most 1 / HOT_SHARE fingerprints.
HOT, HOT_SHARE = 50_000, 1e-4


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        hashes = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(n, at + STEP))], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """doc_id, fp and, if given, a key (long) of the row: one row per input row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(fp=np.array([fingerprint(t) for t in b["text"]], dtype=np.int64))

    more = [] if key is None else [key.alias("key")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *more, F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, key long, fp long" if more else "doc_id long, fp long")


def _mask(bits: range | list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def near_variants(nodes: DataFrame) -> DataFrame:
    """key, fp: the remaining bits of each fingerprint and all their variants one bit away, by left-out third."""
    rows = []
    for number, (low, high) in enumerate(THIRDS):
        kept = [b for b in range(64) if not low <= b < high]
        tag = (number + 1) << low  # in bits that are left out
        rows += [(_mask(kept), _signed(tag | flip)) for flip in [0] + [1 << b for b in kept]]
    moves = F.array(*[F.struct(F.lit(k).cast("long").alias("kept"), F.lit(f).cast("long").alias("flip")) for k, f in rows])
    return nodes.select("fp", F.explode(moves).alias("m")).select(F.col("fp").bitwiseAND(F.col("m.kept")).bitwiseXOR(F.col("m.flip")).alias("key"), "fp")


def ball(nodes: DataFrame) -> DataFrame:
    """key, flips, fp: every variant of all 64 bits up to two bits away."""
    one = nodes.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    two = one.select("fp", "i", F.explode(F.when(F.col("i") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(-1), F.col("i") - 1))).alias("j"))
    flip = lambda c: F.when(F.col(c) < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.col(c), F.lit(0))))
    flips = F.when(F.col("i") < 0, 0).otherwise(1) + F.when(F.col("j") < 0, 0).otherwise(1)
    return two.select(F.col("fp").bitwiseXOR(flip("i")).bitwiseXOR(flip("j")).alias("key"), flips.alias("flips"), "fp")


def links(nodes: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints; every two linked ones are connected through them."""
    met = near_variants(nodes).withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    met = checkpointed(met)
    few = met.filter(F.col("n") <= CROWD)
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    crowded = met.filter(F.col("n") > CROWD).select("fp").distinct()
    centre = F.min(F.struct("flips", "fp")).over(Window.partitionBy("key"))
    stars = ball(crowded).withColumn("centre", centre).filter((F.col("centre.flips") <= 1) & (F.col("centre.fp") != F.col("fp")))
    return pairs.union(stars.select(F.col("fp"), F.col("centre.fp"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, by alternating large and small stars, to the fixed point."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(low.select("u", "m")).distinct()
        edges = checkpointed(small)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def component_of(marked: DataFrame) -> DataFrame:
    """marked (doc_id, fp, ...) with root, the smallest fingerprint of its component, and component_id.

    Fingerprints of very many rows are few, and are joined by a broadcast of a proven bound; all others by a shuffle.
    """
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpointed(rooted.join(names, "root").select("fp", "root", "component_id", "n"))
    hot = F.broadcast(named.filter(F.col("n") >= max(HOT, int(HOT_SHARE * (nodes.agg(F.sum("n")).first()[0] or 0)))).drop("n"))
    cold = marked.join(hot.select("fp"), "fp", "left_anti").join(named.drop("n"), "fp")
    return marked.join(hot, "fp").unionByName(cold)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id: one row per input row."""
    marked = component_of(checkpointed(fingerprints(docs, id_col, text_col)))
    return marked.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the columns of docs: of its smallest doc_id, null last; of rows that share it, by a hash of the row."""
    key = F.xxhash64(*[docs[c] for c in docs.columns])
    marked = component_of(checkpointed(fingerprints(docs, id_col, text_col, key)))
    rows = marked.groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n"))
    picked = rows.groupBy("root").agg(chosen.alias("c")).select(F.col("c.doc_id").alias("__id"), F.col("c.key").alias("__key"), F.col("c.n").alias("__n"))
    same = F.col("__row").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__key"))
    keyed = docs.withColumns({"__row": docs[id_col].cast("long"), "__hash": key})
    kept = keyed.join(picked.filter("__n = 1"), same, "left_semi")
    kept = kept.unionByName(keyed.join(picked.filter("__n > 1"), same, "left_semi").dropDuplicates(["__row", "__hash"]))  # equal rows
    return kept.select(*docs.columns)
