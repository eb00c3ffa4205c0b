"""Exact largest inner products of integer vectors by block-at-a-time pruning.

A vector is a list of terms with whole impacts: component i of x is floor(1024 * x[i]), one that is not there is 0. Rows
are put into an order in which similar ones stand together (by length, then by the leaves of a k-means tree fitted on a
bounded sample), and this order is cut into ranges and these into blocks. A block keeps a forward index (its vectors) and
the largest and smallest impact of each term. Summed over a query's terms these bound every score in the block: impacts
may be negative, so a term adds the larger of both products.

A query first goes to the range with the largest bound, where it takes the blocks in the order of their bounds until the
next one is below its k-th score. Then it goes to those other ranges only whose bound isn't below that score, and begins
there with it. A bound equal to the k-th score is below it only if all ids in the block are larger than the k-th row's. So
the result is exact, ties included. Sums are taken in doubles where the table's largest component proves that they are
exact there, else in Python's whole numbers; scores beyond 64 bits are given as the largest or smallest of these.

The broadcast bounds of ranges are bounded: at most RANGES ranges (more rows make them longer) of at most TERMS terms; a
range with longer vectors has no bound and is always visited. Queries meet a range in turns of TURN. Vectors that are null
or hold null or non-finite components take no part, nor do rows without id; empty and zero vectors do, with score 0. A
repeated query id is searched once (its smallest vector), and none of its rows is a candidate of its own; other repeated
rows are candidates each. No rows give no rows. Other columns don't matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.ann import Tree, matrix
from quarry.llm.common import checkpointed

#: Impacts are whole parts of so many times the components.
UNIT = 1024
#: Rows of a block, and the numbers it holds; rows of a range; ranges, and terms of which a range keeps bounds.
BLOCK, WIDE, RANGE, RANGES, TERMS = 256, 1 << 20, 16_384, 4_096, 1_024
#: Queries that meet a range at once; rows (and numbers of these) that the order is fitted on.
TURN, SAMPLE, SAMPLED = 8_192, 10_000, 1 << 21


def impacts(vectors: list, exact: bool) -> np.ndarray:
    """The impacts by row, filled up with zeros: whole numbers in doubles, or Python's where sums need these."""
    lists = [np.asarray(v, dtype=np.float64) for v in vectors]
    out = np.zeros((len(lists), max(map(len, lists), default=0)))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    if exact:
        return np.floor(out * UNIT)
    # UNIT * c in whole numbers; a double beyond 2 ** 53 is whole itself
    scaled = [[int(c) * UNIT if abs(c) >= 2.0**53 else int(np.floor(c * UNIT)) for c in row] for row in out.tolist()]
    return np.array(scaled, dtype=object).reshape(out.shape)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products by query and row over the terms that both have."""
    width = min(q.shape[1], x.shape[1])
    return q[:, :width] @ x[:, :width].T if width else np.zeros((len(q), len(x)), dtype=q.dtype)


def bound_of(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """By query: what no score is above where impacts lie between these."""
    return (products(np.maximum(q, 0), high[None, :]) + products(np.minimum(q, 0), low[None, :]))[:, 0]


class Top:
    """The k best rows of each query; ties go to the smaller id. `least` and `last` are the score and id of the k-th row."""

    def __init__(self, q_ids: np.ndarray, k: int, least: np.ndarray, last: np.ndarray):
        self.q_ids, self.k, self.least, self.last = q_ids, k, least.copy(), last.copy()
        self.found: list[list[tuple]] = [[] for _ in q_ids]  # (-score, id), best first

    def add(self, mine: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        bar = self.least[mine]
        good = (scores >= bar[:, None]).astype(bool) & (self.q_ids[mine][:, None] != ids[None, :])
        for i in np.flatnonzero(good.any(axis=1)):
            at, row = mine[i], scores[i]
            here = np.flatnonzero(good[i])
            if len(here) > 4 * self.k and row.dtype != object:  # no more than the k best and what ties with the last
                here = here[row[here] >= np.partition(row[here], len(here) - self.k)[len(here) - self.k]]
            best = sorted([*self.found[at], *zip((-row[here]).tolist(), ids[here].tolist(), strict=True)])[: self.k]
            self.found[at] = best
            if len(best) == self.k and (best[-1][0], best[-1][1]) < (-self.least[at], self.last[at]):
                self.least[at], self.last[at] = -best[-1][0], best[-1][1]


class Block:
    """A run of rows: ids and their vectors (the forward index), each term's largest and smallest impact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.first = ids, x, int(ids.min())
        self.high, self.low = x.max(axis=0), x.min(axis=0)


def through(top: Top, q: np.ndarray, blocks: list[Block]) -> int:
    """Take each query through the blocks, by bounds, until these are below its k-th score; the number of (query, block) scored."""
    met, going = 0, np.arange(len(q))
    if not blocks:
        return 0
    bound = np.stack([bound_of(q, b.high, b.low) for b in blocks], axis=1)
    order = np.argsort(-bound, axis=1, kind="stable")
    for turn in range(len(blocks)):
        at, still = order[going, turn], []
        for n in np.unique(at):
            mine = going[at == n]
            here, bar = bound[mine, n], top.least[mine]
            still.append(mine[(here >= bar).astype(bool)])
            mine = mine[((here > bar) | ((here == bar) & (blocks[n].first <= top.last[mine]))).astype(bool)]
            if len(mine):
                top.add(mine, products(q[mine], blocks[n].x), blocks[n].ids)
                met += len(mine)
        going = np.concatenate(still)
        if not len(going):
            break
    return met


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec: the rows that take part."""
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"  # as they came, so that rows stay small
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec")).filter("vec_id is not null and vec is not null")
    return rows.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def ordered(rows: DataFrame, ranges: int, largest: float) -> DataFrame:
    """rows in ranges (partitions) of similar ones. Those of the most common length go by the leaf of a tree, others by length."""
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()["n"]
    fitted = rows.filter((F.size("vec") == common) & F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE, SAMPLED // max(1, common)))).collect()
    if fitted and ranges > 1:
        x = np.array([r["vec"] for r in fitted], dtype=np.float64)
        # a row's larger norm only shifts it in the order
        sent = rows.sparkSession.sparkContext.broadcast(Tree(x, largest, float(np.sqrt(((x / largest) ** 2).sum(axis=1).max()))))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                leaf, alike = np.full(len(b), -1, dtype=np.int64), (b["vec"].map(len) == common).to_numpy()
                if alike.any():
                    leaf[alike] = sent.value.leaf_of(matrix(b["vec"][alike]))
                yield b.assign(leaf=leaf)

        rows = rows.mapInPandas(place, f"vec_id long, vec {rows.schema['vec'].dataType.simpleString()}, leaf long")
    else:
        rows = rows.withColumn("leaf", F.lit(0).cast("long"))
    keys = [F.size("vec"), F.col("leaf"), F.rand(17)]  # at random in a leaf, so copies of one row are dealt evenly
    return rows.repartitionByRange(ranges, *keys).sortWithinPartitions(F.size("vec"), "leaf")


def index(rows: DataFrame, ranges: int, largest: float, exact: bool) -> DataFrame:
    """range, ids, x, high, low: a row for each block."""

    def block(part: list[tuple], number: int) -> tuple:
        x = impacts([v for _, v in part], exact)
        held = (lambda a: a.astype("<i4").tobytes()) if exact else (lambda a: pickle.dumps(a.tolist()))
        return number, [i for i, _ in part], held(x), held(x.max(axis=0)), held(x.min(axis=0))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        number = None
        for b in batches:
            out = []
            for i, v, number in zip(b["vec_id"], b["vec"], b["range"], strict=True):  # noqa: B007 - one range a task
                if held and (len(held) == BLOCK or (len(held) + 1) * max(len(v), len(held[-1][1])) > WIDE or len(v) > 2 * len(held[0][1]) + 64):
                    out.append(block(held, number))
                    held = []
                held.append((i, v))
            yield pd.DataFrame(out, columns=["range", "ids", "x", "high", "low"])
        if held:
            yield pd.DataFrame([block(held, number)], columns=["range", "ids", "x", "high", "low"])

    placed = ordered(rows, ranges, largest).select("vec_id", "vec", F.spark_partition_id().alias("range"))
    return placed.mapInPandas(cut, "range int, ids array<long>, x binary, high binary, low binary")


def _numbers(held: bytes, exact: bool) -> np.ndarray:
    return np.frombuffer(held, dtype="<i4").astype(np.float64) if exact else np.array(pickle.loads(held), dtype=object)


def range_bounds(blocks: DataFrame, exact: bool) -> list[tuple[int, np.ndarray | None, np.ndarray | None]]:
    """(range, high, low) of at most RANGES ranges; None for high and low where vectors are longer than TERMS."""

    def widest(group: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for column, fold in (("high", np.maximum), ("low", np.minimum)):
            own = [_numbers(bytes(v), exact) for v in group[column]]
            width = max(map(len, own))
            zero = np.zeros(width, dtype=own[0].dtype)
            total = None
            for v in own:
                wide = np.concatenate([v, zero[len(v) :]])
                total = wide if total is None else fold(total, wide)
            sides.append(pickle.dumps(total) if width <= TERMS else None)
        return pd.DataFrame({"range": group["range"].iloc[:1].to_numpy(), "high": sides[:1], "low": sides[1:]})

    # one range's blocks are bounded, and so is what comes to the driver
    found = blocks.select("range", "high", "low").groupBy("range").applyInPandas(widest, "range int, high binary, low binary").collect()
    return [(r["range"], *(None if v is None else pickle.loads(bytes(v)) for v in (r["high"], r["low"]))) for r in sorted(found)]


def sortable(n: int) -> str:
    """A string that sorts as the number does."""
    digits = str(abs(n))
    return f"1{len(digits):05d}{digits}" if n >= 0 else f"0{99_999 - len(digits):05d}{''.join(str(9 - int(d)) for d in digits)}"


def number_of(key: str) -> int:
    return int(key[6:]) if key[0] == "1" else -int("".join(str(9 - int(d)) for d in key[6:]))


def search(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query row, among all rows but its own."""
    spark, schema = df.sparkSession, "query_id long, rank int, vec_id long, score long"
    rows = valid(df, id_col, vec_col)
    size = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).alias("largest"), F.max(F.size("vec")).alias("width")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    largest, width = size["largest"] or 1.0, max(1, size["width"])
    exact = largest < 2.0**40 and (largest * UNIT + 1) ** 2 * width < 2.0**53
    blocks = checkpointed(index(rows, max(1, min(RANGES, -(-size["n"] // RANGE))), largest, exact))
    known = spark.sparkContext.broadcast(range_bounds(blocks, exact))
    queries = checkpointed(rows.filter(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("q")))
    never, asked = np.iinfo(np.int64).max, ["query_id", "q", "score", "key", "last"]

    def bars(b: pd.DataFrame) -> np.ndarray:
        """Each query's k-th score so far."""
        own = [-np.inf if pd.isna(s) else int(s) if key is None else number_of(key) for s, key in zip(b["score"], b["key"], strict=True)]
        return np.array(own, dtype=np.float64 if exact else object)

    def route(first: bool):
        """Rows for the range that a query begins with, or for all others that may change its result."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            numbers = np.array([n for n, _, _ in known.value], dtype=np.int32)
            for b in batches:
                if not len(b):
                    continue
                q = impacts(list(b["q"]), exact)
                bound = np.stack([np.full(len(q), np.inf) if high is None else bound_of(q, high, low) for _, high, low in known.value], axis=1)
                home = np.argmax(bound, axis=1)
                goes = (np.arange(len(numbers))[None, :] == home[:, None]) == first
                if not first:
                    goes &= (bound >= bars(b)[:, None]).astype(bool)
                i, j = np.nonzero(goes)
                for at in range(0, len(i), TURN):
                    yield b[asked].iloc[i[at : at + TURN]].assign(range=numbers[j[at : at + TURN]])

        return run

    def meet(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "rank", "score", "key"]
        if not len(asking) or not len(there):
            return pd.DataFrame([], columns=names).astype({"query_id": "int64", "vec_id": "int64", "rank": "int32", "score": "int64"})
        own = [Block(np.asarray(ids, dtype=np.int64), _numbers(bytes(x), exact).reshape(len(ids), -1)) for ids, x in zip(there["ids"], there["x"], strict=True)]
        top = Top(asking["query_id"].to_numpy(), k, bars(asking), asking["last"].to_numpy())
        through(top, impacts(list(asking["q"]), exact), own)
        found = [(q, i, n, int(-s)) for q, best in zip(top.q_ids.tolist(), top.found, strict=True) for n, (s, i) in enumerate(best, 1)]
        return pd.DataFrame([(q, i, n, min(max(s, -never - 1), never), None if exact else sortable(s)) for q, i, n, s in found], columns=names)

    def met(routed: DataFrame) -> DataFrame:
        routed = checkpointed(routed)
        turns = F.broadcast(checkpointed(routed.groupBy("range").agg(F.ceil(F.count("*") / TURN).cast("int").alias("turns"))))  # a row per range
        left = routed.join(turns, "range").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int")).drop("turns")
        right = blocks.select("range", "ids", "x").join(turns, "range").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
        keys = ["range", "turn"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, rank int, score long, key string")

    kind = f"query_id long, q {rows.schema['vec'].dataType.simpleString()}, score long, key string, last long, range int"
    none = queries.select("query_id", "q", F.lit(None).cast("long").alias("score"), F.lit(None).cast("string").alias("key"), F.lit(never).alias("last"))
    begun = checkpointed(met(none.mapInPandas(route(True), kind)))
    reached = begun.filter(F.col("rank") == k).select("query_id", "score", "key", F.col("vec_id").alias("last"))
    going = queries.join(reached, "query_id", "left").withColumn("last", F.coalesce("last", F.lit(never)))
    both = begun.unionByName(met(going.select(*asked).mapInPandas(route(False), kind)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("key"), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
