"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

Largest inner product is turned into smallest distance by one more component, sqrt(M^2 - |x|^2) with M the
largest norm, which is 0 for queries. The upper tree is fitted on a bounded sample on the driver. Each of its leaves
with many rows gets a tree of its own, fitted in a task on a bounded sample of the leaf, so that leaves stay small as
rows grow (up to some 10,000 leaves); every row is indexed in a leaf. A query keeps a priority queue of tree nodes by
distance and takes leaves off it. How many, is calibrated: sampled queries are compared with brute force over all rows,
and leaf visits widen until their mean recall reaches the target. A query goes on until the leaves hold k rows beside
its own.

Neighbouring leaves with few rows share a block, where a query meets the rows of the leaves it visits only.
Leaves with many rows are dealt into blocks at random, and a block's queries by a hash, so no group grows
with the data or with copies of one vector or id. Scores are exact, in double precision; ties go to the smaller vec_id.

Vectors that are null, empty, zero, hold null or non-finite components, or differ in length from most
take no part; nor do rows without id. A repeated query id is searched once (its smallest vector), and none of its rows
is a candidate of its own; other repeated rows are candidates each. Other columns don't matter.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed

#: The sample the tree is fitted on; children of a node; sampled rows of a leaf; k-means rounds.
SAMPLE, BRANCH, LEAF, ROUNDS = 20_000, 8, 64, 8
#: Rows from which a leaf of the upper tree gets a tree of its own, the rows that its leaves then hold (a leaf taken off
#: the queue costs as much as scoring about so many rows), and the sample of a leaf that the tree is fitted on.
DEEP, DEEP_LEAF, DEEP_SAMPLE = 4_096, 512, 4_096
#: Queries that calibrate, and the mean recall they must reach.
CALIBRATION, RECALL = 100, 0.97
#: Rows of a block, queries that meet it at once, pairs scored exactly at once.
BLOCK, QUERIES, PAIRS = 4096, 1024, 50_000


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        for j in range(k):
            if (mine := near == j).any():
                centres[j] = x[mine].mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)


class Tree:
    """nodes: for each inner node its children's centres and their numbers; leaves: number of a node to number of a leaf.

    Vectors are divided by `scale`, the largest component of all, so that no square is out of range.
    """

    def __init__(self, x: np.ndarray, scale: float = 1.0, norm: float | None = None, leaf: int = LEAF, seed: int = 7):
        self.scale = scale
        self.norm = norm if norm is not None else float(np.sqrt(((x / scale) ** 2).sum(axis=1).max())) if len(x) else 1.0
        self.nodes: dict[int, tuple[np.ndarray, list[int]]] = {}
        self.leaves: dict[int, int] = {}
        self.size = 0
        self.rows: dict[int, int] | None = None  # by leaf, once they are counted
        self._split(self.lift(x), np.random.default_rng(seed), leaf)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.hstack([x, np.sqrt(np.maximum(0, self.norm**2 - (x**2).sum(axis=1)))[:, None]])

    def _split(self, x: np.ndarray, rng: np.random.Generator, leaf: int) -> int:
        me, self.size = self.size, self.size + 1
        distinct = len(np.unique(x, axis=0)) if len(x) > leaf else 0
        if distinct < BRANCH:
            self.leaves[me] = len(self.leaves)
            return me
        centres = _kmeans(x, BRANCH, rng)
        near = nearest(x, centres)
        used = [j for j in range(BRANCH) if (near == j).any()]
        if len(used) < 2:
            self.leaves[me] = len(self.leaves)
            return me
        self.nodes[me] = (centres[used], [self._split(x[near == j], rng, leaf) for j in used])
        return me

    def graft(self, trees: dict[int, Tree]) -> None:
        """Trees in the place of leaves, by number of the leaf. Leaves are numbered anew, neighbours side by side."""
        for node, leaf in list(self.leaves.items()):
            sub = trees.get(leaf)
            if sub is None or not sub.nodes:
                continue
            number = lambda n, node=node, base=self.size: node if n == 0 else base + n
            del self.leaves[node]
            self.nodes |= {number(n): (centres, [number(c) for c in children]) for n, (centres, children) in sub.nodes.items()}
            self.leaves |= {number(n): -1 for n in sub.leaves}
            self.size += sub.size
        order, todo = [], [0]
        while todo:
            node = todo.pop()
            if node in self.leaves:
                order.append(node)
            else:
                todo += self.nodes[node][1][::-1]
        self.leaves = {node: i for i, node in enumerate(order)}

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        lifted, out = self.lift(x), np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaves:
                out[rows] = self.leaves[node]
                continue
            centres, children = self.nodes[node]
            near = nearest(lifted[rows], centres)
            todo += [(c, rows[near == j]) for j, c in enumerate(children) if (near == j).any()]
        return out

    def visit(self, q: np.ndarray, most: int, least_rows: int = 0) -> list[int]:
        """The first leaves that best-bin-first search takes off its queue: `most`, and more until they hold least_rows rows."""
        q = q / np.abs(q).max()  # only its direction counts
        lifted = np.append(q * (self.norm / np.sqrt((q**2).sum())), 0.0)
        queue, out, met = [(0.0, 0)], [], 0
        while queue and (len(out) < most or met < least_rows):
            _, node = heapq.heappop(queue)
            if node in self.leaves:
                out.append(self.leaves[node])
                met += self.rows.get(self.leaves[node], 0) if self.rows else 0
                continue
            centres, children = self.nodes[node]
            for far, child in zip(((centres - lifted) ** 2).sum(axis=1).tolist(), children, strict=True):
                heapq.heappush(queue, (far, child))
        return out


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64) if len(vectors) else np.zeros((0, 0))


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, meets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, among those that it meets: number of the query, number of the row, exact score."""
    scale = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0), 1e-300)
    small, there = q / scale, x / scale
    rough = small @ there.T
    # no sum of products is further off than this, in whatever order it is added up
    slack = 4 * q.shape[1] * np.finfo(float).eps * np.sqrt((small**2).sum(axis=1)) * np.sqrt((there**2).sum(axis=1).max(initial=0))
    out = q_ids[:, None] == ids[None, :]
    if meets is not None:
        out |= ~meets
    rough[out] = -np.inf
    last = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
    near = (rough >= (last - slack)[:, None]) & ~out  # all that may tie with the last
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    turn = np.cumsum(near.sum(axis=1)) // PAIRS
    for t in np.unique(turn):
        mine = np.flatnonzero(turn == t)
        i, j = np.nonzero(near[mine])
        i = mine[i]
        score = (q[i] * x[j]).sum(axis=1)  # the same order of additions wherever a vector stands
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i, side="left")
        keep = np.arange(len(i)) - first < k
        found.append((i[keep], j[keep], score[keep]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, vec: the rows that take part."""
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"  # as they came, so that rows stay small
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.filter(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vec") == (lengths["n"] if lengths else 0))


def upper_tree(rows: DataFrame) -> Tree | None:
    """The tree of a sample of at most SAMPLE rows; None without rows."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not found:
        return None
    wide = F.col("vec").cast("array<double>")
    scale = rows.agg(F.max(F.array_max(F.transform(wide, lambda x: F.abs(x))))).first()[0]
    norm = rows.agg(F.max(F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale))))).first()[0]
    return Tree(np.array([r["vec"] for r in found], dtype=np.float64), scale, norm)


def deepened(tree: Tree, indexed: DataFrame) -> bool:
    """Give leaves of more than DEEP rows trees of their own, each fitted in a task on some DEEP_SAMPLE of its rows; whether there are any."""
    counts = [(r["leaf"], r["count"]) for r in indexed.groupBy("leaf").count().collect() if r["count"] > DEEP]  # a row per leaf
    if not counts:
        return False
    share = F.broadcast(indexed.sparkSession.createDataFrame([(leaf, DEEP_SAMPLE / n) for leaf, n in counts], "leaf long, share double"))
    scale, norm = tree.scale, tree.norm

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        sub = Tree(matrix(group["vec"]), scale, norm, max(LEAF // 2, int(DEEP_LEAF * group["share"].iloc[0])))
        held = {n: (centres.astype(np.float32), children) for n, (centres, children) in sub.nodes.items()}
        return pd.DataFrame({"leaf": group["leaf"].iloc[:1].to_numpy(), "tree": [pickle.dumps((held, sub.leaves, sub.size))]})

    # indexed is a checkpoint, so a task that runs again draws the same rows
    fitted = indexed.join(share, "leaf").filter(F.rand(11) < F.col("share")).groupBy("leaf").applyInPandas(fit, "leaf long, tree binary").collect()
    trees = {}
    for r in fitted:  # at most a row per leaf of the upper tree, of some ten kilobytes
        sub = trees[r["leaf"]] = Tree(np.zeros((0, 1)))
        sub.nodes, sub.leaves, sub.size = pickle.loads(bytes(r["tree"]))
    tree.graft(trees)
    return True


def search(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, among all other rows."""
    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vec_col)
    schema = "query_id long, rank int, vec_id long, score double"
    tree = upper_tree(rows)
    if tree is None:
        return spark.createDataFrame([], schema)
    kind = rows.schema["vec"].dataType.simpleString()

    def placed(rows: DataFrame, tree: Tree) -> DataFrame:
        sent = spark.sparkContext.broadcast(tree)

        def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(leaf=sent.value.leaf_of(matrix(b["vec"])))

        return checkpointed(rows.mapInPandas(index, f"vec_id long, vec {kind}, leaf long"))

    indexed = placed(rows, tree)
    if deepened(tree, indexed):
        indexed = placed(indexed.select("vec_id", "vec"), tree)
    counts = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # a row per leaf of the tree
    tree.rows = counts
    queries = checkpointed(indexed.filter(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("q"), F.count("*").alias("own")))
    width = calibrate(indexed, queries, tree, k, recall)
    sent = spark.sparkContext.broadcast(tree)
    pack_of = packed(counts)
    packs = spark.sparkContext.broadcast(pack_of)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[tuple[int, int], list[int]] = {}
            for n, (v, own) in enumerate(zip(b["q"], b["own"], strict=True)):
                for leaf in sent.value.visit(np.asarray(v, dtype=np.float64), width, k + own):
                    if leaf in packs.value:
                        out.setdefault((n, packs.value[leaf]), []).append(leaf)
            part = b[["query_id", "q"]].iloc[[n for n, _ in out]].reset_index(drop=True)
            yield part.assign(pack=pd.Series([p for _, p in out], dtype="int64"), leaves=pd.Series(list(out.values()), dtype=object))

    routed = checkpointed(queries.mapInPandas(route, f"query_id long, q {kind}, pack long, leaves array<long>"))
    asked = {r["pack"]: r["count"] for r in routed.groupBy("pack").count().collect()}  # at most a row per leaf
    rows_of: dict[int, int] = {}
    for leaf, pack in pack_of.items():
        rows_of[pack] = rows_of.get(pack, 0) + counts[leaf]
    shape = [(leaf, pack, -(-rows_of[pack] // BLOCK), -(-asked[pack] // QUERIES)) for leaf, pack in pack_of.items() if pack in asked]
    shape = F.broadcast(spark.createDataFrame(shape, "leaf long, pack long, blocks int, turns int"))  # a row per leaf
    packed_shape = F.broadcast(shape.select("pack", "blocks", "turns").distinct())
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    left = routed.join(packed_shape, "pack").withColumn("turn", dealt("query_id", "turns")).withColumn("block", every("blocks")).select("pack", "block", "turn", "query_id", "q", "leaves")
    right = indexed.join(shape, "leaf").withColumn("block", F.floor(F.rand(13) * F.col("blocks")).cast("long")).withColumn("turn", every("turns")).select("pack", "block", "turn", "vec_id", "vec", "leaf")

    def meet(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(there):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        leaves, code = np.unique(there["leaf"].to_numpy(), return_inverse=True)
        visits = np.array([np.isin(leaves, mine) for mine in asking["leaves"]])
        q_ids, ids = asking["query_id"].to_numpy(), there["vec_id"].to_numpy()
        i, j, score = best(matrix(asking["q"]), q_ids, matrix(there["vec"]), ids, k, visits[:, code])
        return pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[j], "score": score})

    keys = ["pack", "block", "turn"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def packed(counts: dict[int, int]) -> dict[int, int]:
    """The pack of each leaf with rows: neighbours in the tree share one while they hold BLOCK rows or fewer."""
    out: dict[int, int] = {}
    pack, held = 0, 0
    for leaf in sorted(counts):
        if held and held + counts[leaf] > BLOCK:
            pack, held = pack + 1, 0
        out[leaf] = pack
        held += counts[leaf]
    return out


def exact(indexed: DataFrame, asked: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """query_id, vec_id, leaf, score: brute force over all rows for a bounded list of queries."""
    sent = indexed.sparkSession.sparkContext.broadcast((np.array([i for i, _ in asked]), np.array([v for _, v in asked], dtype=np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = sent.value
        for b in batches:
            if len(b):
                i, j, score = best(q, q_ids, matrix(b["vec"]), b["vec_id"].to_numpy(), k)
                yield b[["vec_id", "leaf"]].iloc[j].assign(query_id=q_ids[i], score=score)[["query_id", "vec_id", "leaf", "score"]]

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return indexed.mapInPandas(run, "query_id long, vec_id long, leaf long, score double").withColumn("rank", rank).filter(F.col("rank") <= k)


def calibrate(indexed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """The number of leaves to visit: the least at which sampled queries reach the recall."""
    asked = [(r["query_id"], list(r["q"])) for r in queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).collect()]
    if not asked:
        return 1
    places = {q: {leaf: n for n, leaf in enumerate(tree.visit(np.array(v, dtype=np.float64), len(tree.leaves)), 1)} for q, v in asked}
    truth = exact(indexed, asked, k).select("query_id", "leaf").collect()  # at most CALIBRATION * k rows
    needed = np.sort([places[r["query_id"]][r["leaf"]] for r in truth])
    if not len(needed):
        return 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
