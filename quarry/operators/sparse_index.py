"""A stored inverted index for BM25: postings by shard and term, with what bounds the scores of each block of chunks.

An index is a Parquet table partitioned by shard. A shard holds the chunks of its hash range, RUN neighbouring chunks of a
document together, numbered in the order of their ids; BLOCK neighbouring numbers are a block. There is a row a term: its
document frequency, the chunks' numbers and term frequencies, and for each block the pairs (term frequency, length) that
no other pair of the block beats. From these a block's largest score follows under any document frequencies and average
length, so bounds hold after updates. A row with the empty term holds the shard's chunk ids, lengths and departments.
Numbers of a term are whole columns of 32 bits, as Spark's rows and writers take lists element by element.

An update writes those shards anew that hold chunks of changed documents, before or after the change, and no others.
Document frequencies and the average length are sums over the rows of shards, so they always are those of the index.

Search reads rows of asked terms only. Queries meet each shard in turns; in a shard each query takes blocks in the order
of their bounds until these are below its k-th score, and passes on its k best. Scores are those of `retrieve.bm25_topk`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.retrieve import _in_scope, joined_tokens, ranked, tokens

#: Chunks of a block; neighbouring chunks of a document that stay in one shard; chunks and characters of a shard, about.
BLOCK, RUN, SHARD, SHARD_CHARS = 64, 256, 20_000, 8_000_000
#: Queries that meet a shard at once; asked terms up to which they are part of the scan's filter.
TURN, LISTED = 2_048, 1_000
#: What stands between tokens on their way to a shard; no token holds it.
BETWEEN = "\0"
#: What a bound may be off by: scores are rounded to six places.
SLACK = 2e-6

Analyser = Callable[[DataFrame, str, str], DataFrame]


def plain(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df with the tokens of its texts as `t`; the analyser used where none is given."""
    return df.withColumn("t", tokens(F.col(text_col)))


def shard_of(doc_id: Column, chunk_index: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.floor(chunk_index / RUN).cast("long")), F.lit(shards)).cast("int")


ROW = "shard int, term string, df long, total long, docs binary, tfs binary, sky_blocks binary, sky_tfs binary, sky_lengths binary, ids array<long>, lengths array<int>, departments array<string>"


FIELDS = pa.schema(
    [("shard", pa.int32()), ("term", pa.string()), ("df", pa.int64()), ("total", pa.int64())]
    + [(c, pa.binary()) for c in ("docs", "tfs", "sky_blocks", "sky_tfs", "sky_lengths")]
    + [("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("departments", pa.list_(pa.string()))]
)


def index_rows(chunks: DataFrame, shards: int, analyse: Analyser = plain) -> DataFrame:
    """The index's rows (ROW) of chunks (chunk_id, doc_id, chunk_index, content, department)."""
    department = (F.col("department") if "department" in chunks.columns else F.lit(None)).cast("string")
    placed = chunks.select("chunk_id", shard_of(F.col("doc_id"), F.col("chunk_index"), shards).alias("shard"), department.alias("department"), "content")
    if analyse is plain:  # the same tokens without a list of them
        text = joined_tokens(F.col("content"), BETWEEN)
    else:
        placed, text = analyse(placed, "chunk_id", "content"), F.array_join(F.filter("t", lambda w: w != ""), BETWEEN)
    placed = placed.select("shard", F.col("chunk_id").cast("long").alias("chunk_id"), "department", F.coalesce(text, F.lit("")).alias("t"))  # a text shuffles in half of an array's space
    return placed.groupBy("shard").applyInArrow(_posted, ROW)  # the tokens' only shuffle; a shard is of a bounded size


def _listed(values: np.ndarray, of: np.ndarray, rows: int) -> pa.Array:
    """Values as one binary for each row, where `of` gives their rows in ascending order."""
    ends = 4 * np.searchsorted(of, np.arange(rows + 1))
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.astype("<i4"))])


def _numbers(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of `_listed`, and how many each row has."""
    return np.frombuffer(b"".join(column), dtype="<i4").astype(np.int64), np.array([len(v) // 4 for v in column], dtype=np.int64)


def _posted(shard: pa.Table) -> pa.Table:
    """A shard's rows: by term, its postings with the pairs that bound their blocks; then the row of the chunks.

    The pairs: from the largest frequency of a block down, those whose chunk is shorter than all before.
    """
    shard = shard.sort_by("chunk_id").combine_chunks()
    texts, number = shard.column("t").combine_chunks(), shard.column("shard")[0].as_py()
    lists = pc.split_pattern(pc.if_else(pc.equal(texts, ""), None, texts), BETWEEN)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    chunks, rows = len(lengths), len(words.dictionary)
    key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * chunks + np.repeat(np.arange(chunks), lengths), return_counts=True)
    row, n = key // chunks, key % chunks
    length, block = lengths[n], n // BLOCK
    group = np.cumsum(np.r_[0, (np.diff(row) != 0) | (np.diff(block) != 0)][: len(row)])  # a term's postings of a block
    several = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, dtype=bool)  # most are alone
    order = np.flatnonzero(several)
    order = order[np.lexsort((length[order], -tf[order], group[order]))]
    least = np.minimum.accumulate(length[order] - group[order] * 2**32)  # begins anew with each block
    kept = np.sort(np.r_[np.flatnonzero(~several), order[np.r_[True, least[1:] < least[:-1]][: len(order)]]])
    none = lambda kind, rows: pa.nulls(rows, kind)
    terms = [pa.array(np.full(rows, number, dtype=np.int32)), words.dictionary.cast(pa.string()), pa.array(np.bincount(row, minlength=rows)), none(pa.int64(), rows), _listed(n, row, rows), _listed(tf, row, rows)]
    terms += [_listed(v[kept], row[kept], rows) for v in (block, tf, length)] + [none(f.type, rows) for f in list(FIELDS)[9:]]
    whole = lambda values: pa.ListArray.from_arrays(pa.array([0, chunks], pa.int32()), values)
    own = [pa.array([number], pa.int32()), pa.array([""]), pa.array([int(np.count_nonzero(lengths))]), pa.array([int(lengths.sum())]), *[none(f.type, 1) for f in list(FIELDS)[4:9]]]
    own += [whole(shard.column("chunk_id").combine_chunks()), whole(pa.array(lengths.astype(np.int32))), whole(shard.column("department").combine_chunks().cast(pa.string()))]
    return pa.concat_tables([pa.Table.from_arrays(terms, schema=FIELDS), pa.Table.from_arrays(own, schema=FIELDS)])


def write_index(chunks: DataFrame, path: str, shards: int | None = None, analyse: Analyser = plain) -> int:
    """A new index of all chunks in a folder; the number of its shards, by which updates find them."""
    if shards is None:
        n, size = chunks.agg(F.count("*"), F.sum(F.length("content"))).first()
        shards = max(1, -(-n // SHARD), -(-(size or 0) // SHARD_CHARS))
    _save(index_rows(chunks, shards, analyse), path, "overwrite")
    return shards


def _save(rows: DataFrame, path: str, mode: str) -> None:
    """Partitions in the rows take the place of their like; terms are in order, so that a scan skips to those it asks for. Rows come by shard."""
    rows.sortWithinPartitions("shard", "term").write.mode(mode).option("partitionOverwriteMode", "dynamic" if mode == "overwrite" else "static").partitionBy("shard").parquet(path)


def update_index(path: str, before: DataFrame, after: DataFrame, changed: DataFrame, shards: int, analyse: Analyser = plain) -> list[int]:
    """Bring the index from the chunks before to those after, which differ in the changed documents (doc_id) only; the shards written."""
    spark = before.sparkSession
    differ = changed.select("doc_id").distinct().withColumn("differs", F.lit(True))
    # a row a document and shard, before documents are met
    placed = lambda df: df.select("doc_id", shard_of(F.col("doc_id"), F.col("chunk_index"), shards).alias("shard")).distinct().join(differ, "doc_id", "left")
    found = placed(before).filter("differs").select("shard", "differs", F.lit(False).alias("left")).union(placed(after).select("shard", "differs", F.lit(True)))
    found = found.groupBy("shard").agg(F.max("differs").alias("differs"), F.max("left").alias("left")).filter("differs").collect()  # at most one row a shard
    touched = sorted(r["shard"] for r in found)
    if touched:
        rows = index_rows(after.filter(shard_of(F.col("doc_id"), F.col("chunk_index"), shards).isin(touched)), shards, analyse)
        # a shard that has lost all its chunks still gets a row, which says so
        gone = spark.createDataFrame([(r["shard"], "", 0, 0) for r in found if not r["left"]], "shard int, term string, df long, total long")
        _save(rows.unionByName(gone, allowMissingColumns=True) if any(not r["left"] for r in found) else rows, path, "overwrite")
    return touched


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def term_stats(index: DataFrame) -> DataFrame:
    """term, df, n_chunks, avg_length of the indexed chunks; no text is read."""
    whole = index.filter("term = ''").agg(F.sum("df").alias("n_chunks"), (F.sum("total") / F.sum("df")).alias("avg_length"))  # one row
    return index.filter("term != ''").groupBy("term").agg(F.sum("df").alias("df")).crossJoin(F.broadcast(whole))


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of ranges that begin at `low` and hold `n`, one range after the other."""
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


class Shard:
    """A shard's postings of asked terms, side by side: per term its blocks, per block its postings and the bound of their weights."""

    def __init__(self, rows: pd.DataFrame, average: float, k1: float, b: float):
        own, rows = rows[rows["term"] == ""].iloc[0], rows[(rows["term"] != "") & rows["docs"].notna()]
        self.ids, self.lengths = (np.asarray(own[c] if own[c] is not None else [], dtype=np.int64) for c in ("ids", "lengths"))
        self.departments = np.asarray(own["departments"] if own["departments"] is not None else [], dtype=object)
        self.blocks = -(-len(self.ids) // BLOCK)
        weight = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
        self.number = {t: i for i, t in enumerate(rows["term"])}
        (self.docs, n), (sky_blocks, sky_n) = _numbers(rows["docs"]), _numbers(rows["sky_blocks"])
        self.part = weight(_numbers(rows["tfs"])[0], self.lengths[self.docs])
        term = np.repeat(np.arange(len(rows)), n)
        run = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(self.docs // BLOCK) != 0)][: len(self.docs)])  # where a term's block begins
        self.low, self.size, self.block = run, np.diff(np.r_[run, len(self.docs)]), self.docs[run] // BLOCK
        sky_term = np.repeat(np.arange(len(rows)), sky_n)
        at = np.searchsorted(term[run] * (self.blocks + 1) + self.block, sky_term * (self.blocks + 1) + sky_blocks)
        self.bound = np.zeros(len(run))
        np.maximum.at(self.bound, at, weight(_numbers(rows["sky_tfs"])[0], _numbers(rows["sky_lengths"])[0]))
        self.first = np.searchsorted(term[run], np.arange(len(rows) + 1))

    def best(self, asked: list[tuple[str, float]], k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best chunks (of those seen), and the number of blocks that were scored."""
        mine = [(self.number[t], idf) for t, idf in asked if t in self.number]
        ids, scores, met, step = np.zeros(0, dtype=np.int64), np.zeros(0), 0, 16
        if not mine:
            return ids, scores, 0
        terms, idf = np.array([t for t, _ in mine]), np.array([w for _, w in mine])
        n = self.first[terms + 1] - self.first[terms]
        runs, idf = _spread(self.first[terms], n), np.repeat(idf, n)
        bound = np.bincount(self.block[runs], weights=idf * self.bound[runs], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound)]
        while met < len(order) and (len(ids) < k or bound[order[met]] + SLACK >= scores[-1]):
            these = order[met : met + step]
            if len(ids) == k:  # only those of the step that may still matter
                these = these[bound[these] + SLACK >= scores[-1]]
            met, step = met + len(these), step * 4
            place = np.full(self.blocks, -1, dtype=np.int64)
            place[these] = np.arange(len(these))
            here = place[self.block[runs]] >= 0
            at = _spread(self.low[runs[here]], self.size[runs[here]])
            docs = self.docs[at]
            total = np.bincount(place[docs // BLOCK] * BLOCK + docs % BLOCK, weights=np.repeat(idf[here], self.size[runs[here]]) * self.part[at], minlength=len(these) * BLOCK)
            total = np.round(total, 6)
            hit = np.flatnonzero(total > 0)
            docs = these[hit // BLOCK] * BLOCK + hit % BLOCK
            if seen is not None:
                hit, docs = hit[seen[docs]], docs[seen[docs]]
            ids, scores = np.concatenate([ids, self.ids[docs]]), np.concatenate([scores, total[hit]])
            kept = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[kept], scores[kept]
        return ids, scores, met


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, scope: DataFrame | None = None, analyse: Analyser = plain) -> DataFrame:
    """query_id, chunk_id, score, rank by BM25 of an index (chunk ids are longs); chunks out of scope are left out before ranking.

    Queries without a term of the index have no rows.
    """
    spark = index.sparkSession
    asked = analyse(_in_scope(queries, scope).select("query_id", "text", "__all", "__in"), "query_id", "text").select("query_id", F.array_distinct("t").alias("t"), "__all", "__in")
    whole = index.filter("term = ''").agg(F.sum("df").alias("n"), F.sum("total").alias("total")).first()
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id long, score double"
    if not whole["n"]:
        return ranked(spark.createDataFrame([], kind), k)
    n, average = whole["n"], whole["total"] / whole["n"]
    terms = asked.select(F.explode("t").alias("term")).distinct()
    few = [r[0] for r in terms.limit(LISTED + 1).collect()]
    rows = index.filter("term != ''")
    rows = rows.filter(F.col("term").isin(few)) if len(few) <= LISTED else rows.join(terms, "term", "left_semi")
    counted = rows.groupBy("term").agg(F.sum("df").alias("df"))
    weighed = asked.select("query_id", F.explode("t").alias("term")).join(counted, "term").select("query_id", F.struct("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).alias("w"))
    ready = asked.select("query_id", "__all", "__in").join(weighed.groupBy("query_id").agg(F.array_sort(F.collect_list("w")).alias("w")), "query_id")
    numbers = sorted(r[0] for r in index.select("shard").distinct().collect())  # the folder's partitions
    turns = max(1, -(-queries.count() // TURN))
    turn = F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")
    left = ready.select("query_id", "__all", "__in", "w", turn.alias("turn"), F.explode(F.array(*[F.lit(s) for s in numbers])).alias("shard"))
    own = index.filter("term = ''").select(*rows.columns)
    right = rows.unionByName(own).select("shard", "term", "docs", "tfs", "sky_blocks", "sky_tfs", "sky_lengths", "ids", "lengths", "departments", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))

    def meet(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(there):
            shard = Shard(there, average, k1, b)
            for q, every, inside, w in zip(asking["query_id"], asking["__all"], asking["__in"], asking["w"], strict=True):
                seen = None if every else np.isin(shard.departments.astype(str), list(inside)) & np.array([d is not None for d in shard.departments], dtype=bool)
                ids, scores, _ = shard.best([(x["term"], x["idf"]) for x in w], k, seen)
                out += [(q, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "chunk_id", "score"]) if out else pd.DataFrame({"query_id": pd.Series(dtype=object), "chunk_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = ["shard", "turn"]
    return ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, kind), k)
