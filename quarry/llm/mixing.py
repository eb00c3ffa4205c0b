"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a queue in shuffled order, up to PASSES times over. A copy's virtual
finish time is the source's tokens up to its end, divided by the source's target. Copies are ordered by
finish time over all sources and taken while their running total stays within the budget.

Running sums come from three levels: sums by bin of the order, sums of runs of bins, and a window within each bin.
A hot source is so dealt over as many bins as its documents need, and no task holds more than a few thousand rows of it.
Ranks and targets take one row a source, in one task.

Null texts and texts without words have size 0 and are not taken. Null is a source of its own, last.
Rows with equal doc_id and source are one unit of the order: taken together or not. Rows without doc_id are told apart
by their texts. Reruns agree, as the order depends on ids and texts alone. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, words_of

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
PASSES = 2
#: Rows of a source that one bin of its shuffled order holds, about; bins of the finish time up to 1.
BIN_ROWS, TIME_BINS = 2_000, 4096
#: Bins of a source that are summed together.
RUN = 1_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = PASSES) -> DataFrame:
    """source, n_docs, source_size, weight, target. One row per source; sizes has source and size.

    Targets share the budget by weight; those above cap times their source's size stop there, and the
    rest is shared again until none is above.
    """
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    picked = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    state = by_source.withColumn("weight", picked)
    # a source is capped if its ratio of cap to weight lies under the level that the budget gives the others, and ratios ascend
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    most, every = F.col("source_size") * cap, Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    state = state.withColumn("ratio", most / F.col("weight")).withColumns({
        "full": F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "open": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(every),
    })
    level = (F.lit(budget) * F.col("total") - F.coalesce("full", F.lit(0))) / F.col("open")
    first = F.min_by(level, F.when(F.col("ratio") > level, F.struct("ratio", F.col("source").isNull(), "source"))).over(every)
    state = state.withColumn("level", F.coalesce(first, F.lit(float("inf"))))
    return checkpointed(state.select("source", "n_docs", "source_size", "weight", F.least(most.cast("double"), F.col("level") * F.col("weight")).alias("target")))


def shuffle_key(id_col: Column, text: Column) -> Column:
    """The shuffled order: 32 hexadecimal digits of the MD5 of the id, or of the text of a row without."""
    return F.md5(F.coalesce(id_col.cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit("")))))


def _bin(key: Column, n_bins: Column) -> Column:
    """Bins in the order of key, equal in expectation."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 4294967296.0 * n_bins).cast("int")


def bins_before(sums: DataFrame, run: int | None = None) -> DataFrame:
    """source, bin, before: the sizes of all bins before each, by runs of bins and within each run."""
    sums = sums.withColumn("run", F.floor(F.col("bin") / (run or RUN)))
    runs = sums.groupBy("source", "run").agg(F.sum("bin_size").alias("n"))
    runs = runs.select(F.col("source").alias("s"), F.col("run").alias("r"), (F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n")).alias("earlier"))
    inside = F.sum("bin_size").over(Window.partitionBy("source", "run").orderBy("bin")) - F.col("bin_size")
    joined = sums.withColumn("inside", inside).join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    return joined.select("source", "bin", (F.col("earlier") + F.col("inside")).alias("before"))


def queue(sizes: DataFrame, targets: DataFrame, passes: int = PASSES) -> DataFrame:
    """source, key, doc_id, size, pass, finish: each unit of each source with its virtual finish time."""
    units = sizes.groupBy("source", "doc_id", "key").agg(F.sum("size").alias("size"))
    one = units.join(F.broadcast(targets) if targets.count() <= 10_000 else targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    one = one.filter(F.col("size") > 0).withColumn("bin", F.coalesce(_bin(F.col("key"), F.ceil(F.col("n_docs") / BIN_ROWS)), F.lit(0)))
    sums = bins_before(one.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))).select(F.col("source").alias("s"), F.col("bin").alias("b"), "before")
    inside = F.sum("size").over(Window.partitionBy("source", "bin").orderBy("key", "doc_id"))
    run = one.withColumn("inside", inside).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    run = run.withColumn("pass", F.explode(F.array(*[F.lit(k) for k in range(passes)])))
    done = F.col("pass") * F.col("source_size") + F.col("before") + F.col("inside")
    return run.select("source", "doc_id", "key", "size", "source_size", "target", "pass", (done / F.col("target")).alias("finish"))


def cutoffs(copies: DataFrame, budget: float) -> DataFrame:
    """source, last: the last copy taken of each source as struct(pass, key, doc_id)."""
    held = copies.withColumn("slot", F.least(F.floor(F.col("finish") * TIME_BINS), F.lit(TIME_BINS * 2)).cast("long"))
    sums = held.groupBy("slot").agg(F.sum("size").alias("n"))  # at most 2 * TIME_BINS + 1 rows
    before = sums.select(F.col("slot").alias("t"), (F.sum("n").over(Window.orderBy("slot")) - F.col("n")).alias("before"), "n")
    whole = before.filter(F.col("before") + F.col("n") <= budget).agg(F.max("t")).first()[0]
    edge = before.filter((F.col("before") <= budget) & (F.col("before") + F.col("n") > budget)).first()
    last = F.struct("pass", "key", "doc_id")
    taken = held.filter(F.col("slot") <= F.lit(-1 if whole is None else whole))
    if edge is not None:  # the only slot that is cut; it is dealt into finer ones until little is left to order
        taken = taken.unionByName(_prefix(held.filter(F.col("slot") == edge["t"]), edge["t"] / TIME_BINS, (edge["t"] + 1) / TIME_BINS, budget - edge["before"]))
    return taken.groupBy("source").agg(F.max(last).alias("last"))


def _prefix(held: DataFrame, low: float, high: float, left: float) -> DataFrame:
    """The copies of one slot whose running total stays within what is left of the budget."""
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("pass"), F.col("key"), F.col("doc_id")]
    fine = F.floor((F.col("finish") - low) / (high - low) * TIME_BINS).cast("long")
    held = held.withColumn("fine", fine)
    sums = held.groupBy("fine").agg(F.sum("size").alias("n"))
    before = sums.select("fine", (F.sum("n").over(Window.orderBy("fine")) - F.col("n")).alias("before"))
    run = held.withColumn("inside", F.sum("size").over(Window.partitionBy("fine").orderBy(*order))).join(before, "fine")
    return run.filter(F.col("before") + F.col("inside") <= left).drop("fine", "before", "inside")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(sizes, targets): a narrow row per document, and a row per source with its target and cutoff."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.size(words_of(F.col(text_col))), F.lit(0)).cast("long").alias("size"), F.col(source_col).alias("source"), shuffle_key(F.col(id_col), F.col(text_col)).alias("key"))
    sizes = checkpointed(narrow.withColumn("size", F.greatest("size", F.lit(0)).cast("long")))
    targets = source_targets(sizes, budget=budget)
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    ends = cutoffs(queue(sizes, targets), budget * total)
    ends = ends.select(F.col("source").alias("s"), "last")
    return sizes, checkpointed(targets.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def copies(last: Column, key: Column, id_col: Column, passes: int = PASSES) -> Column:
    """How often a document is taken, given its source's cutoff."""
    key = F.struct(key.alias("key"), id_col.alias("doc_id"))
    upto = F.struct(last["key"].alias("key"), last["doc_id"].alias("doc_id"))
    return F.when(last.isNull(), F.lit(0)).otherwise(last["pass"] + F.when(key <= upto, 1).otherwise(0)).cast("int")


def with_targets(df: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """df joined to its source's row; the few sources are broadcast while they are few."""
    t = targets.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("last").alias("__last"))
    return df.join(F.broadcast(t) if targets.count() <= 10_000 else t, F.col(source).eqNullSafe(F.col("__s")), "left").drop("__s")


def mix(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row per input row."""
    sizes, targets = plan(docs, budget=budget)
    joined = with_targets(sizes, targets)
    return joined.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.when(F.col("size") > 0, copies(F.col("__last"), F.col("key"), F.col("doc_id"))).otherwise(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    _, targets = plan(docs, budget=budget)
    held = docs.withColumns({"__size": F.coalesce(F.size(words_of(F.col("text"))), F.lit(0))})
    often = F.when(F.col("__size") > 0, copies(F.col("__last"), shuffle_key(F.col("doc_id"), F.col("text")), F.col("doc_id"))).otherwise(0)
    joined = with_targets(held, targets)
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), often))).select(*[docs[c] for c in docs.columns])
