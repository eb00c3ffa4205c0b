"""Streaming jobs. Each works on batch tables as well, so that the same plan can be checked by SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions.redaction import DEFAULT_RULES, Pattern, Words, redacted
from quarry.operators import connector

LATE, STEP, RATE_WINDOW = "10 minutes", "30 seconds", "5 minutes"
RATE_SECONDS = 300
BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
FAILURES, LOCK_SECONDS, MOST_RETRIES = 5, 300, 3


def request_rate(requests: DataFrame, keys: tuple[str, ...] = ("method", "path", "status"), window: str = RATE_WINDOW, step: str = STEP) -> DataFrame:
    """keys, start, requests, per_second by sliding window. In batches counts by step come first, then windows over these."""
    seconds = F.lit(float(RATE_SECONDS))
    if requests.isStreaming:
        counted = requests.withWatermark("ts", LATE).groupBy(F.window("ts", window, step).alias("w"), *keys).agg(F.count("*").alias("requests"))
    else:
        fine = requests.groupBy(F.window("ts", step).alias("f"), *keys).agg(F.count("*").alias("n"))
        counted = fine.groupBy(F.window(F.col("f.start"), window, step).alias("w"), *keys).agg(F.sum("n").alias("requests"))
    return counted.select(*keys, F.col("w.start").alias("start"), "requests", (F.col("requests") / seconds).alias("per_second"))


def latency_buckets(requests: DataFrame, keys: tuple[str, ...] = ("method", "path"), window: str = RATE_WINDOW) -> DataFrame:
    """keys, start, total, cumulative counts le_0 ... of requests at or under each bound."""
    rows = requests.withWatermark("ts", LATE) if requests.isStreaming else requests
    counts = [F.count(F.when(F.col("latency") <= b, 1)).alias(f"le_{i}") for i, b in enumerate(BUCKETS)]
    return rows.groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count("*").alias("total"), *counts).select(*keys, F.col("w.start").alias("start"), "total", *[f"le_{i}" for i in range(len(BUCKETS))])


def quantile(buckets: DataFrame, q: float = 0.95) -> Column:
    """Linear interpolation in the first bucket that reaches the rank; the last bound beyond it."""
    rank, out = F.col("total") * q, F.lit(BUCKETS[-1])
    for i in range(len(BUCKETS) - 1, -1, -1):
        below, low = (F.col(f"le_{i - 1}"), BUCKETS[i - 1]) if i else (F.lit(0), 0.0)
        inside = F.col(f"le_{i}") - below
        out = F.when(F.col(f"le_{i}") >= rank, F.lit(low) + (BUCKETS[i] - low) * (rank - below) / F.nullif(inside, F.lit(0))).otherwise(out)
    return out


def latency_p95(requests: DataFrame, keys: tuple[str, ...] = ("method", "path"), window: str = RATE_WINDOW) -> DataFrame:
    b = latency_buckets(requests, keys, window)
    return b.select(*keys, "start", "total", F.round(quantile(b), 6).alias("p95"))


def latest_gauge(samples: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """The last value of each key."""
    return samples.groupBy(*keys).agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts"))


State = tuple[int, float, float]
ATTEMPT = "username string, ts double, outcome string"


def next_attempt(state: State, ts: float, success: bool) -> tuple[State, str]:
    """(count, window end, locked until) and what comes of an attempt: ok, failed or locked."""
    count, end, until = state
    if ts < until:
        return state, "locked"
    if success:
        return (0, 0.0, 0.0), "ok"
    count, end = (1, ts + LOCK_SECONDS) if not count or ts >= end else (count + 1, end)
    return ((0, 0.0, ts + LOCK_SECONDS) if count >= FAILURES else (count, end, 0.0)), "failed"


def _run(state: State, rows: pd.DataFrame) -> tuple[State, pd.DataFrame]:
    rows = rows.sort_values(["ts", "success"], kind="stable")
    out = []
    for ts, success in zip(rows["ts"], rows["success"], strict=True):
        state, outcome = next_attempt(state, float(ts), bool(success))
        out.append(outcome)
    return state, pd.DataFrame({"username": rows["username"], "ts": rows["ts"].astype(float), "outcome": out})


def attempt_pieces(rows: DataFrame) -> DataFrame:
    """rows with the piece of their user's attempts that they are in. Before each piece lie LOCK_SECONDS or more
    without an attempt, so counts and locks have run out, and pieces don't depend on each other."""
    # such a gap always parts two stretches of LOCK_SECONDS, so cuts are sought among stretches and not among attempts
    rows = rows.withColumn("stretch", F.floor(F.nanvl("ts", F.lit(None).cast("double")) / LOCK_SECONDS))
    held = rows.groupBy("username", "stretch").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    w = Window.partitionBy("username").orderBy("stretch")
    cut = F.coalesce(F.col("first") >= F.lag("last").over(w) + F.lit(float(LOCK_SECONDS)), F.lit(True))
    held = held.withColumn("cut", F.when(cut, F.col("stretch"))).select(F.col("username").alias("u"), F.col("stretch").alias("s"), F.max("cut").over(w).alias("piece"))
    return rows.join(held, F.col("username").eqNullSafe(F.col("u")) & F.col("stretch").eqNullSafe(F.col("s"))).drop("u", "s", "stretch")


def _in_turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Outcomes of rows that come by user and piece in order of time; a piece may go on in the next batch."""
    state, of = (0, 0.0, 0.0), None
    for b in batches:
        out = []
        for user, piece, ts, success in zip(b["username"], b["piece"], b["ts"], b["success"], strict=True):
            if (user, piece) != of:
                state, of = (0, 0.0, 0.0), (user, piece)
            state, outcome = next_attempt(state, float(ts), bool(success))
            out.append(outcome)
        yield pd.DataFrame({"username": b["username"], "ts": b["ts"].astype(float), "outcome": out})


def login_lockout(attempts: DataFrame) -> DataFrame:
    """username, ts, outcome of attempts (username, ts in seconds, success); a stream keeps each user's state."""
    rows = attempts.select("username", F.col("ts").cast("double").alias("ts"), "success")
    if not attempts.isStreaming:
        dealt = attempt_pieces(rows).repartition("username", "piece").sortWithinPartitions("username", "piece", "ts", "success")
        return dealt.mapInPandas(_in_turn, ATTEMPT)

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        # a trigger's attempts of a user are put in order before they count
        state, out = _run(held.get if held.exists else (0, 0.0, 0.0), pd.concat(list(batches)))
        held.update(state)
        held.setTimeoutDuration(2 * LOCK_SECONDS * 1000)
        yield out

    return rows.groupBy("username").applyInPandasWithState(step, ATTEMPT, "count int, window_end double, locked_until double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def redact_stream(deltas: DataFrame) -> DataFrame:
    """answer_id, masked, hits: the deltas (answer_id, seq, delta) of an answer joined, then masked whole, so no match is cut."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    whole = deltas.groupBy("answer_id").agg(F.array_join(F.transform(ordered, lambda x: x["delta"]), "").alias("text"))
    return redacted(whole).select("answer_id", "masked", "hits")


def safe_cut(text: str) -> int:
    """How much of a text can be masked by the built-in rules before the rest is there: up to its last character that no
    match can hold and that is no part of a word, as a match then ends before it or begins after it."""
    for i in range(len(text), 0, -1):
        c = text[i - 1]
        if not (c.isalnum() or unicodedata.category(c)[0] == "M" or c in "._%+-@"):
            return i
    return 0


def redact_deltas(deltas: DataFrame, rules: tuple[Pattern | Words, ...] = DEFAULT_RULES, idle: str = "10 minutes") -> DataFrame:
    """answer_id, part, masked, hits: a stream of deltas (answer_id, seq, delta, last) masked part by part as it comes in.

    A part ends where no match can be cut (safe_cut); the rest is held until more comes, `last` is set, or no delta has come
    for `idle`. With other rules than the built-in ones an answer is held until its end, as any text may be a match.
    """
    whole, most = rules != DEFAULT_RULES, int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        text, part = held.get if held.exists else ("", 0)
        ended = held.hasTimedOut
        if not ended:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            text, ended = text + "".join(rows["delta"]), bool(rows["last"].any())
        cut = len(text) if ended else 0 if whole else safe_cut(text)
        if ended:
            if held.exists:
                held.remove()
        else:
            held.update((text[cut:], part + (cut > 0)))
            held.setTimeoutDuration(most)
        if cut:
            yield pd.DataFrame({"answer_id": [key[0]], "part": [part], "text": [text[:cut]]})

    kind = deltas.schema["answer_id"].dataType.simpleString()
    parts = deltas.groupBy("answer_id").applyInPandasWithState(step, f"answer_id {kind}, part int, text string", "text string, part int", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return redacted(parts, rules=rules).select("answer_id", "part", "masked", "hits")


def task_results(rows: DataFrame, work: Callable[[DataFrame], DataFrame], disabled: DataFrame) -> DataFrame:
    """The tasks of a batch with ok and error, one row each; those of disabled documents go. See consume_tasks."""
    key = "task_id" if "task_id" in rows.columns else "doc_id"
    if key == "doc_id":
        rest = [c for c in rows.columns if c != key]
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("retry").cast("int")).alias("r")).select(key, "r.*").select(*rows.columns)
    live = rows.join(disabled.select("doc_id"), "doc_id", "left_anti")
    found = work(live).groupBy(key).agg(F.min(F.coalesce("ok", F.lit(False))).alias("ok"), F.max("error").alias("error"))
    return live.join(found, key, "left").withColumns({"error": F.when(F.col("ok").isNull(), "no result").otherwise(F.col("error")), "ok": F.coalesce("ok", F.lit(False))})


def consume_tasks(tasks: DataFrame, work: Callable[[DataFrame], DataFrame], disabled: Callable[[], DataFrame], done: Callable[[DataFrame], None], retry: Callable[[DataFrame], None], dead: Callable[[DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Run ingest tasks (doc_id, ..., retry): disabled documents are dropped; work returns the key, ok and error.

    The key is task_id where tasks have one; else doc_id, and tasks of one document in a batch are one, with the most
    retries. A task for which work returns nothing, or ok that is null, has failed; of several results the worst counts.
    Failures below MOST_RETRIES go to retry with one more, others to dead. At least once; sinks must be idempotent.
    """

    def batch(rows: DataFrame, _: int) -> None:
        result = task_results(rows, work, disabled()).persist()
        try:
            done(result.filter("ok"))
            failed = result.filter("not ok").drop("ok")
            retry(failed.filter(F.col("retry").cast("int") < MOST_RETRIES).withColumn("retry", (F.col("retry").cast("int") + 1).cast("string")))
            dead(failed.filter(F.col("retry").cast("int") >= MOST_RETRIES))
        finally:
            result.unpersist()

    return tasks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def scan_once(listing: DataFrame, read_state: Callable[[], DataFrame], write_state: Callable[[DataFrame], None], ingest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One turn of the watcher: changes of a listing against the recorded state are ingested, and what was done is recorded.

    ingest takes new and updated files (path, path_key, fingerprint, status, department, doc_id) and returns path_key and
    ok; files without a result have failed and come again. Returns the changes with ok.
    """
    state = read_state()
    changes = connector.scan_changes(listing, state)
    if "department" not in changes.columns:
        changes = changes.withColumn("department", F.lit(""))
    changes = changes.filter("status != 'skipped'").persist()
    try:
        found = ingest(changes).groupBy("path_key").agg(F.min(F.coalesce("ok", F.lit(False))).alias("ok"))
        done = changes.join(found, "path_key", "left").withColumn("ok", F.coalesce("ok", F.lit(False))).persist()
        done.count()  # ingested before it is recorded
        write_state(connector.next_state(state, done))
    finally:
        changes.unpersist()
    return done


def watch_directory(spark: SparkSession, folder: str, read_state: Callable[[], DataFrame], write_state: Callable[[DataFrame], None], ingest: Callable[[DataFrame], DataFrame], checkpoint: str, every: str = "60 seconds") -> StreamingQuery:
    """scan_once of a folder again and again, at a stream's ticks. Changed files are found as well, unlike by a stream of files."""
    from quarry.sources.files import listing

    def turn(_: DataFrame, __: int) -> None:
        found = listing(spark, folder).persist()  # one look at the folder a turn
        try:
            scan_once(found, read_state, write_state, ingest).unpersist()
        finally:
            found.unpersist()

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(turn).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def watch_folder(spark: SparkSession, folder: str, most_files: int = 2000) -> DataFrame:
    """A stream of new files of an append-only folder; changed files need connector.scan_changes, run as a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", True).load(folder)

