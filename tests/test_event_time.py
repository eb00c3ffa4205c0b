"""Streams that come out of order against the same rows as a batch."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import redaction
from quarry.streaming import event_time, jobs


@pytest.fixture
def rocks(spark):
    name, value = event_time.PROVIDER
    spark.conf.set(name, value)
    yield spark
    spark.conf.unset(name)


def run(spark, frame, name, tmp_path):
    query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)  # it ends by itself
    if query.exception():
        raise query.exception()
    return spark.sql(f"SELECT * FROM {name}").collect()


def in_triggers(spark, batches, schema, folder):
    """A stream that takes one batch a trigger."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder / f"b{n}"))
    files = sorted(folder.glob("b*/*.json"), key=lambda p: int(p.parent.name[1:]))
    once = folder / "in"
    once.mkdir()
    for n, f in enumerate(files):
        target = once / f"{n:04d}.json"
        target.write_bytes(f.read_bytes())
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(once))


def test_lockout_does_not_depend_on_the_order_of_arrival(rocks, tmp_path):
    rng, t0 = random.Random(4), 1_700_000_000
    attempts = sorted((f"u{rng.randint(0, 5)}", float(t0 + rng.randint(0, 4000)), rng.random() < 0.15) for _ in range(400))
    schema = "username string, ts double, success boolean"
    mixed = sorted(attempts, key=lambda a: a[1] + rng.uniform(0, 550))  # up to 550 s out of order, less than the watermark waits
    batches = [mixed[i : i + 40] for i in range(0, len(mixed), 40)]
    stream = in_triggers(rocks, [*batches, [("end", t0 + 1e6, True)], [("end", t0 + 2e6, True)]], schema, tmp_path)
    got = sorted((r.username, r.ts, r.outcome) for r in run(rocks, event_time.login_lockout(stream), "lockout", tmp_path) if r.username != "end")
    wanted = sorted((r.username, r.ts, r.outcome) for r in jobs.login_lockout(rocks.createDataFrame(attempts, schema)).collect())
    assert got == wanted and {o for *_, o in got} == {"ok", "failed", "locked"}


FRAME = "answer_id int, seq int, delta string, last boolean, at double"


@pytest.mark.parametrize("held", [False, True])
def test_frames_are_masked_in_their_order(rocks, tmp_path, held):
    rng, t0 = random.Random(5), 1_700_000_000
    texts = [" ".join(rng.choice(["call", "13812345678", "mail", "ann@example.com,", "key sk-abcdefgh12 .", "the end"]) for _ in range(25)) for _ in range(6)]
    frames = []
    for a, text in enumerate(texts):
        cuts = sorted({0, len(text), *rng.sample(range(1, len(text)), 30)})
        parts = [text[i:j] for i, j in zip(cuts, cuts[1:])]
        frames += [(a, n, p, n == len(parts) - 1 and a != 5, float(t0 + n)) for n, p in enumerate(parts) if not (a == 4 and n == 7)]  # one frame is lost, one answer has no end
    frames += frames[:9]  # some come twice
    mixed = sorted(frames, key=lambda f: f[4] + rng.uniform(0, 12))
    batches = [mixed[i : i + 30] for i in range(0, len(mixed), 30)]
    stream = in_triggers(rocks, [*batches, [(99, 0, "", True, t0 + 1e5)], [(99, 1, "", True, t0 + 2e5)]], FRAME, tmp_path).withColumn("at", F.timestamp_seconds("at"))
    rules = (*jobs.DEFAULT_RULES, redaction.Words("w", ("end", "the"))) if held else jobs.DEFAULT_RULES
    rows = sorted((r.answer_id, r.part, r.masked) for r in run(rocks, event_time.redact_deltas(stream, rules), f"frames{int(held)}", tmp_path))
    whole = [t if a != 4 else "".join(p for b, n, p, *_ in sorted(set(frames)) if b == 4) for a, t in enumerate(texts)]
    wanted = {r.a: r.masked for r in redaction.redacted(rocks.createDataFrame(list(enumerate(whole)), "a int, text string"), rules=rules).collect()}
    assert {a: "".join(m for b, _, m in rows if b == a) for a in wanted} == wanted
    assert held or max(p for _, p, _ in rows) > 3  # output comes before the end
    assert all([p for b, p, _ in rows if b == a] == list(range(sum(b == a for b, *_ in rows))) for a in wanted)


def test_the_state_must_be_in_rocksdb(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'u' AS username", "value AS ts", "true AS success")
    with pytest.raises(ValueError, match="RocksDB"):
        event_time.login_lockout(stream)
