"""Directory changes and the task queue: a run that fails on the way and starts again loses and doubles nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.sources import streams

TASK = "task_id string, doc_id string, retry string"


def ended(query):
    assert query.awaitTermination(180)


def test_changes_come_once_also_after_a_failed_run(spark, tmp_path):
    folder, log, seen = tmp_path / "docs", tmp_path / "log", []
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("one")
    (folder / "sub" / "b.txt").write_text("two")
    (folder / "c.bin").write_text("no")
    fails = [False]

    def turn():
        def batch(rows, number):
            found = sorted((r.path.rsplit("/", 1)[1], r.change, r.size) for r in rows.collect())
            if fails[0]:
                raise RuntimeError("lost")
            if found:
                seen.append(found)

        query = streams.directory_changes(spark, str(folder), str(log), ".md,.txt").writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            ended(query)
        except Exception as e:
            assert "lost" in str(e)

    turn()
    assert [x for s in seen for x in s] == [("a.md", "new", 3), ("b.txt", "new", 3)]
    turn()
    assert len(seen) == 1  # nothing has changed
    (folder / "a.md").write_text("one more")
    (folder / "sub" / "b.txt").unlink()
    (folder / "d.md").write_text("")
    fails[0] = True
    turn()
    fails[0] = False
    (folder / "d.md").write_text("later")  # after the run that failed
    turn()
    turn()
    rest = [x for s in seen[1:] for x in s]
    assert sorted(rest) == [("a.md", "updated", 8), ("b.txt", "gone", 3), ("d.md", "new", 0), ("d.md", "updated", 5)]
    assert len(list(log.glob("*.json"))) <= 2 and not list(log.glob("_*"))


def test_queue_survives_failures_at_any_point(spark, tmp_path, monkeypatch):
    folder, calls = str(tmp_path / "queue"), []
    tasks = spark.createDataFrame([(f"t{i}", f"d{i % 7}", "0") for i in range(20)] + [("bad", "d1", "0"), ("last", "d2", "3"), ("off", "gone", "0")], TASK)
    assert streams.put_tasks(tasks, folder, "first") and not streams.put_tasks(tasks, folder, "first")  # once

    def work(live):
        calls.append(1)
        good = ~F.col("task_id").isin("bad", "last") if len(calls) != 1 else F.lit(True)  # ends otherwise the second time
        return live.select("task_id", good.alias("ok"), F.when(~good, "broken").alias("error"))

    disabled = lambda: spark.createDataFrame([("gone",)], "doc_id string")
    put, stops = streams.put_tasks, [0, 2]

    def fails_at_times(*args):
        stops[0] += 1
        if stops[0] in (1, 2):
            raise RuntimeError("lost")
        return put(*args)

    monkeypatch.setattr(streams, "put_tasks", fails_at_times)
    for _ in range(8):
        query = streams.consume_queue(spark, folder, TASK, work, disabled, str(tmp_path / "state"))
        try:
            ended(query)
        except Exception as e:
            assert "lost" in str(e)
    rows = [(r.task_id, r.retry, r.outcome) for r in streams.queue_results(spark, folder).collect()]
    # the first results held though the batch ran three times: all were done then
    assert sorted(rows) == sorted([(f"t{i}", "0", "done") for i in range(20)] + [("bad", "0", "done"), ("last", "3", "done")])
    put(spark.createDataFrame([("bad", "d1", "0"), ("last", "d2", "3")], TASK), folder, "second")
    for _ in range(6):
        ended(streams.consume_queue(spark, folder, TASK, work, disabled, str(tmp_path / "state")))
    rows = sorted((r.task_id, r.retry, r.outcome) for r in streams.queue_results(spark, folder).collect())
    assert [r for r in rows if r[0] == "bad"] == [("bad", "0", "done"), *[("bad", str(n), "retry") for n in range(3)], ("bad", "3", "dead")] and ("last", "3", "dead") in rows
