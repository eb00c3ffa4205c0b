"""Streams of directory changes and of tasks, of which a run that is killed and started again loses and doubles nothing."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quarry.streaming.jobs import MOST_RETRIES, task_results

CHANGE = "path string, path_key string, size long, modified long, change string"


class _Part(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Changes(DataSourceStreamReader):
    """Offsets are numbers of listings. What changed with a listing is written down before its number is given out, so it is the same whenever it is read."""

    def __init__(self, options: dict):
        self.fs, self.folder = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.log_fs, self.log = fs.FileSystem.from_uri(options["log"]) if "://" in options["log"] else (fs.LocalFileSystem(), options["log"])
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)
        self.log_fs.create_dir(self.log, recursive=True)

    def _numbers(self) -> list[int]:
        names = [i.base_name for i in self.log_fs.get_file_info(fs.FileSelector(self.log)) if i.base_name.endswith(".json")]
        return sorted(int(n.split(".")[0]) for n in names)

    def _entry(self, number: int) -> dict:
        with self.log_fs.open_input_stream(f"{self.log}/{number:012d}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        numbers = self._numbers()
        last = numbers[-1] if numbers else 0
        before = self._entry(last)["files"] if numbers else {}
        found = [i for i in self.fs.get_file_info(fs.FileSelector(self.folder, recursive=True)) if i.is_file and (not self.suffixes or i.path.endswith(self.suffixes))]
        files = {i.path: [i.size, i.mtime_ns // 1000] for i in found}
        changes = [[p, *v, "updated" if p in before else "new"] for p, v in sorted(files.items()) if before.get(p) != v] + [[p, *v, "gone"] for p, v in sorted(before.items()) if p not in files]
        if not changes:
            return {"listing": last}
        hidden = f"{self.log}/_{uuid.uuid4().hex}"
        with self.log_fs.open_output_stream(hidden) as f:
            f.write(json.dumps({"files": files, "changes": changes}).encode())
        self.log_fs.move(hidden, f"{self.log}/{last + 1:012d}.json")
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return [_Part(n) for n in range(start["listing"] + 1, end["listing"] + 1)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, size, modified, change in self._entry(partition.number)["changes"]:
            yield path, hashlib.sha1(path.encode()).hexdigest(), size, modified, change

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["listing"]:  # the newest listing stays, to compare with
                self.log_fs.delete_file(f"{self.log}/{n:012d}.json")


class DirectoryChanges(DataSource):
    """Files of a folder that are new, changed or gone since the last listing."""

    @classmethod
    def name(cls) -> str:
        return "directory_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema: StructType) -> _Changes:
        return _Changes(self.options)


def directory_changes(spark: SparkSession, folder: str, log: str, suffixes: str = "") -> DataFrame:
    """A stream of path, path_key, size, modified (microseconds), change. `log` is a folder of this stream alone."""
    spark.dataSource.register(DirectoryChanges)
    return spark.readStream.format("directory_changes").option("path", folder).option("log", log).option("suffixes", suffixes).load()


def publish(df: DataFrame, target: str, form: str = "parquet") -> bool:
    """Write a folder that is there as a whole or not at all; whether this call made it. One that is there stays as it is."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(path(target)):
        return False
    parent, name = target.rstrip("/").rsplit("/", 1)
    hidden = f"{parent}/_{name}-{uuid.uuid4().hex}"
    df.write.format(form).save(hidden)
    return bool(system.rename(path(hidden), path(target)))


def put_tasks(tasks: DataFrame, folder: str, name: str | None = None) -> bool:
    """Tasks (doc_id, ..., retry) into a queue; those of a name once, however often they are put."""
    return publish(tasks, f"{folder}/tasks/{name or uuid.uuid4().hex}", "json")


def consume_queue(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], disabled: Callable[[], DataFrame], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run the tasks of a queue as jobs.consume_tasks does; what came of each is in `results`, a folder a batch.

    The results of a batch are published first, once; what goes back into the queue is made from these and is named by the
    batch. So a batch that runs again after a loss writes nothing twice, even if its work ends otherwise the second time.
    """

    def batch(rows: DataFrame, number: int) -> None:
        target = f"{folder}/results/batch={number}"
        tries = F.col("retry").cast("int")
        outcome = F.when(F.col("ok"), "done").when(tries < MOST_RETRIES, "retry").otherwise("dead")
        publish(task_results(rows, work, disabled()).withColumn("outcome", outcome), target)
        again = spark.read.parquet(target).filter("outcome = 'retry'").withColumn("retry", (tries + 1).cast("string"))
        put_tasks(again.select(*rows.columns), folder, f"retry-{number}")

    tasks = spark.readStream.schema(schema).json(f"{folder}/tasks/*")
    return tasks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def queue_results(spark: SparkSession, folder: str) -> DataFrame:
    """What came of the tasks so far: outcome is done, retry or dead."""
    return spark.read.parquet(f"{folder}/results")
