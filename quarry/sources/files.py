"""Readers and writers: document folders, configurations, cases, the chunk store, exports, relational tables."""

from __future__ import annotations

import errno
import json
import math
import os
import re
import stat
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import safe_department, safe_id, slices, stem
from quarry.operators.catalog import replace_documents
from quarry.operators.parse import PARSERS, suffix

MOST_BYTES, EXPORTED = 50 * 1024 * 1024, 5000
AUDIT_COLUMNS = ("id", "user", "action", "resource", "detail", "ip", "created_at")
CASE = "question string, doc_id string, section_prefix string, intent string, reference string, source string"
CASE_COLUMNS = tuple(c.split()[0] for c in CASE.split(", "))
#: Subfolders of written documents.
FOLDERS = 256
#: Folders that are told apart for listing, and levels of them, at most; files and bytes that a task reads, about; rows and bytes that leave Python at once.
MOST_FOLDERS, LEVELS, TASK_FILES, TASK_BYTES, HELD_ROWS, HELD_BYTES = 10_000, 4, 1_000, 128 * 1024 * 1024, 256, 8_000_000
#: Names that Spark's readers pass over; those that aren't UTF-8 are no texts.
HIDDEN = re.compile(r"(?!_common_metadata|_metadata)(\.|_[^=]*\Z|.*\._COPYING_\Z)|.*[\ud800-\udfff]", re.DOTALL)
# First bytes that files of a type must have.
MAGIC = {"pdf": "25504446", "docx": "504B", "pptx": "504B"}


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def _children(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """path, whether it is a folder, size, modified (microseconds, of whole milliseconds as Spark has them) of what isn't hidden."""
    if not isinstance(system, fs.LocalFileSystem):
        for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if (i.is_file or i.type == fs.FileType.Directory) and not HIDDEN.match(i.base_name):
                yield i.path, not i.is_file, i.size or 0, (i.mtime_ns or 0) // 1_000_000 * 1000
        return
    try:
        with os.scandir(folder) as found:  # one by one, however many there are
            for e in found:
                if HIDDEN.match(e.name):
                    continue
                try:
                    s = e.stat()
                except OSError as x:
                    if x.errno in (errno.ENOENT, errno.ELOOP):  # gone meanwhile, or a link to nothing
                        continue
                    raise
                if stat.S_ISDIR(s.st_mode) or stat.S_ISREG(s.st_mode):
                    yield e.path, stat.S_ISDIR(s.st_mode), s.st_size, s.st_mtime_ns // 1_000_000 * 1000
    except FileNotFoundError:
        return


def _batches(rows: Iterator[tuple], names: list[str], held: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most `held` rows, and of about HELD_BYTES of bytes in their last column."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(part) >= held or size >= HELD_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names=names)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names=names)


def _listed(spark: SparkSession, folder: str, recursive: bool) -> tuple[DataFrame, str] | None:
    """(path, size, modified of the files, the folder's URI), listed in tasks; None if the folder isn't one that Python can list.

    The driver holds some folders only, from which tasks go down further, and no file.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    try:
        system, root = _system(uri)
        if system.get_file_info(root).type != fs.FileType.Directory:
            return None
    except (OSError, ValueError, NotImplementedError):
        return None

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(uri)
        folders = (at for b in batches for at in b.column(0).to_pylist())
        yield from _batches(((p[len(root) :],) for at in folders for p, inner, _, _ in _children(system, root + at) if inner), ["at"], 10_000)

    def found(system: fs.FileSystem, at: str, deep: bool) -> Iterator[tuple[str, int, int]]:
        waiting = [at]
        while waiting:
            for p, inner, size, modified in _children(system, waiting.pop()):
                if not inner:
                    yield p, size, modified
                elif deep:
                    waiting.append(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(uri)
        units = (u for b in batches for u in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(((uri + p[len(root) :], size, modified) for at, deep in units for p, size, modified in found(system, root + at, deep)), ["path", "size", "modified"], 10_000)

    flat, deep = [], [""]
    for _ in range(LEVELS if recursive else 0):
        if not deep or len(deep) >= 4 * spark.sparkContext.defaultParallelism:
            break
        inner = [r["at"] for r in spark.createDataFrame([(at,) for at in deep], "at string").mapInArrow(below, "at string").limit(MOST_FOLDERS + 1).collect()]
        if len(inner) > MOST_FOLDERS:
            break
        flat, deep = flat + deep, inner
    units = [(at, False) for at in flat] + [(at, recursive) for at in deep]
    return spark.createDataFrame(units, "at string, deep boolean").mapInArrow(run, "path string, size long, modified long"), uri


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, size, modified (microseconds): metadata only, contents aren't read. Tasks list a folder that pyarrow can open, whenever the
    table is used; of a glob or another store Spark's reader has the list in the driver, without files of no byte."""
    if made := _listed(spark, folder, recursive):
        return made[0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def _contents(listed: DataFrame, uri: str) -> DataFrame:
    """path, content of listed files, which are dealt over tasks by number and bytes. No number of files is held in the driver or by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(uri)

        def read(path: str) -> bytes:
            with system.open_input_stream(root + path[len(uri) :], compression=None) as f:
                return f.read()

        yield from _batches(((path, read(path)) for b in batches for path in b.column(0).to_pylist()), ["path", "content"], HELD_ROWS)

    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    tasks = max(1, math.ceil(size["n"] / TASK_FILES), math.ceil(size["size"] / TASK_BYTES))
    return listed.select("path").repartition(tasks, "path").mapInArrow(run, "path string, content binary")


def load_documents(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """doc_id (the file's stem), path, text of supported files; invalid bytes are replaced. Listed as by `listing`."""
    taken = suffix(F.col("path")).isin(*PARSERS)
    if made := _listed(spark, folder, recursive):
        picked = _contents(made[0].filter(taken), made[1])
    else:
        picked = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).filter(taken)
    return picked.select(stem(F.col("path")).alias("doc_id"), "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_documents(docs: DataFrame, folder: str) -> int:
    """Each document (doc_id, text) as a file `<doc_id>.txt`, in FOLDERS subfolders by hash; the number of files.

    Tasks write their own files, under hidden names first, so one that runs again replaces what it wrote and the driver moves none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(folder)
        made: set[str] = set()
        for b in batches:
            for part in slices(b):
                for sub, name, text in zip(*(part.column(c).to_pylist() for c in ("sub", "doc_id", "text")), strict=True):
                    if sub not in made:
                        system.create_dir(f"{root}/{sub}", recursive=True)
                        made.add(sub)
                    hidden = f"{root}/{sub}/_{uuid.uuid4().hex}"
                    with system.open_output_stream(hidden) as f:
                        f.write(text.encode())
                    system.move(hidden, f"{root}/{sub}/{name}.txt")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    name = F.col("doc_id").cast("string")
    rows = docs.filter("doc_id is not null and text is not null").select(F.hex(F.pmod(F.xxhash64(name), F.lit(FOLDERS))).alias("sub"), name.alias("doc_id"), "text")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def watched_dirs(spark: SparkSession, path: str) -> DataFrame:
    """path, department of the watched folders; nothing for a missing or broken file."""
    schema = "path string, department string, _broken string"
    try:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
        return rows.filter("path is not null and path != ''").select("path", F.coalesce("department", F.lit("")).alias("department"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "path string, department string")
        raise


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases with defaults: intent qa, source feedback, empty strings. A file is a JSON array, or one case a line."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v")).filter("v != ''")
    lines = F.transform(F.filter(F.split("v", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, CASE))
    rows = whole.select(F.explode(F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{CASE.replace(' string', ':string')}>>")).otherwise(lines)).alias("c")).select("c.*")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("question", "doc_id", "section_prefix", "reference")}
    return rows.withColumns(blank | {"intent": F.coalesce(F.nullif("intent", F.lit("")), F.lit("qa")), "source": F.coalesce(F.nullif("source", F.lit("")), F.lit("feedback"))})


def append_cases(cases: DataFrame, path: str) -> int:
    """Append to a folder, without de-duplication; the number of cases now there."""
    cases.select(*[F.col(c) if c in cases.columns else F.lit("").alias(c) for c in CASE_COLUMNS]).write.mode("append").json(path)
    return load_cases(cases.sparkSession, path).count()


#: Buckets of a new chunk store, by document; an update writes those anew that it touches.
BUCKETS = 64


class _Store:
    """Files of a store: parts, each a folder of a bucket's chunks, and numbered manifests that name the part of each bucket."""

    def __init__(self, spark: SparkSession, store: str):
        self.jvm, self.root = spark.sparkContext._jvm, store.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def manifests(self) -> list[int]:
        if not self.fs.exists(self.path("manifests")):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self.fs.listStatus(self.path("manifests")) if s.getPath().getName().endswith(".json"))

    def read(self, number: int) -> dict | None:
        """None while its writer is at work on it."""
        stream = self.fs.open(self.path(f"manifests/{number:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def newest(self, patience: int = 10) -> tuple[int, dict | None]:
        """(number, manifest). One that stays broken is of a writer that was lost, and counts as its number only."""
        numbers = self.manifests()
        for number in reversed(numbers):
            for _ in range(patience):
                if (found := self.read(number)) is not None:
                    return numbers[-1], found
                time.sleep(0.5)
        return (numbers[-1] if numbers else -1), None

    def commit(self, number: int, manifest: dict) -> bool:
        """Whether the number was free: a file can be made once."""
        try:
            stream = self.fs.create(self.path(f"manifests/{number:09d}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        try:
            stream.write(json.dumps(manifest).encode())
        finally:
            stream.close()
        return True


def replace_in_store(spark: SparkSession, store: str, incoming: DataFrame, buckets: int = BUCKETS) -> int:
    """The chunk store with the incoming documents' chunks replaced; the number of its version.

    Only buckets of incoming documents are written anew, as parts of their own; then a manifest names the parts that
    hold. A writer that finds its number taken begins again, so of two at once neither is lost; one that fails leaves the
    store as it was. Readers hold to the manifest that they read.
    """
    files = _Store(spark, store)
    while True:
        number, manifest = files.newest()
        parts, n = (manifest["parts"], manifest["buckets"]) if manifest else ({}, buckets)
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
        touched = [str(r[0]) for r in incoming.select(bucket.alias("b")).distinct().collect()]  # at most n rows
        old = [parts[b] for b in touched if b in parts]
        after = replace_documents(spark.read.parquet(*[f"{files.root}/{p}" for p in old]), incoming) if old else incoming
        part = f"parts/{uuid.uuid4().hex}"
        after.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{files.root}/{part}")
        if files.commit(number + 1, {"buckets": n, "parts": parts | {b: f"{part}/__bucket={b}" for b in touched}}):
            return number + 1


def read_store(spark: SparkSession, store: str) -> DataFrame | None:
    """The chunks of the newest version; None where there is none."""
    files = _Store(spark, store)
    _, manifest = files.newest()
    return spark.read.parquet(*[f"{files.root}/{p}" for p in manifest["parts"].values()]) if manifest and manifest["parts"] else None


def audit_export(rows: DataFrame, most: int = EXPORTED) -> DataFrame:
    """The newest audit rows, as they are exported."""
    return rows.select(*AUDIT_COLUMNS).orderBy(F.desc("id")).limit(most)


def write_audit_csv(rows: DataFrame, path: str) -> None:
    audit_export(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def upload_rejection(path: Column, content: Column, size: Column, department: Column, doc_id: Column) -> Column:
    """Why an upload is refused, or null."""
    kind, head = suffix(path), F.hex(F.substring(content, 1, 4))
    magic = F.lit(False)
    for name, first in MAGIC.items():
        magic = magic | ((kind == name) & ~head.startswith(first))
    return (
        F.when(~kind.isin(*PARSERS, *MAGIC), "unsupported_type").when(size > MOST_BYTES, "too_large").when(magic, "wrong_content")
        .when(~safe_department(department), "bad_department").when(~safe_id(doc_id), "bad_doc_id")
    )


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] = (0, 1), partitions: int = 8, **options: str) -> DataFrame:
    """A relational table; read in partitions of a numeric key if one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()
