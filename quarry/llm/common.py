"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of texts that a worker takes up at once, about.
HELD = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pd.DataFrame], column: str = "text", held: int = HELD) -> Iterator[pd.DataFrame]:
    """The batches in runs of rows with `held` characters or little more. Spark bounds a batch by its bytes; what is
    worked out of it may be many times larger, and is so bounded as well. Values are texts or lists of texts."""

    def size(value) -> int:
        return len(value) if isinstance(value, str) else 0 if value is None or isinstance(value, float) else sum(map(len, value))

    for b in batches:
        run = np.cumsum([size(v) for v in b[column]]) // held
        for _, part in b.groupby(run, sort=False):
            yield part.reset_index(drop=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which driver and executors share. Where the session names none, a local
    master gets one of its own, and a cluster a ValueError."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-quarry-")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def bind(value: Column, use) -> Column:
    """use(x) with x standing for value, which is then evaluated once a row."""
    return F.transform(F.array(value), use)[0]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
