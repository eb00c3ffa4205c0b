"""Relational tables: reads split by the key's measured quantiles, writes that are applied once and as a whole."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


def _named(*names: str) -> None:
    for n in names:
        if not NAME.fullmatch(n):
            raise ValueError(f"not a plain name: {n}")


def split_points(keys: DataFrame, key: str, partitions: int) -> list:
    """Values that part a numeric key into ranges of about as many rows each; fewer where values are the same."""
    share = [i / partitions for i in range(1, partitions)]
    return sorted(set(keys.filter(F.col(key).isNotNull()).approxQuantile(key, share, 0.25 / partitions))) if share else []


def read_table(spark: SparkSession, url: str, table: str, key: str, partitions: int = 8, **options: str) -> DataFrame:
    """A table in partitions of about as many rows each, however its key is spread; rows without key are in the first."""
    _named(table, key)
    whole = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
    points = split_points(whole.select(key), key, partitions)  # reads the key alone
    if not points:
        return whole
    k = f'"{key}"'
    ranges = [f"{k} < {points[0]} OR {k} IS NULL", *[f"{k} >= {a} AND {k} < {b}" for a, b in zip(points, points[1:], strict=False)], f"{k} >= {points[-1]}"]
    return spark.read.jdbc(url, table, predicates=ranges, properties=dict(options))


def upsert_table(df: DataFrame, url: str, table: str, keys: list[str], batch: str, partitions: int = 8, **options: str) -> bool:
    """Put rows into a table in the place of those with their keys; whether this call did it.

    Tasks write a staging table; then one transaction notes the batch in `<table>_batches`, deletes the rows replaced and
    inserts those staged. A batch that is noted is not applied again, and of a writer that is lost nothing is seen in the
    table; so a retry with the same batch is safe at any point. Keys must be unique in df.
    """
    _named(table, *keys, *df.columns)
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,100}", batch):
        raise ValueError(f"not a plain batch name: {batch}")
    staging, ledger = f"{table}_staging_{re.sub('-', '_', batch)}", f"{table}_batches"
    if _applied(df.sparkSession, url, ledger, batch, options):
        return False
    df.repartition(partitions).write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", staging).options(**options).save()
    return _apply(df.sparkSession, url, table, staging, ledger, keys, df.columns, batch, options)


def _connection(spark: SparkSession, url: str, options: dict[str, str]):
    properties = spark._jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    connection.setAutoCommit(False)
    return connection


def _has(connection, table: str) -> bool:
    schema, _, name = table.rpartition(".")
    for write in (str.upper, str.lower, str):
        if connection.getMetaData().getTables(None, write(schema) if schema else None, write(name), None).next():
            return True
    return False


def _noted(connection, ledger: str, batch: str) -> bool:
    found = connection.createStatement().executeQuery(f"SELECT COUNT(*) FROM {ledger} WHERE batch = '{batch}'")
    found.next()
    return found.getInt(1) > 0


def _applied(spark: SparkSession, url: str, ledger: str, batch: str, options: dict[str, str]) -> bool:
    connection = _connection(spark, url, options)
    try:
        return _has(connection, ledger) and _noted(connection, ledger, batch)
    finally:
        connection.rollback()
        connection.close()


def _apply(spark: SparkSession, url: str, table: str, staging: str, ledger: str, keys: list[str], columns: list[str], batch: str, options: dict[str, str]) -> bool:
    connection = _connection(spark, url, options)
    run = lambda sql: connection.createStatement().executeUpdate(sql)
    quoted = lambda c: f'"{c}"'  # noqa: E731 - as the tables' columns are made
    try:
        if not _has(connection, ledger):
            run(f"CREATE TABLE {ledger} (batch VARCHAR(100) NOT NULL PRIMARY KEY)")
            connection.commit()
        if _noted(connection, ledger, batch):
            return False
        run(f"INSERT INTO {ledger} VALUES ('{batch}')")  # of two writers of a batch the second waits here, and fails
        same = " AND ".join(f"{table}.{quoted(k)} = s.{quoted(k)}" for k in keys)
        run(f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {staging} s WHERE {same})")
        names = ", ".join(map(quoted, columns))
        run(f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}")
        connection.commit()
        run(f"DROP TABLE {staging}")
        connection.commit()
        return True
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()
