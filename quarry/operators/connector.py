"""Change detection of watched directories against recorded fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import doc_id_from_path, fingerprint, path_key
from quarry.operators.parse import PARSERS, suffix

MOST_CHANGES = 2000


def eligible(listing: DataFrame) -> DataFrame:
    """Files of supported types that are neither hidden nor lock files."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return listing.filter(suffix(F.col("path")).isin(*PARSERS) & ~name.startswith(".") & ~name.startswith("~$"))


def scan_changes(listing: DataFrame, state: DataFrame, most: int = MOST_CHANGES) -> DataFrame:
    """path, path_key, fingerprint, status (new, updated or skipped), department, doc_id; at most `most` changes, by path."""
    seen = eligible(listing).withColumns({"path_key": path_key(F.col("path")), "fingerprint": fingerprint(F.col("size"), F.col("modified"))})
    old = state.select("path_key", F.col("fingerprint").alias("__old"))
    joined = seen.join(old, "path_key", "left")
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__old") != F.col("fingerprint"), "updated").otherwise("skipped")
    out = joined.withColumns({"status": status, "doc_id": doc_id_from_path(F.col("path"))}).drop("__old")
    return out.filter("status = 'skipped'").unionByName(out.filter("status != 'skipped'").orderBy("path").limit(most))


def next_state(state: DataFrame, done: DataFrame) -> DataFrame:
    """state with done files (path_key, path, fingerprint, department, doc_id, ok) recorded; failed ones keep what they had."""
    fresh = done.filter("ok").select("path_key", *[F.col(c).alias(f"__{c}") for c in ("path", "fingerprint", "department", "doc_id")])
    joined = state.join(fresh, "path_key", "full_outer")
    department = F.when(F.coalesce("__department", F.lit("")) != "", F.col("__department")).otherwise(F.col("department"))
    return joined.select("path_key", F.coalesce("__path", "path").alias("path"), F.coalesce("__fingerprint", "fingerprint").alias("fingerprint"), department.alias("department"), F.coalesce("__doc_id", "doc_id").alias("doc_id"))
