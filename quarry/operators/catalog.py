"""Documents, knowledge bases and audit rows as tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import cut

# Actions that are kept in the audit log, and searchable columns.
AUDITED = ("login", "login_failed", "register", "upload", "delete", "redact", "assign", "logout")
SEARCHED = ("title", "doc_id", "department", "uploaded_by")


def page_of(df: DataFrame, order: list[Column], limit: int, offset: int, most: int) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(min(most, max(1, limit)))


def search_documents(docs: DataFrame, departments: list[str] | None = None, status: str | None = None, kb_id: int | None = None, keyword: str | None = None, field: str | None = None, limit: int = 20, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    """One page of documents within scope, newest first."""
    out = docs if departments is None else docs.filter(F.col("department").isin(departments) if departments else F.lit(False))
    if status:
        out = out.filter(F.col("status") == status)
    if kb_id is not None:
        out = out.filter(F.col("kb_id") == kb_id)
    if keyword:
        columns = [field] if field in SEARCHED else [c for c in SEARCHED if c in docs.columns]
        like, found = "%" + re.sub(r"([\\%_])", r"\\\1", keyword) + "%", F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.col(c).cast("string").ilike(like), F.lit(False))
        out = out.filter(found)
    return page_of(out, order or [F.desc("created_at"), F.desc("doc_id")], limit, offset, 100)


def audit_rows(events: DataFrame) -> DataFrame:
    """Rows whose action is kept, with resource and detail cut to their columns."""
    return events.filter(F.col("action").isin(*AUDITED)).withColumns({"resource": cut(F.col("resource"), 128), "detail": cut(F.col("detail"), 512)})


def audit_page(rows: DataFrame, action: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first, with the total on each row."""
    out = rows if action is None else rows.filter(F.col("action") == action)
    return page_of(out, [F.desc("id")], limit, offset, 500).crossJoin(F.broadcast(out.agg(F.count("*").alias("total"))))  # one row


def kb_counts(kbs: DataFrame, docs: DataFrame, keyword: str | None = None) -> DataFrame:
    """kbs with document_count: documents that aren't disabled, 0 included."""
    counts = docs.filter("status != 'disabled' and kb_id is not null").groupBy(F.col("kb_id").alias("__kb")).agg(F.count("*").alias("n"))
    out = kbs if not keyword else kbs.filter(F.col("name").ilike(f"%{keyword}%") | F.coalesce(F.col("description").ilike(f"%{keyword}%"), F.lit(False)))
    return out.join(counts, F.col("id") == F.col("__kb"), "left").withColumn("document_count", F.coalesce("n", F.lit(0).cast("long"))).drop("__kb", "n")


def move_kb(docs: DataFrame, kbs: DataFrame) -> DataFrame:
    """docs with the department of their knowledge base."""
    k = kbs.select(F.col("id").alias("__kb"), F.col("department").alias("__d"))
    return docs.join(k, F.col("kb_id") == F.col("__kb"), "left").withColumn("department", F.coalesce("__d", "department")).drop("__kb", "__d")


def assign_kb(docs: DataFrame, kbs: DataFrame, kb: str, doc_ids: list | None = None, department: str | None = None) -> DataFrame:
    """docs with those unassigned put into a knowledge base, given by id or name: of a list, else of a department, else all."""
    chosen = kbs.filter(F.col("id") == int(kb)) if kb.isdigit() else kbs.filter(F.col("name") == kb)
    target = chosen.select("id", "department").first()
    if target is None:
        raise ValueError(f"no knowledge base {kb}")
    mine = F.col("kb_id").isNull()
    if doc_ids:
        mine &= F.col("doc_id").isin(doc_ids)
    elif department:
        mine &= F.col("department") == department
    return docs.withColumns({"kb_id": F.when(mine, F.lit(target["id"])).otherwise(F.col("kb_id")), "department": F.when(mine, F.lit(target["department"])).otherwise(F.col("department"))})


def unassigned(docs: DataFrame) -> DataFrame:
    return docs.filter("kb_id is null")


def deletable_kbs(kbs: DataFrame, docs: DataFrame) -> DataFrame:
    """Knowledge bases without any document, disabled ones included."""
    return kbs.join(docs.filter("kb_id is not null").select(F.col("kb_id").alias("id")).distinct(), "id", "left_anti")


def delete_documents(docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, chunks) after the deletion of gone (doc_id): documents stay as disabled, chunks go."""
    ids = gone.select("doc_id").distinct()
    marked = docs.join(ids.withColumn("__gone", F.lit(True)), "doc_id", "left")
    hit = F.col("__gone").isNotNull()
    kept = marked.withColumns({"status": F.when(hit, "disabled").otherwise(F.col("status")), "chunk_count": F.when(hit, 0).otherwise(F.col("chunk_count"))}).drop("__gone")
    return kept.select(*docs.columns), chunks.join(ids, "doc_id", "left_anti")


def delete_sessions(messages: DataFrame, gone: DataFrame) -> DataFrame:
    return messages.join(gone.select("session_id").distinct(), "session_id", "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version of each key."""
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r"))
    return newest.select(*keys, "r.*").select(*existing.columns)


def replace_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All chunks of the incoming documents replaced; other documents untouched."""
    return existing.join(incoming.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(incoming)


# What an ad-hoc query may be made of, by the names of the parser's classes. Whatever is not listed here is refused.
PLANS = frozenset("Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedRelation OneRowRelation Join Union Except Intersect".split())
EXPRESSIONS = frozenset(
    """Literal UnresolvedAttribute UnresolvedStar UnresolvedAlias Alias SortOrder UnresolvedFunction Cast CaseWhen And Or Not EqualTo EqualNullSafe
    LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In InSubquery ListQuery Exists ScalarSubquery IsNull IsNotNull Like ILike RLike Concat Substring
    Add Subtract Multiply Divide Remainder UnaryMinus UnaryPositive WindowExpression WindowSpecDefinition UnspecifiedFrame$ SpecifiedWindowFrame
    UnboundedPreceding$ UnboundedFollowing$ CurrentRow$ RowFrame$ RangeFrame$""".split()
)
#: Functions whose result and work are bounded by what they are given.
FUNCTIONS = frozenset(
    """abs avg between bool_and bool_or ceil char_length coalesce concat concat_ws contains count count_if current_date date date_add date_diff date_format date_sub date_trunc
    datediff day dayofmonth dense_rank endswith first first_value floor greatest hour if ifnull instr lag last last_value lead least left length like lower ltrim max max_by mean
    median min min_by minute month nullif nvl percentile_approx quarter rank regexp_like replace right round row_number rtrim sign split_part startswith stddev string substr substring
    sum to_date to_timestamp trim trunc upper variance weekday when year""".split()
)


def _nodes(tree) -> Iterator[dict]:
    """All nodes of a parsed query, those of its subqueries too."""
    if isinstance(tree, dict):
        if "class" in tree:
            yield tree
        tree = tree.values()
    elif not isinstance(tree, list):
        return
    for part in tree:
        yield from _nodes(part)


def _kind(node: dict) -> str:
    return node["class"].rsplit(".", 1)[-1]


def _parts(name: str | None) -> list[str]:
    return (name or "").strip("[]").split(", ")


def _joins_by_key(condition: list[dict] | None) -> bool:
    """Whether rows meet by an equality of two columns, which stands alone or in a chain of ANDs. Nodes come parents first."""
    todo = list(condition or [])

    def take() -> tuple[dict, list]:
        node = todo.pop(0)
        return node, [take() for _ in range(node["num-children"])]

    def holds(tree: tuple[dict, list]) -> bool:
        node, below = tree
        if _kind(node) == "And":
            return any(map(holds, below))
        columns = [_parts(b["nameParts"]) for b, _ in below if _kind(b) == "UnresolvedAttribute"]
        return _kind(node) == "EqualTo" and len(columns) == 2 and columns[0] != columns[1]

    return bool(todo) and holds(take())


def guarded(spark: SparkSession, sql: str, tables: frozenset[str] = frozenset(("documents",)), most: int = 50) -> str:
    """The query with a limit; ValueError unless it is one SELECT that reads allowed tables only, by the engine's own parser.

    Every node of the parsed query must be of an allowed kind, every function of an allowed name; tables are joined by
    equal columns, and limits are plain numbers.
    """
    plain = re.sub(r"^(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)*", "", sql, flags=re.DOTALL)
    if not plain:
        raise ValueError("empty query")
    if not re.match(r"select\b", plain, re.IGNORECASE):
        raise ValueError("only SELECT is allowed")
    try:
        tree = json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(plain).toJSON())
    except Exception as e:
        raise ValueError(f"not one query: {str(e).strip().splitlines()[0]}") from e
    if plain.rstrip().endswith(";"):
        raise ValueError("more than one statement")
    for node in _nodes(tree):
        kind = _kind(node)
        if kind not in PLANS and kind not in EXPRESSIONS:
            raise ValueError(f"{kind} is not allowed")
        if kind == "UnresolvedRelation":
            name = _parts(node.get("multipartIdentifier"))
            if len(name) != 1 or name[0] not in tables or node.get("isStreaming") or node.get("options"):
                raise ValueError(f"table {'.'.join(name)} is not allowed")
        if kind == "UnresolvedFunction":
            name = _parts(node.get("nameParts"))
            if len(name) != 1 or name[0].lower() not in FUNCTIONS:
                raise ValueError(f"function {'.'.join(name)} is not allowed")
        if kind == "Join" and not _joins_by_key(node.get("condition")):
            raise ValueError("tables must be joined by equal columns")
        if kind in ("GlobalLimit", "LocalLimit", "Offset") and [_kind(n) for n in node.get("limitExpr") or node.get("offsetExpr")] != ["Literal"]:
            raise ValueError("a limit must be a number")
    return plain if _kind(tree[0]) == "GlobalLimit" else f"{plain}\nLIMIT {most}"


def query_documents(spark: SparkSession, docs: DataFrame, sql: str, most: int = 50, ceiling: int = 1000) -> DataFrame:
    """A guarded ad-hoc query over one view; long strings are cut, and no limit of the query's own goes beyond the ceiling."""
    docs.createOrReplaceTempView("documents")
    out = spark.sql(guarded(spark, sql, most=most)).limit(ceiling)
    return out.select(*[cut(F.col(f"`{n}`"), 200, "…").alias(n) if t == "string" else F.col(f"`{n}`") for n, t in out.dtypes])
