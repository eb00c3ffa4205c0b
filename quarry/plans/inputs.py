"""Tables of the knowledge base derived from the given tables, by SQL that both engines read alike.

Each text names tables in braces; Spark fills in views of the Parquet files, the checks fill in names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = """(SELECT doc_id, text, n_chars, source AS uploaded_by, concat('dept', CAST(CAST(substr(source, 4) AS INT) % 5 AS STRING)) AS department,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 7 END AS kb_id,
  CASE WHEN doc_id % 11 = 0 THEN 'disabled' WHEN doc_id % 13 = 0 THEN 'failed' ELSE 'indexed' END AS status, doc_id % 17 AS chunk_count,
  concat('title ', CAST(doc_id AS STRING)) AS title FROM {documents})"""
MESSAGES = """(SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn, role, text AS content,
  CASE WHEN role <> 'assistant' THEN '' WHEN (conv_id + turn) % 3 = 0 THEN 'down' WHEN (conv_id + turn) % 3 = 1 THEN 'up' ELSE '' END AS feedback,
  conv_id * 3600 + turn * 60 AS said_at FROM {conversations} WHERE role <> 'system')"""
USERS = """(SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS department, c_acctbal > 0 AS is_active,
  CASE WHEN c_custkey % 100 = 0 THEN 'super_admin' WHEN c_custkey % 10 = 1 THEN 'admin' ELSE 'user' END AS role FROM {customer})"""
SEGMENTS = "(SELECT DISTINCT c_mktsegment AS department, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS n FROM {customer})"
ADMINS = f"(SELECT u.user_id, s.department FROM {USERS} u JOIN {SEGMENTS} s ON s.n = u.user_id % 5 OR s.n = (u.user_id + 1) % 5 WHERE u.role = 'admin' AND u.user_id % 30 <> 1)"
KBS = f"(SELECT DISTINCT doc_id % 7 AS id, concat('kb', CAST(doc_id % 7 AS STRING)) AS name, concat('dept', CAST(doc_id % 7 % 5 AS STRING)) AS department, CASE WHEN doc_id % 7 = 3 THEN 'spare' END AS description FROM {{documents}})"
AUDIT = """(SELECT event_id AS id, user_id AS user, ts AS created_at, props AS detail, '10.0.0.1' AS ip, event_type AS resource,
  CASE event_type WHEN 'signup' THEN 'register' WHEN 'click' THEN 'upload' WHEN 'view' THEN 'login' WHEN 'error' THEN 'login_failed' ELSE 'buy' END AS action FROM {events})"""
REQUESTS = "(SELECT ts, 'GET' AS method, event_type AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 10 AS latency FROM {events})"
CASES = "(SELECT b.item_id AS case_id, min(d.doc_id) AS doc_id, '' AS section_prefix FROM {benchmark} b JOIN {documents} d ON contains(d.text, b.text) GROUP BY b.item_id)"
TABLES = ("documents", "conversations", "customer", "events", "benchmark", "embeddings", "labels", "pages")


#: Tables of texts, whose rows take long.
LARGE = ("documents", "pages", "conversations")


def spread(df: DataFrame, large: bool = True) -> DataFrame:
    """A small table of few splits dealt over all cores; one with as many splits as there are cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if large and df.rdd.getNumPartitions() < cores else df


def load(spark: SparkSession, sf_dir: str, sql: str, **more: DataFrame) -> DataFrame:
    """The derived table as a DataFrame."""
    named = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet"), t in LARGE) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(f"SELECT * FROM {sql}", **named, **more)


def named(sql: str) -> str:
    """The same text for an engine that knows the tables by name."""
    return sql.format(**{t: t for t in TABLES})


def chunks(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    """doc_id, department, chunk_index, page, content, chunk_id: one chunk per non-empty line; some made noisy by their position."""
    content = "CASE WHEN pos % 17 = 0 THEN concat('Page ', pos, ' of 90') WHEN pos % 19 = 0 THEN concat('1.', pos, ' intro .... 5') WHEN pos % 23 = 0 THEN concat('*** ', pos, ' ***') ELSE trim(line) END" if noisy else "trim(line)"
    # not posexplode, before which the engine puts filters that split the texts again
    lines = load(spark, sf_dir, DOCS).selectExpr("doc_id", "department", "posexplode_outer(split(text, '\n')) AS (pos, line)").filter("trim(line) <> ''")
    return lines.selectExpr("doc_id", "department", "pos AS chunk_index", "CAST(floor(pos / 10) + 1 AS INT) AS page", f"{content} AS content", "doc_id * 100000 + pos AS chunk_id")


CHUNKS = f"""(SELECT doc_id, department, pos AS chunk_index, CAST(pos // 10 + 1 AS INT) AS page, {{content}} AS content, doc_id * 100000 + pos AS chunk_id
  FROM (SELECT doc_id, department, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {named(DOCS)}) WHERE trim(line) <> '')"""
PLAIN = CHUNKS.format(content="trim(line)")
NOISY = CHUNKS.format(content="CASE WHEN pos % 17 = 0 THEN concat('Page ', pos, ' of 90') WHEN pos % 19 = 0 THEN concat('1.', pos, ' intro .... 5') WHEN pos % 23 = 0 THEN concat('*** ', pos, ' ***') ELSE trim(line) END")
REASON = r"""CASE WHEN trim(content) = '' THEN 'too_short' WHEN regexp_matches(content, '(?i)page\s*\d+\s*of\s*\d+|^\s*\d{1,3}\s*$') THEN 'header_footer'
  WHEN regexp_matches(content, '^\s*\d+(\.\d+)*\s+[A-Za-z][^\n]{0,40}([.·…]{2,}|\s+\.{2,}\s+)\s*\d{1,3}\s*$') THEN 'toc'
  WHEN NOT regexp_matches(content, '[A-Za-z]') THEN 'no_language' WHEN length(regexp_replace(content, '\s+', '', 'g')) < 10 THEN 'too_short' END"""
