"""The registered queries of the knowledge-base operators, each with the SQL that must give its rows."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import redaction, text
from quarry.operators import access, answer, catalog, chunk, clean, connector, evaluate, feedback, ingest, keyword_index, known, parse, retrieve, segment, sparse_index, stats, vector_index
from quarry.plans import inputs as t
from quarry.plans.inputs import load, named
from quarry.plans.registry import ORACLES, QUERIES
from quarry.sources import files
from quarry.streaming import jobs

#: 2024-01-01 in seconds.
ORIGIN = 1_704_067_200
TERMS = {"the": "a", "then": "so", "of": "from"}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, t.MESSAGES).withColumn("created_at", F.timestamp_seconds(F.lit(ORIGIN) + F.col("said_at")))


DOCS, MESSAGES, USERS, ADMINS, KBS, AUDIT, REQUESTS, CASES = map(named, (t.DOCS, t.MESSAGES, t.USERS, t.ADMINS, t.KBS, t.AUDIT, t.REQUESTS, t.CASES))
KEPT = f"(SELECT *, {t.REASON} AS reason, sha1(trim(content)) AS hash FROM {t.NOISY})"
MARKED = f"(SELECT *, reason IS NULL AND row_number() OVER (PARTITION BY doc_id, hash, reason IS NULL ORDER BY chunk_index) > 1 AS duplicate FROM {KEPT})"
REPORT = f"""(WITH m AS {MARKED}, p AS (SELECT doc_id, page, bool_and(reason IS NOT NULL OR duplicate) AS empty FROM m GROUP BY doc_id, page),
r AS (SELECT doc_id, string_agg('"' || reason || '":' || n, ',' ORDER BY reason) AS j FROM (SELECT doc_id, reason, count(*) AS n FROM m WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY doc_id),
d AS (SELECT doc_id, count(*) AS total_blocks, count(*) FILTER (reason IS NOT NULL) AS filtered_blocks, count(*) FILTER (duplicate) AS dedup_skipped,
  count(*) FILTER (reason IS NULL AND NOT duplicate) AS kept_blocks, sum(length(content)) FILTER (reason IS NULL AND NOT duplicate) AS chars FROM m GROUP BY doc_id)
SELECT doc_id, total_blocks, filtered_blocks, dedup_skipped, kept_blocks, CASE WHEN kept_blocks > 0 THEN round(chars / kept_blocks, 1) ELSE 0.0 END AS avg_chunk_length,
  (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id AND empty) AS empty_pages, '{{' || coalesce(j, '') || '}}' AS noise_reasons, 0::BIGINT AS llm_cleaned, 0::BIGINT AS llm_fallback
FROM d LEFT JOIN r USING (doc_id))"""


@query("a1_quality_report", f"SELECT * FROM {REPORT}")
def a1(spark, sf):
    return clean.reports(clean.marked(t.chunks(spark, sf, noisy=True)))


@query("a2_empty_pages", f"SELECT doc_id, empty_pages FROM {REPORT} WHERE empty_pages > 0")
def a2(spark, sf):
    return a1(spark, sf).select("doc_id", "empty_pages").filter("empty_pages > 0")


@query("p1_noise_reason", f"SELECT doc_id, chunk_index, {t.REASON} AS reason FROM {t.NOISY}")
def p1(spark, sf):
    return t.chunks(spark, sf, noisy=True).select("doc_id", "chunk_index", text.noise_reason(F.col("content")).alias("reason"))


@query("p2_filter_noise", f"SELECT doc_id, chunk_index, md5(content) AS digest FROM {t.NOISY} WHERE {t.REASON} IS NULL")
def p2(spark, sf):
    return clean.filter_noise(t.chunks(spark, sf, noisy=True)).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


GARBLED = "(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(substr(text, 1, 30), chr(65533)) WHEN 1 THEN concat('x', chr(7)) ELSE text END AS content FROM {documents})"


@query("p3_garbled", rf"SELECT doc_id FROM {named(GARBLED)} WHERE length(content) >= 20 AND (contains(content, chr(65533)) OR regexp_matches(content, '[\x00-\x08\x0e-\x1f]'))")
def p3(spark, sf):
    return load(spark, sf, GARBLED.replace("chr(65533)", "'�'")).filter(text.is_garbled(F.col("content"))).select("doc_id")


@query("p4_model_cleaning", f"""WITH r AS (SELECT *, CASE WHEN chunk_id % 2 = 0 THEN content ELSE substr(content, 1, length(content) // 3) END AS c, (chunk_id % 10) / 10 AS k FROM {t.PLAIN}),
o AS (SELECT *, chunk_id % 9 = 0 AS asked, chunk_id % 9 = 0 AND NOT length(c) < 0.5 * length(content) AND NOT k < 0.7 AS taken FROM r)
SELECT chunk_id, CASE WHEN taken THEN 'cleaned' WHEN asked THEN 'fallback' END AS llm_status, CASE WHEN taken THEN length(c) ELSE length(content) END AS n FROM o""")
def p4(spark, sf):
    chunks = t.chunks(spark, sf)
    cut = F.expr("CASE WHEN chunk_id % 2 = 0 THEN content ELSE substr(content, 1, CAST(length(content) / 3 AS INT)) END")
    results = chunks.filter("chunk_id % 9 = 0").select("doc_id", "chunk_index", cut.alias("cleaned_text"), (F.col("chunk_id") % 10 / 10).alias("confidence"))
    return clean.apply_model_cleaning(chunks, results).select("chunk_id", "llm_status", F.length("content").alias("n"))


@query("w1_chunk_dedup", f"SELECT doc_id, min(chunk_index) AS chunk_index, sha1(content) AS hash FROM {t.PLAIN} GROUP BY doc_id, sha1(content)")
def w1(spark, sf):
    return clean.dedup_chunks(t.chunks(spark, sf)).select("doc_id", "chunk_index", "hash")


@query("w1_corpus_dedup", f"SELECT arg_min(doc_id, chunk_id) AS doc_id, arg_min(chunk_index, chunk_id) AS chunk_index, sha1(content) AS hash FROM {t.PLAIN} GROUP BY sha1(content)")
def w1_corpus(spark, sf):
    return clean.dedup_chunks(t.chunks(spark, sf), scope="corpus").select("doc_id", "chunk_index", "hash")


HASHES = f"(SELECT doc_id, sha1(string_agg(content, chr(10) ORDER BY chunk_index)) AS content_hash FROM {MARKED} WHERE reason IS NULL AND NOT duplicate GROUP BY doc_id)"


def hashes(spark, sf):
    return clean.document_hashes(clean.marked(t.chunks(spark, sf, noisy=True)).filter("reason is null and not duplicate"))


@query("w2_document_dedup", f"SELECT doc_id, content_hash, nullif(min(doc_id) OVER (PARTITION BY content_hash), doc_id) AS duplicate_of FROM {HASHES}")
def w2(spark, sf):
    return clean.dedup_documents(hashes(spark, sf)).select("doc_id", "content_hash", "duplicate_of")


@query("j11_known_documents", f"""WITH h AS {HASHES}, n AS (SELECT *, nullif(min(doc_id) OVER (PARTITION BY content_hash), doc_id) AS first FROM h WHERE doc_id % 2 = 0)
SELECT doc_id, coalesce((SELECT min(k.doc_id) FROM h k WHERE k.doc_id % 3 = 0 AND k.content_hash = n.content_hash AND k.doc_id <> n.doc_id), first) AS duplicate_of FROM n""")
def j11(spark, sf):
    h = hashes(spark, sf)
    return clean.dedup_documents(h.filter("doc_id % 2 = 0"), h.filter("doc_id % 3 = 0")).select("doc_id", "duplicate_of")


@query("j11_known_store", ORACLES["j11_known_documents"])
def j11_store(spark, sf):
    path, h = folder(spark, "known"), ingest.checkpointed(hashes(spark, sf))
    for part in ("doc_id % 2 = 0", "doc_id % 2 = 1"):  # two batches
        known.add(h.filter("doc_id % 3 = 0").filter(part), path)
    came = h.filter("doc_id % 2 = 0")
    return clean.dedup_documents(came, known.find(spark, path, came)).select("doc_id", "duplicate_of")


SENSITIVE = """(SELECT doc_id, concat(text, CASE doc_id % 3 WHEN 0 THEN concat(' 138', lpad(CAST(doc_id AS STRING), 8, '0')) WHEN 1 THEN concat(' 11010119900307', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'))
  ELSE concat(' sk-abcdefgh', CAST(doc_id AS STRING)) END) AS text FROM {documents})"""
RULES_SQL = r"""SELECT doc_id, list_sort(list_filter([
  CASE WHEN regexp_matches(' ' || text || ' ', '[^0-9]1[3-9][0-9]{9}[^0-9]') THEN 'phone' END,
  CASE WHEN regexp_matches(' ' || text || ' ', '[^0-9]([0-9]{17}[0-9Xx]|[0-9]{15})[^0-9]') THEN 'id_card' END,
  CASE WHEN regexp_matches(' ' || text || ' ', '[^0-9]([0-9]{16}|[0-9]{17}|[0-9]{19})[^0-9Xx]') THEN 'bank_card' END,
  CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'email' END,
  CASE WHEN regexp_matches(text, '\b(sk|pk|ak)-[A-Za-z0-9_-]{8,}\b') THEN 'api_key' END,
  CASE WHEN regexp_matches(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b') THEN 'ipv4' END], lambda x: x IS NOT NULL)) AS hits FROM """ + named(SENSITIVE)


@query("f1_redaction_hits", f"SELECT doc_id, array_to_string(hits, ',') AS hits FROM ({RULES_SQL})")
def f1(spark, sf):
    return redaction.redacted(load(spark, sf, SENSITIVE)).select("doc_id", F.array_join("hits", ",").alias("hits"))


TAIL_SQL = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '138****' || right(lpad(doc_id::VARCHAR, 8, '0'), 4) WHEN 1 THEN '1101**********' || lpad((doc_id % 10000)::VARCHAR, 4, '0') ELSE 'sk-a' || repeat('*', length(doc_id::VARCHAR) + 3) || right('abcdefgh' || doc_id, 4) END AS tail, length(text) AS n FROM "


@query("f1_redacted_tail", TAIL_SQL + named(SENSITIVE))
def f1_tail(spark, sf):
    masked = redaction.redacted(load(spark, sf, SENSITIVE).withColumn("n", F.length("text")).withColumn("text", F.element_at(F.split("text", " "), -1)))
    return masked.select("doc_id", F.col("masked").alias("tail"), "n")


def masks_sql(text: str, pattern: str, mask: str) -> str:
    """SQL for the text with each match m replaced by mask."""
    return f"array_to_string(list_transform(list_zip(string_split_regex({text}, '{pattern}'), regexp_extract_all({text}, '{pattern}')), lambda z: z[1] || coalesce(list_transform([z[2]], lambda m: {mask})[1], '')), '')"


ENDS = "left({0}, 4) || repeat('*', length({0}) - 8) || right({0}, 4)"
#: The built-in rules one after another. Runs of digits are met whole, as this engine can't look at a match's neighbours.
TEXT_MASKS = (
    ("[0-9]+", "CASE WHEN length(m) = 11 AND regexp_matches(m, '^1[3-9]') THEN left(m, 3) || '****' || right(m, 4) ELSE m END"),
    ("[0-9]+[Xx]?", f"CASE WHEN regexp_matches(m, '^([0-9]{{17}}[0-9Xx]|[0-9]{{15}})$') THEN {ENDS.format('m')} WHEN regexp_matches(m, '^([0-9]{{18}}|[0-9]{{15}})[Xx]$') THEN {ENDS.format('left(m, -1)')} || right(m, 1) ELSE m END"),
    ("[0-9]+", f"CASE WHEN length(m) BETWEEN 16 AND 19 THEN {ENDS.format('m')} ELSE m END"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "left(m, 1) || '****@' || split_part(m, '@', 2)"),
    (r"\b(?:sk|pk|ak)-[A-Za-z0-9_-]{8,}\b", ENDS.format("m")),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "repeat('*', length(m))"),
)
TEXT_SQL = f"SELECT doc_id, text FROM {named(SENSITIVE)}"
for pattern, mask in TEXT_MASKS:
    TEXT_SQL = f"SELECT doc_id, {masks_sql('text', pattern, mask)} AS text FROM ({TEXT_SQL})"


@query("f1_redacted_text", f"SELECT doc_id, length(text) AS n, md5(text) AS digest FROM ({TEXT_SQL})")
def f1_text(spark, sf):
    return redaction.redacted(load(spark, sf, SENSITIVE)).select("doc_id", F.length("masked").alias("n"), F.md5("masked").alias("digest"))


@query("f2_configured_rules", f"SELECT doc_id, replace(text, 'the', '##') AS masked FROM (SELECT doc_id, regexp_replace(text, '[0-9@-]', '', 'g') AS text FROM documents)")
def f2(spark, sf):
    rules, mark = redaction.compile_rules({"replace_with": "##", "rules": [{"type": "word", "name": "w", "words": ["the"]}, {"type": "pattern", "name": "bad", "pattern": "("}]})
    plain = load(spark, sf, "{documents}").select("doc_id", F.regexp_replace("text", "[0-9@-]", "").alias("text"))
    return redaction.redacted(plain, rules=rules, replace_with=mark).select("doc_id", "masked")


#: Words of the benchmark's texts, in their order: some hold others.
LISTED = "(SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS w FROM benchmark)"
LISTS_SQL = f"""WITH l AS (SELECT list(w ORDER BY w) FILTER (w < 'm') AS a, list(w ORDER BY w) FILTER (w >= 'm') AS b FROM {LISTED}),
x AS (SELECT doc_id, text, list_reduce(a, lambda t, w: replace(t, w, '##'), text) AS t1, b FROM ({TEXT_SQL}), l), y AS (SELECT *, list_reduce(b, lambda t, w: replace(t, w, '##'), t1) AS t2 FROM x)
SELECT doc_id, length(t2) AS n, md5(t2) AS digest, t1 <> text AS first, t2 <> t1 AS second FROM y"""


def listed_words(spark, sf) -> list[str]:
    """A configuration: the benchmark's words."""
    words = load(spark, sf, "{benchmark}").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w")).distinct()
    return sorted(r[0] for r in words.collect())


@query("f2_word_lists", LISTS_SQL)
def f2_lists(spark, sf):
    """Built-in rules on whole texts, then two long word lists."""
    words = listed_words(spark, sf)
    lists = [{"type": "word", "name": n, "words": own} for n, own in (("first", [w for w in words if w < "m"]), ("second", [w for w in words if w >= "m"]))]
    rules, mark = redaction.compile_rules({"replace_with": "##", "rules": lists})
    masked = redaction.redacted(load(spark, sf, SENSITIVE), rules=rules, replace_with=mark)
    return masked.select("doc_id", F.length("masked").alias("n"), F.md5("masked").alias("digest"), *[F.array_contains("hits", n).alias(n) for n in ("first", "second")])


@query("f3_term_map", f"""WITH l AS (SELECT list(w ORDER BY length(w) DESC, w) AS w FROM {LISTED}),
x AS (SELECT conv_id, turn, text, list_reduce(list_filter(w, lambda a: contains(text, a)), lambda t, a: replace(t, a, upper(a)), text) AS v FROM conversations, l WHERE role = 'user')
SELECT conv_id, turn, md5(CASE WHEN v <> text THEN v ELSE '' END) AS digest FROM x""")
def f3_map(spark, sf):
    terms = {w: w.upper() for w in listed_words(spark, sf)}
    asked = load(spark, sf, "{conversations}").filter("role = 'user'")
    return asked.select("conv_id", "turn", F.md5(F.coalesce(F.get(text.expand_terms(F.col("text"), terms), F.lit(0)), F.lit(""))).alias("digest"))


@query("a7_redaction_audit", f"SELECT doc_id, array_to_string(hits, ',') AS rules FROM ({RULES_SQL}) WHERE len(hits) > 0")
def a7(spark, sf):
    return redaction.audit(redaction.redacted(load(spark, sf, SENSITIVE)))


@query("f3_expand_terms", """SELECT item_id, CASE WHEN v <> text THEN v END AS variant FROM (SELECT item_id, text, CASE WHEN contains(text, 'of') THEN replace(b, 'of', 'from') ELSE b END AS v FROM (
SELECT *, CASE WHEN contains(text, 'the') THEN replace(a, 'the', 'a') ELSE a END AS b FROM (SELECT *, replace(text, 'then', 'so') AS a FROM benchmark)))""")
def f3(spark, sf):
    return load(spark, sf, "{benchmark}").select("item_id", F.get(text.expand_terms(F.col("text"), TERMS), F.lit(0)).alias("variant"))


@query("f4_hash_embedding", "SELECT doc_id, md5(array_to_string(list_transform(range(0, 1024), lambda i: ('0x' || substr(h, 2 * (i % 32) + 1, 2))::INT), ',')) AS digest, 1024 AS dim FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def f4(spark, sf):
    v = load(spark, sf, "{documents}").select("doc_id", text.hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.md5(F.array_join(F.transform("v", lambda x: F.round(x * 255).cast("int").cast("string")), ",")).alias("digest"), F.size("v").alias("dim"))


@query("f5_content_hash", r"SELECT doc_id, sha1(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS hash FROM documents")
def f5(spark, sf):
    return load(spark, sf, "{documents}").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


#: CRC-32 of an ASCII text k: its bytes are worked in one after another, each over a table of 256 remainders.
CRC_TABLE = "(SELECT list(r ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, range(0, 8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(0, 256) v(b)))"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)"


@query("f6_chunk_id", f"SELECT doc_id, chunk_index, {CRC} & 2147483647 AS id FROM (SELECT doc_id, chunk_index, doc_id || ':' || chunk_index AS k FROM {t.PLAIN}), {CRC_TABLE}")
def f6(spark, sf):
    return t.chunks(spark, sf).select("doc_id", "chunk_index", text.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("id"))


LISTING = "(SELECT concat('/data/', source, '/', CAST(doc_id AS STRING), CASE doc_id % 10 WHEN 9 THEN '.exe' ELSE '.md' END) AS path, n_chars AS size, doc_id * 1000 AS modified, doc_id FROM {documents})"
LISTED = named(LISTING)


@query("f7_path_key", f"SELECT path, sha1(path) AS path_key, sha1(size || ':' || modified) AS fingerprint FROM {LISTED}")
def f7(spark, sf):
    return load(spark, sf, LISTING).select("path", text.path_key(F.col("path")).alias("path_key"), text.fingerprint(F.col("size"), F.col("modified")).alias("fingerprint"))


@query("f8_doc_id_from_path", r"SELECT c_custkey, CASE WHEN length(b) <= 64 THEN b ELSE substr(b, 1, 52) || '-' || substr(sha1(b), 1, 11) END AS id FROM (SELECT c_custkey, regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '-', 'g') || '-' || regexp_replace(c_name || repeat('x', c_custkey % 60), '[^A-Za-z0-9]', '-', 'g') AS b FROM customer)")
def f8(spark, sf):
    c = load(spark, sf, "{customer}").selectExpr("c_custkey", "concat('/x/', c_mktsegment, '/', c_name, repeat('x', CAST(c_custkey % 60 AS INT)), '.md') AS path")
    return c.select("c_custkey", text.doc_id_from_path(F.col("path")).alias("id"))


@query("f9_slug", "SELECT c_custkey, substr(replace(c_name, '#', '') || repeat('y', c_custkey % 60), 1, 64) AS slug FROM customer")
def f9(spark, sf):
    c = load(spark, sf, "{customer}").selectExpr("c_custkey", "concat(c_name, repeat('y', CAST(c_custkey % 60 AS INT)), '.pdf') AS name")
    return c.select("c_custkey", text.slug(F.col("name")).alias("slug"))


@query("f10_json_body", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f10(spark, sf):
    raw = load(spark, sf, "{events}").select("event_id", F.concat(F.lit("Sure: ```json\n"), F.col("props"), F.lit("\n``` done")).alias("raw"))
    return raw.select("event_id", F.get_json_object(text.json_body(F.col("raw")), "$.k").cast("long").alias("k"))


@query("f11_intent", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'qa' WHEN 1 THEN 'summary' WHEN 2 THEN 'chat' ELSE 'qa' END AS intent FROM events")
def f11(spark, sf):
    name = F.expr("CASE event_id % 4 WHEN 0 THEN 'qa' WHEN 1 THEN 'summary' WHEN 2 THEN 'chat' ELSE 'other' END")
    raw = load(spark, sf, "{events}").select("event_id", F.concat(F.lit('x {"intent": "'), name, F.lit('"}')).alias("raw"))
    return raw.select("event_id", text.intent(F.col("raw")).alias("intent"))


@query("f12_parse_refs", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 ELSE 0 END AS n, CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR END AS first FROM events")
def f12(spark, sf):
    refs = F.expr("""CASE event_id % 3 WHEN 0 THEN concat('[{"doc_id": "', event_id, '", "score": 0.5}]') WHEN 1 THEN 'broken' ELSE '{"a": 1}' END""")
    parsed = load(spark, sf, "{events}").select("event_id", text.parse_refs(refs).alias("r"))
    return parsed.select("event_id", F.size("r").alias("n"), F.get("r", F.lit(0))["doc_id"].alias("first"))


@query("p6_whitelists", r"SELECT c_custkey, regexp_matches(c_name, '^[A-Za-z0-9_-]{1,64}$') AS id_ok, regexp_matches(c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN '/x' ELSE ' x' END, '^[A-Za-z0-9_ -]{1,64}$') AS department_ok FROM customer")
def p6(spark, sf):
    c = load(spark, sf, "{customer}")
    return c.select("c_custkey", text.safe_id(F.col("c_name")).alias("id_ok"), text.safe_department(F.expr("concat(c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN '/x' ELSE ' x' END)")).alias("department_ok"))


@query("p7_search_documents", f"SELECT doc_id, department, status FROM {DOCS} WHERE department IN ('dept1', 'dept2') AND status = 'indexed' AND (title ILIKE '%1%' OR doc_id::VARCHAR ILIKE '%1%' OR department ILIKE '%1%' OR uploaded_by ILIKE '%1%') ORDER BY doc_id DESC LIMIT 100 OFFSET 5")
def p7(spark, sf):
    found = catalog.search_documents(load(spark, sf, t.DOCS), ["dept1", "dept2"], "indexed", keyword="1", limit=500, offset=5, order=[F.desc("doc_id")])
    return found.select("doc_id", "department", "status")


@query("p8_truncation", "SELECT doc_id, substr(text, 1, 128) AS resource, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS value FROM documents")
def p8(spark, sf):
    return load(spark, sf, "{documents}").select("doc_id", answer.audit_row(F.col("text"), F.col("text"))[0].alias("resource"), text.cut(F.col("text"), 200, "…").alias("value"))


@query("p9_audit_filter", f"SELECT action, count(*) AS n FROM {AUDIT} WHERE action <> 'buy' GROUP BY action")
def p9(spark, sf):
    return catalog.audit_rows(load(spark, sf, t.AUDIT)).groupBy("action").agg(F.count("*").alias("n"))


def users(spark, sf):
    return access.users_with_departments(load(spark, sf, t.USERS), load(spark, sf, t.ADMINS))


@query("p10_user_directory", f"SELECT user_id, username FROM {USERS} u WHERE username ILIKE '%#0%' AND is_active AND CASE role WHEN 'admin' THEN EXISTS (SELECT 1 FROM {ADMINS} a WHERE a.user_id = u.user_id AND a.department = 'BUILDING') ELSE department = 'BUILDING' END")
def p10(spark, sf):
    return access.find_users(users(spark, sf), name="#0", department="BUILDING", active=True).select("user_id", "username")


@query("p10_department_options", f"SELECT DISTINCT department FROM (SELECT department FROM {USERS} WHERE role = 'user' UNION ALL SELECT department FROM {ADMINS})")
def p10_options(spark, sf):
    return access.department_options(users(spark, sf))


@query("p11_guarded_sql", f"SELECT department, count(*) AS n FROM {DOCS} GROUP BY department")
def p11(spark, sf):
    return catalog.query_documents(spark, load(spark, sf, t.DOCS), "SELECT department, count(*) AS n FROM documents GROUP BY department -- all")


def keyword_cards(spark, sf) -> str:
    """An index written of other titles, then updated to the given documents: some come, some change, some go."""
    path, docs = folder(spark, "keywords"), load(spark, sf, t.DOCS).drop("text")
    kept = docs.filter("doc_id % 3 <> 0")
    before = kept.withColumn("title", F.when(F.col("doc_id") % 3 == 1, F.lit("former Title 11")).otherwise(F.col("title"))).unionByName(kept.filter("doc_id % 5 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))
    keyword_index.write_index(before, path)
    keyword_index.update_index(spark, path, before.filter("doc_id >= 1000000000"), docs.filter("doc_id % 3 < 2"))
    return path


@query("p7_stored_index", f"SELECT doc_id, department, status FROM {DOCS} WHERE department IN ('dept1', 'dept2') AND status = 'indexed' AND (title ILIKE '%1%' OR doc_id::VARCHAR ILIKE '%1%' OR department ILIKE '%1%' OR uploaded_by ILIKE '%1%') ORDER BY doc_id DESC LIMIT 100 OFFSET 5")
def p7_index(spark, sf):
    return keyword_index.search(spark, keyword_cards(spark, sf), "1", departments=["dept1", "dept2"], status="indexed", limit=500, offset=5, order=[F.desc("doc_id")]).select("doc_id", "department", "status")


@query("p7_stored_titles", f"SELECT doc_id, title FROM {DOCS} WHERE title ILIKE '%tle 11%' ORDER BY doc_id LIMIT 100")
def p7_titles(spark, sf):
    return keyword_index.search(spark, keyword_cards(spark, sf), "TLE 11", "title", limit=100, order=[F.col("doc_id")]).select("doc_id", "title")


LARGEST = """SELECT d.department, d.status, count(*) AS n, max(d.n_chars) AS most, sum(CASE WHEN d.kb_id IS NULL THEN 1 ELSE 0 END) AS free FROM {0} d
JOIN {0} e ON d.doc_id = e.doc_id AND e.title LIKE '%1%' WHERE d.doc_id IN (SELECT max(doc_id) FROM {0} GROUP BY uploaded_by, status) OR NOT d.status IN ('failed') GROUP BY d.department, d.status HAVING count(*) > 2 ORDER BY d.department, d.status LIMIT 12"""


@query("p11_guarded_join", LARGEST.format(DOCS))
def p11_join(spark, sf):
    return catalog.query_documents(spark, load(spark, sf, t.DOCS), LARGEST.format("documents"))


SCOPE = f"(SELECT user_id, TRUE AS unrestricted, NULL AS department FROM {USERS} WHERE role = 'super_admin' UNION ALL SELECT user_id, FALSE, department FROM {ADMINS} UNION ALL SELECT user_id, FALSE, department FROM {USERS} WHERE role = 'user')"


@query("j1_visible_departments", f"SELECT * FROM {SCOPE}")
def j1(spark, sf):
    return access.visible_departments(load(spark, sf, t.USERS), load(spark, sf, t.ADMINS))


@query("j2_scoped_counts", f"WITH c AS (SELECT c_mktsegment AS d, count(*) AS n FROM customer GROUP BY 1) SELECT user_id, sum(n)::BIGINT AS n FROM {SCOPE} JOIN c ON unrestricted OR d = department GROUP BY user_id")
def j2(spark, sf):
    return access.visible_counts(load(spark, sf, "{customer}"), j1(spark, sf), "c_mktsegment")


@query("j2_scoped_rows", f"SELECT user_id, c_custkey FROM {SCOPE} JOIN customer ON unrestricted OR department = c_mktsegment")
def j2_rows(spark, sf):
    return access.scoped(load(spark, sf, "{customer}"), j1(spark, sf), "c_mktsegment").select("user_id", "c_custkey")


@query("j13_users_with_departments", f"SELECT user_id, coalesce(string_agg(a.department, ',' ORDER BY a.department), '') AS departments FROM {USERS} u LEFT JOIN {ADMINS} a USING (user_id) GROUP BY user_id")
def j13(spark, sf):
    return users(spark, sf).select("user_id", F.array_join("departments", ",").alias("departments"))


STATE_SQL = f"SELECT path, sha1(path) AS path_key, sha1((size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) || ':' || modified) AS fingerprint FROM {LISTED} WHERE doc_id % 3 <> 0"


def scan(spark, sf):
    rows = load(spark, sf, LISTING)
    state = rows.filter("doc_id % 3 <> 0").select(text.path_key(F.col("path")).alias("path_key"), "path", text.fingerprint(F.expr("size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END"), F.col("modified")).alias("fingerprint"), F.lit("d").alias("department"), F.col("doc_id").cast("string").alias("doc_id"))
    return rows.drop("doc_id"), state


CHANGES = f"""(WITH s AS ({STATE_SQL}), c AS (SELECT l.path, CASE WHEN s.path IS NULL THEN 'new' WHEN s.fingerprint <> sha1(l.size || ':' || l.modified) THEN 'updated' ELSE 'skipped' END AS status
FROM {LISTED} l LEFT JOIN s USING (path) WHERE l.path NOT LIKE '%.exe') SELECT path, status FROM c WHERE status = 'skipped' UNION ALL (SELECT path, status FROM c WHERE status <> 'skipped' ORDER BY path LIMIT 2000))"""


@query("j3_connector_scan", f"SELECT * FROM {CHANGES}")
def j3(spark, sf):
    return connector.scan_changes(*scan(spark, sf)).select("path", "status")


@query("j3_next_state", f"SELECT path, CASE WHEN c.status IS NULL OR c.status = 'skipped' THEN s.fingerprint ELSE sha1(l.size || ':' || l.modified) END AS fingerprint FROM {LISTED} l LEFT JOIN {CHANGES} c USING (path) LEFT JOIN ({STATE_SQL}) s USING (path) WHERE s.path IS NOT NULL OR c.status IN ('new', 'updated')")
def j3_next(spark, sf):
    rows, state = scan(spark, sf)
    done = connector.scan_changes(rows, state).filter("status <> 'skipped'").withColumns({"ok": F.lit(True), "department": F.lit("")})
    return connector.next_state(state, done).select("path", "fingerprint")


@query("j4_question_of_answer", f"SELECT id, (SELECT arg_max(content, said_at) FROM {MESSAGES} q WHERE q.session_id = m.session_id AND q.role = 'user' AND q.said_at < m.said_at) AS question FROM {MESSAGES} m WHERE role = 'assistant' AND feedback = 'down' AND EXISTS (SELECT 1 FROM {MESSAGES} q WHERE q.session_id = m.session_id AND q.role = 'user' AND q.said_at < m.said_at)")
def j4(spark, sf):
    return feedback.questions_of_answers(messages(spark, sf)).select("id", "question")


@query("j5_new_cases", f"""WITH d AS (SELECT * FROM {MESSAGES} WHERE role = 'assistant' AND feedback = 'down' ORDER BY said_at DESC, id DESC LIMIT 160),
p AS (SELECT d.id, d.said_at, (SELECT arg_max(content, said_at) FROM {MESSAGES} q WHERE q.session_id = d.session_id AND q.role = 'user' AND q.said_at < d.said_at) AS question FROM d),
l AS (SELECT * FROM p WHERE question IS NOT NULL ORDER BY said_at DESC, id DESC LIMIT 40),
n AS (SELECT *, row_number() OVER (PARTITION BY trim(question) ORDER BY said_at DESC, id DESC) AS n FROM l WHERE trim(question) NOT IN (SELECT trim(content) FROM {MESSAGES} WHERE role = 'user' AND session_id % 5 = 0))
SELECT trim(question) AS question, id AS answer_id FROM n WHERE n = 1""")
def j5(spark, sf):
    m = messages(spark, sf)
    known = m.filter("role = 'user' and session_id % 5 = 0").select(text.strip(F.col("content")).alias("question"))
    return feedback.new_cases(m, known, limit=40).select("question", "answer_id")


SESSIONS = f"(SELECT session_id, session_id % 40 AS user_id, max(said_at) AS updated_at FROM {t.MESSAGES} GROUP BY session_id)"


@query("j6_questions_by_department", f"SELECT department, count(*) AS questions FROM (SELECT session_id FROM {MESSAGES} WHERE role = 'user') JOIN {named(SESSIONS)} USING (session_id) JOIN {USERS} USING (user_id) GROUP BY department")
def j6(spark, sf):
    return stats.questions_by_department(messages(spark, sf), load(spark, sf, SESSIONS), load(spark, sf, t.USERS))


def kbs(spark, sf):
    return load(spark, sf, t.KBS), load(spark, sf, t.DOCS)


@query("j7_kb_counts", f"SELECT id, name, (SELECT count(*) FROM {DOCS} d WHERE d.kb_id = k.id AND d.status <> 'disabled') AS document_count FROM {KBS} k WHERE name ILIKE '%kb%'")
def j7(spark, sf):
    return catalog.kb_counts(*kbs(spark, sf), keyword="KB").select("id", "name", "document_count")


@query("j8_move_kb", f"SELECT doc_id, coalesce(k.department, d.department) AS department FROM {DOCS} d LEFT JOIN {KBS} k ON d.kb_id = k.id")
def j8(spark, sf):
    k, d = kbs(spark, sf)
    return catalog.move_kb(d, k).select("doc_id", "department")


@query("j9_assign_kb", f"SELECT doc_id, CASE WHEN kb_id IS NULL AND department = 'dept1' THEN 3 ELSE kb_id END AS kb_id, CASE WHEN kb_id IS NULL AND department = 'dept1' THEN 'dept3' ELSE department END AS department FROM {DOCS}")
def j9(spark, sf):
    k, d = kbs(spark, sf)
    return catalog.assign_kb(d, k, "kb3", department="dept1").select("doc_id", "kb_id", "department")


@query("j9_unassigned", f"SELECT doc_id FROM {DOCS} WHERE kb_id IS NULL")
def j9_list(spark, sf):
    return catalog.unassigned(kbs(spark, sf)[1]).select("doc_id")


@query("j10_deletable_kbs", f"SELECT id FROM {KBS} WHERE id NOT IN (SELECT kb_id FROM {DOCS} WHERE kb_id IS NOT NULL AND kb_id < 5)")
def j10(spark, sf):
    k, d = kbs(spark, sf)
    return catalog.deletable_kbs(k, d.filter("kb_id < 5")).select("id")


@query("j12_cascade_delete", f"SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'disabled' ELSE status END AS status, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE chunk_count END AS chunk_count, (SELECT count(*) FROM {t.PLAIN} c WHERE c.doc_id = d.doc_id AND d.doc_id % 6 <> 0) AS chunks FROM {DOCS} d")
def j12(spark, sf):
    d = load(spark, sf, t.DOCS)
    docs, chunks = catalog.delete_documents(d, t.chunks(spark, sf), d.filter("doc_id % 6 = 0"))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return docs.join(counts, "doc_id", "left").select("doc_id", "status", F.col("chunk_count").cast("long").alias("chunk_count"), F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))


@query("j12_delete_sessions", f"SELECT session_id, count(*) AS n FROM {MESSAGES} WHERE session_id % 4 <> 0 GROUP BY session_id")
def j12_sessions(spark, sf):
    m = messages(spark, sf)
    return catalog.delete_sessions(m, m.filter("session_id % 4 = 0")).groupBy("session_id").agg(F.count("*").alias("n"))


@query("a3_overview", f"SELECT (SELECT count(*) FROM {USERS} WHERE is_active) AS active_users, count(*) AS documents, count(DISTINCT department) AS departments, sum(chunk_count)::BIGINT AS chunks FROM {DOCS} WHERE status <> 'disabled'")
def a3(spark, sf):
    return stats.overview(load(spark, sf, t.DOCS), load(spark, sf, t.USERS))


@query("a4_documents_by_department", f"SELECT CASE WHEN department = 'dept0' THEN '未分类' ELSE department END AS department, count(*) AS n FROM {DOCS} WHERE status <> 'disabled' GROUP BY 1")
def a4(spark, sf):
    return stats.documents_by_department(load(spark, sf, t.DOCS).withColumn("department", F.when(F.col("department") == "dept0", "").otherwise(F.col("department"))))


@query("a5_question_trend", f"""SELECT CAST(day AS VARCHAR) AS day, strftime(day, '%m-%d') AS label, (SELECT count(*) FROM {MESSAGES} WHERE role = 'user' AND CAST(TIMESTAMP '2024-01-01' + to_seconds(said_at) AS DATE) = day) AS questions
FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-01-05', INTERVAL 1 DAY)) AS DATE) AS day)""")
def a5(spark, sf):
    return stats.question_trend(messages(spark, sf), dt.date(2024, 1, 5)).withColumn("day", F.col("day").cast("string"))


@query("a6_by_status", f"SELECT status, count(*) AS n FROM {DOCS} GROUP BY status")
def a6(spark, sf):
    return stats.by_status(load(spark, sf, t.DOCS))


TOKENS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
POSTED = f"(SELECT chunk_id, len(w) AS length, unnest(w) AS term FROM (SELECT chunk_id, {TOKENS.format('content')} AS w FROM {t.PLAIN}))"
STATS = f"(SELECT term, count(DISTINCT chunk_id) AS df, (SELECT count(DISTINCT chunk_id) FROM {POSTED}) AS n_chunks, (SELECT avg(length) FROM (SELECT DISTINCT chunk_id, length FROM {POSTED})) AS avg_length FROM {POSTED} GROUP BY term)"
ASKED = f"(SELECT query_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM (SELECT item_id AS query_id, text FROM benchmark))"
BM25 = f"""(WITH p AS (SELECT chunk_id, term, length, count(*) AS tf FROM {POSTED} GROUP BY ALL), s AS {STATS}, q AS {ASKED},
g AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score FROM q JOIN s USING (term) JOIN p USING (term) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM g QUALIFY rank <= 10)"""


def benchmark(spark, sf):
    return load(spark, sf, "{benchmark}").select(F.col("item_id").alias("query_id"), "text")


@query("a12_term_stats", f"SELECT term, df, n_chunks, round(avg_length, 6) AS avg_length FROM {STATS}")
def a12(spark, sf):
    return retrieve.term_stats(t.chunks(spark, sf)).withColumn("avg_length", F.round("avg_length", 6))


@query("w7_bm25", f"SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM {BM25}")
def w7(spark, sf):
    return retrieve.bm25_topk(t.chunks(spark, sf), benchmark(spark, sf)).withColumn("score", F.round("score", 4)).select("query_id", "chunk_id", "score", "rank")


def updated_index(spark, sf) -> DataFrame:
    """An index written of other texts, then updated: a third of the documents come new, a third change, some go."""
    path = folder(spark, "postings")
    after = t.chunks(spark, sf)
    kept = after.filter("doc_id % 3 <> 0")
    before = kept.withColumn("content", F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("former text "), "content")).otherwise(F.col("content"))).unionByName(kept.filter("doc_id % 5 = 0").selectExpr("doc_id + 1000000000 AS doc_id", "department", "chunk_index", "page", "content", "chunk_id + 100000000000000 AS chunk_id"))
    shards = sparse_index.write_index(before, path)
    ids = load(spark, sf, t.DOCS).select("doc_id")
    changed = ids.filter("doc_id % 3 <> 2").union(ids.filter("doc_id % 3 <> 0 and doc_id % 5 = 0").selectExpr("doc_id + 1000000000"))
    sparse_index.update_index(path, before, after, changed, shards)
    return sparse_index.read_index(spark, path)


@query("w7_stored_index", f"SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM {BM25}")
def w7_index(spark, sf):
    return sparse_index.search_index(updated_index(spark, sf), benchmark(spark, sf)).withColumn("score", F.round("score", 4)).select("query_id", "chunk_id", "score", "rank")


@query("a12_index_stats", f"SELECT term, df, n_chunks, round(avg_length, 6) AS avg_length FROM {STATS}")
def a12_index(spark, sf):
    return sparse_index.term_stats(updated_index(spark, sf)).withColumn("avg_length", F.round("avg_length", 6))


#: Letters in the place of which Chinese characters stand, so that each word of the given texts is a run.
SCRIPT = "".join(map(chr, range(0x4E00, 0x4E00 + 26)))
RUN_SQL = "(SELECT {0}, unnest(regexp_extract_all(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '" + SCRIPT + "'), '[一-鿿]+')) AS run FROM {1})"
DICTIONARY = f"""(WITH r AS (SELECT run, count(*) AS c FROM {RUN_SQL.format('doc_id', 'documents')} GROUP BY run),
p AS (SELECT run, c, unnest(range(1, length(run) + 1)) AS i FROM r), s AS (SELECT run, c, i, unnest(range(1, least(4, length(run) - i + 1) + 1)) AS k FROM p),
g AS (SELECT substr(run, i, k) AS word, sum(c)::BIGINT AS n FROM s GROUP BY 1), h AS (SELECT * FROM g WHERE length(word) = 1 OR n >= 2),
t AS (SELECT sum(n) AS letters FROM h WHERE length(word) = 1), c AS (SELECT word, n, unnest(range(1, length(word))) AS i FROM h WHERE length(word) > 1),
l AS (SELECT DISTINCT c.word FROM c JOIN h a ON a.word = c.word[:i] JOIN h b ON b.word = c.word[i + 1:], t WHERE c.n * letters < 4 * a.n * b.n)
SELECT word, n FROM h WHERE word NOT IN (SELECT word FROM l))"""


@query("w7_dictionary", f"SELECT word, n FROM {DICTIONARY}")
def w7_dictionary(spark, sf):
    return segment.dictionary(in_script(load(spark, sf, "{documents}")), "text")


def in_script(df):
    return df.withColumn("text", F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", SCRIPT))


@query("w7_segmented_runs", f"""WITH RECURSIVE d AS MATERIALIZED {DICTIONARY}, k AS MATERIALIZED (SELECT word, round(1000000 * ln((SELECT sum(n) FROM d) / n))::BIGINT AS cost FROM d),
r AS MATERIALIZED (SELECT DISTINCT run FROM {RUN_SQL.format('item_id', 'benchmark')}), u AS (SELECT round(1000000 * ln(2 * sum(n)))::BIGINT AS unknown FROM d),
e AS MATERIALIZED (SELECT run, i, n, coalesce(cost, unknown) AS cost FROM (SELECT run, i, unnest(range(1, least(4, length(run) - i + 1) + 1)) AS n FROM (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM r)) LEFT JOIN k ON word = substr(run, i, n), u WHERE cost IS NOT NULL OR n = 1),
w AS (SELECT run, 1::BIGINT AS place, 0::BIGINT AS cost, []::BIGINT[] AS cuts FROM r UNION ALL SELECT w.run, w.place + e.n, w.cost + e.cost, list_append(cuts, e.n) FROM w JOIN e ON e.run = w.run AND e.i = w.place),
b AS (SELECT run, arg_min(cuts, (cost, list_transform(cuts, lambda c: -c))) AS cuts FROM w WHERE place > length(run) GROUP BY run)
SELECT run, array_to_string(list_transform(range(1, len(cuts) + 1), lambda i: substr(run, list_sum([0] || cuts[:i - 1])::BIGINT + 1, cuts[i])), ' ') AS words FROM b""")
def w7_segments(spark, sf):
    words = w7_dictionary(spark, sf)
    runs = in_script(load(spark, sf, "{benchmark}")).select(F.explode(segment.runs_of(F.col("text"))).alias("run"))
    return segment.words_of_runs(runs, words).select("run", F.array_join("words", " ").alias("words"))


VECTORS = "(SELECT vec_id, embedding AS vector, concat('dept', CAST(label % 5 AS STRING)) AS department FROM {embeddings})"


def vectors(spark, sf):
    v = load(spark, sf, VECTORS)
    return v.withColumnRenamed("vec_id", "chunk_id"), v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector", F.col("department").alias("own"))


def cosine(where: str) -> str:
    return f"""(WITH v AS {named(VECTORS)}, g AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])), 6) AS score
FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND {where}) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM g QUALIFY rank <= 10)"""


@query("w6_dense", f"SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM {cosine('TRUE')}")
def w6(spark, sf):
    return retrieve.dense_topk(*vectors(spark, sf), itself=False).withColumn("score", F.round("score", 4))


@query("j2_dense_in_scope", f"SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM {cosine('q.department = c.department')}")
def j2_dense(spark, sf):
    chunks, queries = vectors(spark, sf)
    scope = queries.select("query_id", F.lit(False).alias("unrestricted"), F.col("own").alias("department"))
    return retrieve.dense_topk(chunks, queries, scope=scope, itself=False).withColumn("score", F.round("score", 4))


def updated_vectors(spark, sf):
    """An index written of other vectors, then updated to the given ones: some come, some change, some go."""
    chunks, queries = vectors(spark, sf)
    path = folder(spark, "vectors")
    kept = chunks.filter("chunk_id % 4 <> 0")
    before = kept.withColumn("vector", F.when(F.col("chunk_id") % 4 == 1, F.reverse("vector")).otherwise(F.col("vector"))).unionByName(kept.filter("chunk_id % 5 = 0").withColumn("chunk_id", F.col("chunk_id") + 1_000_000_000))
    vector_index.write_index(before, path)
    vector_index.update_index(spark, path, before.filter("chunk_id >= 1000000000"), chunks.filter("chunk_id % 4 < 2"))
    return *vector_index.read_index(spark, path), queries


@query("w6_stored_index", f"SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM {cosine('TRUE')}")
def w6_index(spark, sf):
    return vector_index.search_index(*updated_vectors(spark, sf), itself=False, exact=True).withColumn("score", F.round("score", 4))


@query("j2_stored_index_in_scope", f"SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM {cosine('q.department = c.department')}")
def j2_index(spark, sf):
    index, model, queries = updated_vectors(spark, sf)
    scope = queries.select("query_id", F.lit(False).alias("unrestricted"), F.col("own").alias("department"))
    return vector_index.search_index(index, model, queries, scope=scope, itself=False, exact=True).withColumn("score", F.round("score", 4))


LISTS = "(SELECT c_custkey % 50 AS query_id, c_custkey AS chunk_id, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY {0}, c_custkey) AS rank FROM {{customer}})"
LEFT, RIGHT = LISTS.format("c_acctbal"), LISTS.format("c_name DESC")
FUSED = f"""(WITH b AS (SELECT *, 0 AS side FROM {named(LEFT)} WHERE rank <= 15 UNION ALL SELECT *, 1 FROM {named(RIGHT)} WHERE rank <= 15),
g AS (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS raw, min(side * 1000 + rank) AS f FROM b GROUP BY ALL)
SELECT query_id, chunk_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, f, chunk_id) AS rank FROM g QUALIFY rank <= 10)"""


def fused(spark, sf):
    left, right = load(spark, sf, LEFT).filter("rank <= 15"), load(spark, sf, RIGHT).filter("rank <= 15")
    return retrieve.rrf(left, right)


@query("w3_rrf", f"SELECT * FROM {FUSED}")
def w3(spark, sf):
    return fused(spark, sf)


@query("w8_rerank", f"""WITH f AS {FUSED}, s AS (SELECT *, CASE WHEN query_id % 2 = 0 AND chunk_id % 3 <> 0 THEN (chunk_id * 37 % 101) / 101 END AS rel FROM f)
SELECT query_id, chunk_id, CASE WHEN bool_or(rel IS NOT NULL) OVER (PARTITION BY query_id) THEN round(coalesce(rel, 0), 6) ELSE score END AS score, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC NULLS LAST, rank) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rel DESC NULLS LAST, rank) <= 5""")
def w8(spark, sf):
    f = fused(spark, sf)
    scores = f.filter("query_id % 2 = 0 and chunk_id % 3 <> 0").selectExpr("query_id", "chunk_id", "(chunk_id * 37 % 101) / 101 AS relevance")
    return retrieve.rerank(f, scores, 5)


@query("w4_merge_queries", f"""WITH h AS (SELECT *, query_id // 2 AS question_id, query_id % 2 AS query_pos FROM (SELECT query_id, chunk_id % 20 AS chunk_id, rank, 0.5 AS score FROM {named(LEFT)} WHERE rank <= 8)),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY query_pos, rank) AS n FROM h)
SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY query_pos, rank) AS rank FROM o WHERE n = 1""")
def w4(spark, sf):
    hits = load(spark, sf, LEFT).filter("rank <= 8").selectExpr("query_id div 2 AS question_id", "query_id % 2 AS query_pos", "chunk_id % 20 AS chunk_id", "rank", "0.5 AS score")
    return retrieve.merge_queries(hits).select("question_id", "chunk_id", "rank")


@query("w9_hybrid_search", f"""WITH c AS {t.PLAIN}, q AS (SELECT item_id AS query_id, text FROM benchmark),
d AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(list_cosine_similarity(list_transform(range(0, 8), lambda i: ('0x' || substr(sha256(q.text), 2 * i + 1, 2))::INT / 255), list_transform(range(0, 8), lambda i: ('0x' || substr(sha256(c.content), 2 * i + 1, 2))::INT / 255)), 6) AS score FROM q, c) QUALIFY rank <= 10),
b AS (SELECT query_id, chunk_id, rank, 0 AS side FROM d UNION ALL SELECT query_id, chunk_id, rank, 1 FROM {BM25}), g AS (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS raw, min(side * 1000 + rank) AS f FROM b GROUP BY ALL)
SELECT query_id, chunk_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, f, chunk_id) AS rank FROM g QUALIFY rank <= 10""")
def w9(spark, sf):
    embed = lambda df, c: df.withColumn("vector", F.slice(text.hash_embedding(F.col(c), 32), 1, 8))
    return retrieve.search(embed(t.chunks(spark, sf), "content"), embed(benchmark(spark, sf), "text"))


@query("w10_needs_rewrite", f"WITH f AS {FUSED} SELECT q AS query_id, (s IS NULL OR s < 0.0325) AND q % 3 < 2 AS needs_rewrite FROM (SELECT DISTINCT c_custkey % 60 AS q FROM customer) LEFT JOIN (SELECT query_id, score AS s FROM f WHERE rank = 1) ON q = query_id")
def w10(spark, sf):
    questions = load(spark, sf, "{customer}").selectExpr("c_custkey % 60 AS query_id").distinct().withColumn("rewrite_count", F.col("query_id") % 3)
    return retrieve.needs_rewrite(questions, fused(spark, sf), least=0.0325)


HIT_SQL = f"(SELECT case_id, min(rank) AS hit_rank FROM {CASES} c LEFT JOIN (SELECT query_id, chunk_id // 100000 AS d, rank FROM {BM25}) h ON h.query_id = c.case_id AND h.d = c.doc_id GROUP BY case_id)"


def cases(spark, sf) -> DataFrame:
    """Rows of t.CASES: every document is passed once, by an automaton of all questions, and not once a question."""
    asked = load(spark, sf, "{benchmark}").filter("text is not null").select("item_id", "text")
    held = retrieve.contained(load(spark, sf, "{documents}"), asked, "doc_id", "item_id")
    return held.groupBy(F.col("item_id").alias("case_id")).agg(F.min("doc_id").alias("doc_id")).withColumn("section_prefix", F.lit(""))


def ranks(spark, sf):
    hits = retrieve.bm25_topk(t.chunks(spark, sf), benchmark(spark, sf)).select("query_id", (F.col("chunk_id") / 100000).cast("long").alias("doc_id"), F.lit("").alias("section_path"), "rank")
    return evaluate.hit_rank(cases(spark, sf), hits)


@query("w5_hit_rank", f"SELECT * FROM {HIT_SQL}")
def w5(spark, sf):
    return ranks(spark, sf)


@query("a8_retrieval_metrics", f"SELECT count(*) AS cases, count(*) FILTER (hit_rank <= 5) AS hits, round(sum(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0.0 END) / count(*), 3)::DOUBLE AS recall_at_k, round(sum(CASE WHEN hit_rank <= 5 THEN 1 / hit_rank ELSE 0.0 END) / count(*), 3)::DOUBLE AS mrr FROM {HIT_SQL}")
def a8(spark, sf):
    return evaluate.retrieval_metrics(ranks(spark, sf))


@query("a9_metric_means", "SELECT 'quality' AS metric, round(avg(quality), 3) AS mean FROM labels UNION ALL SELECT 'toxic', round(avg(toxic), 3) FROM labels")
def a9(spark, sf):
    return evaluate.metric_means(load(spark, sf, "{labels}"), ["quality", "toxic"])


BASE = "(SELECT * FROM (VALUES ('mrr', 0.5), ('quality', 0.99), ('toxic', 0.0)) AS v(metric, baseline))"


@query("a10_regression_gate", f"SELECT metric, round(m, 3) AS value, baseline::DOUBLE AS baseline, 0.05::DOUBLE AS tolerance, round(m, 3) - baseline::DOUBLE >= -0.05 AS passed FROM {BASE} JOIN (SELECT 'quality' AS metric, avg(quality) AS m FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels UNION ALL SELECT 'other', 1.0) USING (metric)")
def a10(spark, sf):
    metrics = a9(spark, sf).withColumnRenamed("mean", "value")
    return evaluate.regression_gate(metrics, spark.sql(f"SELECT metric, CAST(baseline AS DOUBLE) AS baseline FROM {BASE}"))


@query("a11_refusal_rate", "SELECT count(*) AS total, count(*) FILTER (id % 3 = 0 AND length(content) < 198) AS passed, round(avg(CASE WHEN id % 3 = 0 AND length(content) < 198 THEN 1.0 ELSE 0.0 END), 3)::DOUBLE AS rate FROM " + MESSAGES)
def a11(spark, sf):
    return evaluate.refusal_rate(messages(spark, sf).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("抱歉"), F.col("content"))).otherwise(F.col("content")).alias("answer")))


def hits(spark, sf):
    return load(spark, sf, LEFT).filter("rank <= 5").selectExpr("query_id", "rank", "chunk_id AS doc_id", "rank AS chunk_index", "CASE WHEN chunk_id % 2 = 0 THEN 'A > B' ELSE '' END AS section_path", "concat('mail me at a', chunk_id, '@x.com ', repeat('z', 490)) AS content", "0.5D AS score")


@query("f13_context", f"SELECT query_id, string_agg('[' || rank || '] 来源：' || chunk_id || CASE WHEN chunk_id % 2 = 0 THEN ' › A > B' ELSE '' END || chr(10) || 'mail me at a' || chunk_id || '@x.com ' || repeat('z', 490), chr(10) || chr(10) ORDER BY rank) AS context FROM {named(LEFT)} WHERE rank <= 5 GROUP BY query_id")
def f13(spark, sf):
    return answer.context(hits(spark, sf))


@query("f14_citations", f"SELECT query_id, rank AS index, chunk_id AS doc_id, 'mail me at a****@x.com ' || repeat('z', 500 - length('mail me at a' || chunk_id || '@x.com ')) AS content FROM {named(LEFT)} WHERE rank <= 5")
def f14(spark, sf):
    return answer.citations(hits(spark, sf)).select("query_id", "index", "doc_id", "content")


@query("f15_stored_turns", f"SELECT session_id, p AS pos, CASE p WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE p WHEN 0 THEN content ELSE 'ok' END AS content, '[]' AS refs_json, CASE WHEN session_id % 2 = 0 THEN substr(content, 1, 20) END AS title FROM (SELECT session_id, content FROM {MESSAGES} WHERE role = 'user'), (VALUES (0), (1)) v(p)")
def f15(spark, sf):
    turns = messages(spark, sf).filter("role = 'user'").selectExpr("session_id", "content AS question", "'ok' AS answer", "'[]' AS refs_json", "session_id % 2 = 0 AS is_new")
    return answer.stored_turns(turns)


@query("g8_history", f"""SELECT id, coalesce((SELECT string_agg(h.role || ': ' || substr(h.content, 1, 80), '；' ORDER BY h.id) FROM (SELECT * FROM {MESSAGES} h WHERE h.session_id = m.session_id AND h.id < m.id ORDER BY h.id DESC LIMIT 4) h), '无') AS history FROM {MESSAGES} m""")
def g8(spark, sf):
    return answer.history(messages(spark, sf)).select("id", "history")


@query("u1_merge_queries", "SELECT item_id, array_to_string(CASE WHEN item_id % 2 = 0 THEN [text || '0', text || '1', text || '2', text || '3', text || '4', 'v'] ELSE list_transform(range(1, 9), lambda i: text || (i // 2)) END, '|') AS merged FROM benchmark")
def u1(spark, sf):
    many = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.col("text"), F.floor(i / 2).cast("string")))  # some twice
    variants = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("v"), F.lit("w"))).otherwise(F.array().cast("array<string>"))
    return load(spark, sf, "{benchmark}").select("item_id", F.array_join(text.merge_queries(many, variants), "|").alias("merged"))


@query("u2_bounded_expansion", "SELECT item_id, array_to_string(list_concat([text], list_transform(range(item_id % 5 + 1, least(item_id % 5 + 4, 5)), lambda i: 'v' || i)), '|') AS expanded FROM benchmark")
def u2(spark, sf):
    variants = F.expr("transform(sequence(1, 4), i -> CASE WHEN i <= item_id % 5 THEN ' ' ELSE concat('v', i) END)")
    return load(spark, sf, "{benchmark}").select("item_id", F.array_join(text.bounded_expansion(F.col("text"), variants), "|").alias("expanded"))


CASE_SQL = "(SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'chat' ELSE 'qa' END AS intent FROM {benchmark})"


@query("u3_all_cases", f"SELECT item_id, intent FROM {named(CASE_SQL)} WHERE intent <> 'chat' UNION ALL SELECT item_id, intent FROM {named(CASE_SQL)}")
def u3(spark, sf):
    cases = load(spark, sf, CASE_SQL)
    return feedback.all_cases(cases, cases).select("item_id", "intent")


REPLACED = "CASE WHEN doc_id % 5 = 0 THEN concat('new ', content) ELSE content END"


@query("s5_replace_documents", f"SELECT doc_id, chunk_index, md5({REPLACED}) AS digest FROM {t.PLAIN} WHERE doc_id % 5 <> 0 OR chunk_index % 2 = 0")
def s5(spark, sf):
    chunks = t.chunks(spark, sf)
    new = chunks.filter("doc_id % 5 = 0 and chunk_index % 2 = 0").withColumn("content", F.concat(F.lit("new "), "content"))
    return catalog.replace_documents(chunks, new).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


def folder(spark, name):
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4().hex}"


@query("s5_chunk_store", f"SELECT doc_id, chunk_index, md5({REPLACED}) AS digest FROM {t.PLAIN} WHERE doc_id % 5 <> 0 OR chunk_index % 2 = 0")
def s5_store(spark, sf):
    """The store itself: written, part of it replaced, read."""
    chunks, store = t.chunks(spark, sf), folder(spark, "chunks")
    files.replace_in_store(spark, store, chunks)
    files.replace_in_store(spark, store, chunks.filter("doc_id % 5 = 0 and chunk_index % 2 = 0").withColumn("content", F.concat(F.lit("new "), "content")))
    return files.read_store(spark, store).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query("s4_appended_cases", "SELECT text AS question, CASE item_id % 3 WHEN 0 THEN 'qa' ELSE 'summary' END AS intent, 'b' || item_id AS source, count(*) AS n FROM benchmark, range(2) GROUP BY ALL")
def s4(spark, sf):
    """Cases written to a folder twice and read again, with their defaults."""
    cases = load(spark, sf, "{benchmark}").selectExpr("text AS question", "CASE item_id % 3 WHEN 0 THEN '' ELSE 'summary' END AS intent", "concat('b', item_id) AS source")
    path = folder(spark, "cases")
    files.append_cases(cases, path)
    files.append_cases(cases, path)
    return files.load_cases(spark, path).groupBy("question", "intent", "source").agg(F.count("*").alias("n"))


@query("s1_load_directory", "SELECT 'd' || doc_id AS doc_id, length(text) AS n, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def s1(spark, sf):
    """Every document as a file of a folder, listed and read again."""
    path = folder(spark, "docs")
    files.write_documents(load(spark, sf, "{documents}").selectExpr("concat('d', doc_id) AS doc_id", "text"), path)
    return files.load_documents(spark, path).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("p5_upload_gate", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unsupported_type' WHEN n_chars > 10000 THEN 'too_large' WHEN doc_id % 5 = 0 THEN 'wrong_content' WHEN doc_id % 3 = 0 THEN 'bad_department' WHEN doc_id % 2 = 0 THEN 'bad_doc_id' END AS reason FROM documents""")
def p5(spark, sf):
    """Uploads of every sort: a type, a size, first bytes, a department or an id that isn't taken."""
    path = F.expr("concat('/x/', doc_id, CASE WHEN doc_id % 7 = 0 THEN '.exe' WHEN doc_id % 5 = 0 THEN '.pdf' ELSE '.md' END)")
    size = F.when(F.col("n_chars") > 10000, files.MOST_BYTES + 1).otherwise(F.col("n_chars"))
    reason = files.upload_rejection(path, F.encode(F.col("text"), "UTF-8"), size, F.expr("CASE WHEN doc_id % 3 = 0 THEN 'a/b' ELSE 'dept' END"), F.expr("CASE WHEN doc_id % 2 = 0 THEN concat(doc_id, '!') ELSE CAST(doc_id AS STRING) END"))
    return load(spark, sf, "{documents}").select("doc_id", reason.alias("reason"))


@query("x1_embed", "SELECT item_id, length(text)::DOUBLE AS n, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e FROM benchmark")
def x1(spark, sf):
    """A caller's embedding function."""
    v = retrieve.embed(load(spark, sf, "{benchmark}"), "text", lambda texts: [[len(x), x.count("e")] for x in texts])
    return v.select("item_id", F.get("vector", F.lit(0)).alias("n"), F.get("vector", F.lit(1)).alias("e"))


@query("x2_rerank_by_function", f"""WITH f AS {FUSED}, s AS (SELECT *, ((chunk_id * 7 + query_id) % 11) / 11 AS rel FROM f)
SELECT query_id, chunk_id, CASE WHEN query_id % 5 = 0 THEN score ELSE round(rel, 6) END AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id % 5 = 0 THEN 0 ELSE -rel END, rank) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id % 5 = 0 THEN 0 ELSE -rel END, rank) <= 5""")
def x2(spark, sf):
    """A caller's scorer that fails for a fifth of the queries."""
    f = fused(spark, sf)
    chunks = load(spark, sf, "{customer}").selectExpr("c_custkey AS chunk_id", "CAST(c_custkey AS STRING) AS content")
    queries = f.selectExpr("query_id", "CAST(query_id AS STRING) AS text").distinct()

    def scorer(query, texts):
        if int(query) % 5 == 0:
            raise RuntimeError("no model")
        return [(int(x) * 7 + int(query)) % 11 / 11 for x in texts]

    return retrieve.rerank(f, retrieve.scored(f, queries, chunks, scorer), 5)


@query("x3_cases_by_functions", f"""WITH d AS (SELECT * FROM {MESSAGES} WHERE role = 'assistant' AND feedback = 'down' ORDER BY said_at DESC, id DESC LIMIT 160),
p AS (SELECT d.id, d.said_at, (SELECT arg_max(content, said_at) FROM {MESSAGES} q WHERE q.session_id = d.session_id AND q.role = 'user' AND q.said_at < d.said_at) AS question FROM d),
l AS (SELECT * FROM p WHERE question IS NOT NULL ORDER BY said_at DESC, id DESC LIMIT 40),
n AS (SELECT *, row_number() OVER (PARTITION BY trim(question) ORDER BY said_at DESC, id DESC) AS n FROM l WHERE trim(question) NOT IN (SELECT trim(content) FROM {MESSAGES} WHERE role = 'user' AND session_id % 5 = 0))
SELECT trim(question) AS question, '' AS doc_id, '' AS section_prefix, CASE length(trim(question)) % 3 WHEN 0 THEN 'qa' ELSE 'summary' END AS intent, 'about ' || left(trim(question), 9) AS reference, 'feedback:' || id AS source FROM n WHERE n = 1 AND length(trim(question)) % 3 < 2""")
def x3(spark, sf):
    m = messages(spark, sf)
    known = m.filter("role = 'user' and session_id % 5 = 0").select(text.strip(F.col("content")).alias("question"))
    classify = lambda qs: [("qa", "summary", "chat")[len(q) % 3] for q in qs]
    return feedback.new_cases(m, known, limit=40, classify=classify, make_reference=lambda qs: [f"about {q[:9]}" for q in qs]).drop("answer_id")


@query("x4_cleaned_by_function", f"""WITH g AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(substr(text, 1, 30), chr(65533)) ELSE text END AS content FROM documents),
b AS (SELECT *, length(content) >= 20 AND (contains(content, chr(65533)) OR regexp_matches(content, '[\x00-\x08\x0e-\x1f]')) AS bad FROM g)
SELECT doc_id, CASE WHEN bad AND length(content) % 2 = 0 THEN replace(content, chr(65533), '?') ELSE content END AS content, CASE WHEN bad AND length(content) % 2 = 0 THEN 'cleaned' WHEN bad THEN 'fallback' END AS llm_status FROM b""")
def x4(spark, sf):
    garbled = load(spark, sf, "{documents}").select("doc_id", F.expr("CASE doc_id % 5 WHEN 0 THEN concat(substr(text, 1, 30), '\ufffd') ELSE text END").alias("content"))
    return clean.cleaned_by(garbled, lambda texts: [(x.replace("\ufffd", "?"), 0.9 if len(x) % 2 == 0 else 0.1) for x in texts], keys=("doc_id",)).select("doc_id", "content", "llm_status")


@query("ingest_documents")
def ingested(spark, sf):
    """All documents as files, from parsing to masked chunks."""
    rows = load(spark, sf, "{documents}").selectExpr("doc_id", "concat('/x/', doc_id, CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.html' END) AS path", "text")
    return ingest.ingest(rows).chunks


@query("ingest_outcomes")
def ingest_outcomes(spark, sf):
    """What came of each document, copies and documents without content among them."""
    rows = load(spark, sf, "{documents}").selectExpr("doc_id", "concat('/x/', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END) AS path", "CASE WHEN doc_id % 50 = 0 THEN ' ' WHEN doc_id % 50 = 1 THEN 'Page 3 of 9' ELSE text END AS text")
    return ingest.ingest(rows).outcomes


@query("s6_audit_export", f"SELECT id, action, resource FROM {AUDIT} ORDER BY id DESC LIMIT 5000")
def s6(spark, sf):
    return files.audit_export(load(spark, sf, t.AUDIT)).select("id", "action", "resource")


@query("w11_recent_sessions", f"SELECT user_id, session_id, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, session_id DESC) AS rank FROM {named(SESSIONS)} QUALIFY rank <= 50")
def w11(spark, sf):
    return stats.recent_sessions(load(spark, sf, SESSIONS)).select("user_id", "session_id", "rank")


@query("w12_session_messages", f"SELECT id, role FROM {MESSAGES} WHERE session_id = 5")
def w12(spark, sf):
    return stats.session_messages(messages(spark, sf), load(spark, sf, SESSIONS), 5, 5).select("id", "role")


@query("w13_audit_page", f"SELECT id, action, (SELECT count(*) FROM {AUDIT} WHERE action = 'login') AS total FROM {AUDIT} WHERE action = 'login' ORDER BY id DESC LIMIT 50 OFFSET 20")
def w13(spark, sf):
    return catalog.audit_page(load(spark, sf, t.AUDIT), "login", 50, 20).select("id", "action", "total")


@query("w14_upsert", f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE status END AS status FROM {DOCS}")
def w14(spark, sf):
    old = load(spark, sf, t.DOCS).select("doc_id", "status", F.lit(1).alias("version"))
    new = old.filter("doc_id % 4 = 0").withColumns({"status": F.lit("new"), "version": F.lit(2)})
    return catalog.upsert(old, new, ["doc_id"], "version").select("doc_id", "status")


@query("g1_markdown_blocks", r"""SELECT doc_id, pos, kind, level, text FROM (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN 'heading' WHEN pos % 3 = 1 THEN 'table' ELSE 'text' END AS kind, CASE WHEN pos % 3 = 0 THEN 1 + length(l) % 6 ELSE 0 END AS level, CASE WHEN pos % 3 = 1 THEN '| ' || l || ' |' ELSE l END AS text
FROM (SELECT doc_id, trim(line) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM (SELECT doc_id, regexp_replace(text, '[|#]', '', 'g') AS text FROM documents)) WHERE trim(line) <> ''))""")
def g1(spark, sf):
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", "[|#]", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), 1 + F.length(x) % 6), F.lit(" "), x)).when(i % 3 == 1, F.concat(F.lit("| "), x, F.lit(" |"))).otherwise(x))
    return parse.exploded(load(spark, sf, "{documents}").select("doc_id", parse.markdown_blocks(F.array_join(marked, "\n")).alias("blocks"))).select("doc_id", "pos", "kind", "level", "text")


@query("g2_text_blocks", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos, trim(l) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents) WHERE trim(l) <> ''")
def g2(spark, sf):
    spaced = F.regexp_replace("text", "\n", "\n \n")
    return parse.exploded(load(spark, sf, "{documents}").select("doc_id", parse.text_blocks(spaced).alias("blocks"))).select("doc_id", "pos", "text")


@query("g3_html_blocks")
def g3(spark, sf):
    return parse.exploded(load(spark, sf, "{pages}").select("page_id", parse.html_blocks(F.col("html")).alias("blocks")))


FLAT = "regexp_replace(text, '[|#<>&]', '', 'g')"


@query("g4_route", f"""SELECT CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'text' ELSE 'rejected' END AS parser, doc_id, CASE WHEN doc_id % 3 < 2 THEN md5(array_to_string(list_filter(list_transform(string_split({FLAT}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|')) END AS digest FROM documents""")
def g4(spark, sf):
    """Files of three types, and the texts of the blocks that their parsers give; every line is a block here."""
    spaced = F.regexp_replace(F.regexp_replace("text", "[|#<>&]", ""), "\n", "\n\n")
    rows = load(spark, sf, "{documents}").select(F.expr("concat('/x/', doc_id, CASE doc_id % 3 WHEN 0 THEN '.MD' WHEN 1 THEN '.txt' ELSE '.pdf' END)").alias("path"), spaced.alias("text"))
    parsed, rejected = parse.route(rows)
    number = F.regexp_extract("path", r"/x/([0-9]+)", 1).cast("long").alias("doc_id")
    joined = F.md5(F.array_join(F.transform("blocks", lambda x: x["text"]), "|")).alias("digest")
    return parsed.select("parser", number, joined).unionByName(rejected.select(F.lit("rejected").alias("parser"), number, F.lit(None).cast("string").alias("digest")))


def line_blocks(spark, sf):
    """Blocks as one row per document: short lines are headings, lines with bars tables."""
    text_of = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    kind = lambda x: F.when(F.length(x) <= 20, "heading").when(x.startswith("|") | x.endswith("|"), "table").otherwise("text")
    block = lambda x, i: F.struct(x.alias("text"), F.when(F.length(x) <= 20, 1 + F.length(x) % 3).otherwise(0).cast("int").alias("level"), kind(x).alias("kind"), (F.floor(i / 10) + 1).cast("int").alias("page"))
    return load(spark, sf, "{documents}").select("doc_id", F.transform(text_of, block).alias("blocks"))


@query("g5_chunk_documents")
def g5(spark, sf):
    return chunk.chunk_documents(line_blocks(spark, sf))


@query("g6_window_split", "SELECT doc_id, i AS pos, length(CASE WHEN i < n THEN substr(text, i * 700 + 1, 800) ELSE substr(text, i * 700 + 1) END) AS chars, md5(CASE WHEN i < n THEN substr(text, i * 700 + 1, 800) ELSE substr(text, i * 700 + 1) END) AS digest FROM (SELECT doc_id, text, n, unnest(range(0, n + 1)) AS i FROM (SELECT doc_id, text, greatest(ceil((length(text) - 800) / 700), 0)::INT AS n FROM documents))")
def g6(spark, sf):
    w = load(spark, sf, "{documents}").select("doc_id", F.posexplode(chunk.window_split(F.col("text"))).alias("pos", "w"))
    return w.select("doc_id", "pos", F.length("w").alias("chars"), F.md5("w").alias("digest"))


LINES = "(SELECT doc_id, p AS pos, l AS text, CASE WHEN length(l) <= 20 THEN 'heading' ELSE 'text' END AS kind, CASE WHEN length(l) <= 20 THEN 1 + length(l) % 3 ELSE 0 END AS level FROM (SELECT doc_id, trim(l) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents) WHERE trim(l) <> ''))"


@query("g7_section_paths", f"""WITH b AS {LINES}, h AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS a1, max(CASE WHEN level = 2 THEN pos END) OVER w AS a2, max(CASE WHEN level = 3 THEN pos END) OVER w AS a3 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT *, CASE WHEN a2 > coalesce(a1, -1) THEN a2 END AS b2, CASE WHEN a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) THEN a3 END AS b3 FROM h)
SELECT k.doc_id, k.pos, concat_ws(' > ', x.text, y.text, z.text) AS section_path FROM k LEFT JOIN b x ON x.doc_id = k.doc_id AND x.pos = a1 LEFT JOIN b y ON y.doc_id = k.doc_id AND y.pos = b2 LEFT JOIN b z ON z.doc_id = k.doc_id AND z.pos = b3""")
def g7(spark, sf):
    return chunk.section_paths(parse.exploded(line_blocks(spark, sf))).select("doc_id", "pos", "section_path")


def attempts(spark, sf):
    rows = load(spark, sf, "{events}").filter("event_type in ('error', 'view')")
    return rows.select(F.col("user_id").cast("string").alias("username"), ((F.unix_timestamp("ts") - ORIGIN) / 60).alias("ts"), (F.col("event_type") == "view").alias("success"))


LOCKOUT = f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY username ORDER BY ts, success) AS i FROM
  (SELECT CAST(user_id AS VARCHAR) AS username, (floor(epoch(ts)) - {ORIGIN}) / 60 AS ts, event_type = 'view' AS success FROM events WHERE event_type IN ('error', 'view'))),
r AS (SELECT username, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS ts, '' AS outcome, 0 AS c, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS u FROM (SELECT DISTINCT username FROM n)
  UNION ALL SELECT username, i, ts, CASE WHEN locked THEN 'locked' WHEN success THEN 'ok' ELSE 'failed' END,
    CASE WHEN locked THEN c WHEN success OR nc >= 5 THEN 0 ELSE nc END, CASE WHEN locked THEN w WHEN success OR nc >= 5 THEN 0 ELSE nw END, CASE WHEN locked THEN u WHEN NOT success AND nc >= 5 THEN ts + 300 ELSE 0 END
  FROM (SELECT n.username, n.i, n.ts, n.success, c, w, u, n.ts < u AS locked, CASE WHEN c = 0 OR n.ts >= w THEN 1 ELSE c + 1 END AS nc, CASE WHEN c = 0 OR n.ts >= w THEN n.ts + 300 ELSE w END AS nw
        FROM r JOIN n ON n.username = r.username AND n.i = r.i + 1))
SELECT username, ts, outcome FROM r WHERE i > 0"""


@query("t3_login_lockout", LOCKOUT)
def t3(spark, sf):
    return jobs.login_lockout(attempts(spark, sf))


@query("t4_request_rate", f"""WITH e AS (SELECT *, CAST(floor(epoch(ts) / 30) AS BIGINT) * 30 AS f FROM {REQUESTS}), w AS (SELECT path, status, f - 30 * i AS s FROM e, range(0, 10) r(i))
SELECT 'GET' AS method, path, status, s AS start, count(*) AS requests, count(*) / 300 AS per_second FROM w GROUP BY path, status, s""")
def t4(spark, sf):
    return jobs.request_rate(load(spark, sf, t.REQUESTS)).withColumn("start", F.unix_timestamp("start"))


BUCKET_SQL = ", ".join(f"count(*) FILTER (latency <= {b}) AS le_{i}" for i, b in enumerate(jobs.BUCKETS))
QUANTILE = "CASE " + " ".join(f"WHEN le_{i} >= 0.95 * total THEN {jobs.BUCKETS[i - 1] if i else 0.0} + ({b} - {jobs.BUCKETS[i - 1] if i else 0.0})::DOUBLE * (0.95 * total - {f'le_{i - 1}' if i else 0}) / nullif(le_{i} - {f'le_{i - 1}' if i else 0}, 0)" for i, b in enumerate(jobs.BUCKETS)) + " ELSE 30.0 END"


@query("t5_latency_p95", f"SELECT 'GET' AS method, path, start, total, round({QUANTILE}, 6)::DOUBLE AS p95 FROM (SELECT path, CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS start, count(*) AS total, {BUCKET_SQL} FROM {REQUESTS} GROUP BY ALL)")
def t5(spark, sf):
    return jobs.latency_p95(load(spark, sf, t.REQUESTS), window="1 day").withColumn("start", F.unix_timestamp("start"))


@query("t6_latest_gauge", "SELECT event_type AS name, arg_max(value, (ts, value)) AS value FROM events GROUP BY event_type")
def t6(spark, sf):
    return jobs.latest_gauge(load(spark, sf, "{events}").select(F.col("event_type").alias("name"), "ts", "value")).select("name", "value")


@query("t7_redact_stream", f"SELECT doc_id AS answer_id, tail AS masked FROM ({TAIL_SQL}{named(SENSITIVE)})")
def t7(spark, sf):
    tail = load(spark, sf, SENSITIVE).select("doc_id", F.element_at(F.split("text", " "), -1).alias("tail"))
    deltas = tail.select(F.col("doc_id").alias("answer_id"), F.posexplode(F.split("tail", "")).alias("seq", "delta"))
    return jobs.redact_stream(deltas).select("answer_id", "masked")


@query("t7_redact_stream_text", f"SELECT doc_id AS answer_id, length(text) AS n, md5(text) AS digest FROM ({TEXT_SQL}) WHERE text IS NOT NULL")
def t7_text(spark, sf):
    """Whole texts in frames of 40 characters, which cut matches."""
    frames = F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0))).alias("seq", "delta")
    masked = jobs.redact_stream(load(spark, sf, SENSITIVE).select(F.col("doc_id").alias("answer_id"), frames))
    return masked.select("answer_id", F.length("masked").alias("n"), F.md5("masked").alias("digest"))
