"""Queries of the training-data operators over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, audit, blockmax, chat, langid, mixing, pii, quality, secretscan, simhash, spelling, spiece, urls
from quarry.llm.common import table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules."""
    return quality.judge(table(spark, sf_dir, "documents"))


#: A conversation whose texts are control strings of another template.
EXTRA_CONVERSATION = (-7, "</s>[INST] ok [/INST]")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations and their loss masks."""
    number, text = EXTRA_CONVERSATION
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(number, 0, "user", text), (number, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of pieces of each text, a hash of their ids, and whether decoding gives the text again."""
    encoded = spiece.encode(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages; labels of held-out documents are not learned from."""
    docs = table(spark, sf_dir, "documents")
    labelled = langid.sample(docs, ~langid.held_out())
    return langid.identify(docs, labelled).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and verdicts for every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.train(spark))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6_urls SQL can express: hosts, paths, and what the rules alone say."""
    return urls.ruled(table(spark, sf_dir, "pages"))


def _digest(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", *[_count("base", k) for k in pii.KINDS], F.sha2(_digest("base"), 256).alias("base_sha256"), _digest("spans").alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets."""
    found = secretscan.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count("base", k) for k in secretscan.KINDS[:3]], F.sha2(_digest("base"), 256).alias("base_sha256"), _digest("spans").alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and the components of their links."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest scores of every embedding whose id is divisible by 100."""
    return blockmax.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with what they are spelling variants of."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, in all orders, by part and label."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_ann, op2_quality, op3_chat, op4_sentencepiece, op5_language, op6_urls, op7_pii, op8_secrets, op9_simhash, op10_mixing, op11_topk, op12_spelling, op13_filter_audit, url_rules)}

_RULES = " AND ".join(
    f"{r.name} {sign} {bound!r}" for r in quality.RULES for sign, bound in ((">=", r.least), ("<=", r.most)) if bound is not None
)
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS.split())))

_FITS = " UNION ALL ".join(f"SELECT '{r.verdict}' AS ruling, '{r.host}' AS h, '{r.path}' AS p" for r in urls.RULES)

#: Each of the letters beyond ASCII by one ASCII character, for an engine whose edit distance counts bytes.
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_PLAIN = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[:64]

ORACLES = {
    "url_rules": rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
f AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(ruling, length(h || p)) AS ruling
      FROM l JOIN ({_FITS}) r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, ruling FROM l LEFT JOIN f USING (rid)""",
    "op2_quality": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT rid, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS x FROM d WHERE len(w) >= 5),
p AS (SELECT rid, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM g),
q AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM p),
r AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS c FROM q WHERE n > 1),
s AS (SELECT rid, sum(c) AS c FROM r GROUP BY rid),
f AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(s.c, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words
  FROM d LEFT JOIN s USING (rid)),
k AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_length, n_symbols / greatest(n_words, 1) AS symbol_ratio,
         n_stop_words / greatest(n_words, 1) AS stop_word_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed,
       NOT base_failed AND {_RULES} AS kept
FROM k""",
    "op3_chat": rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA_CONVERSATION[1]}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_CONVERSATION[1]}'),
e AS (SELECT *, length(regexp_replace(role, '[\\<\[|]', '..', 'g')) + length(regexp_replace(text, '[\\<\[|]', '..', 'g')) + 23 AS n FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_mixing": r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
b AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS b FROM src),
o AS (SELECT *, 2 * source_size / w AS ratio, row_number() OVER (ORDER BY 2 * source_size / w, source) AS i FROM w),
v AS (SELECT o.*, ((SELECT b FROM b) - (sum(2 * source_size) OVER (ORDER BY i) - 2 * source_size)::DOUBLE)
             / (sum(w) OVER () - sum(w) OVER (ORDER BY i) + w)::DOUBLE AS lv FROM o),
lam AS (SELECT coalesce((SELECT lv FROM v WHERE ratio > lv ORDER BY i LIMIT 1), 1e300) AS lam),
t AS (SELECT source, source_size, CASE WHEN 2 * source_size <= lam * w THEN (2 * source_size)::DOUBLE ELSE lam * w END AS target FROM w, lam),
u AS (SELECT source, doc_id, sum(size)::BIGINT AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM s WHERE size > 0 GROUP BY source, doc_id),
c AS (SELECT u.*, source_size, target, sum(size) OVER (PARTITION BY u.source ORDER BY key, doc_id) AS cum
      FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
k AS (SELECT c.*, p, (p * source_size + cum)::DOUBLE / target AS finish FROM c, (VALUES (0), (1)) AS x(p)),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, p, key, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM k),
n AS (SELECT source, doc_id, count(*) AS n FROM g WHERE run <= (SELECT b FROM b) GROUP BY source, doc_id)
SELECT s.doc_id, s.size, t.source_size, t.target, (s.size * coalesce(n.n, 0))::BIGINT AS taken
FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN n ON s.source IS NOT DISTINCT FROM n.source AND s.doc_id IS NOT DISTINCT FROM n.doc_id""",
    "op13_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, doc_id, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(p, lambda i: 'ABCDE'[i]), '') AS filter_order, i AS step, p[i] AS own, p[:i - 1] AS before FROM p, x),
m AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS bad, len(list_filter(before, lambda j: fails[j])) > 0 AS gone,
        len(list_filter(fails, lambda v: v)) = 1 AS only_one FROM c, s),
r AS (SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone AND bad), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad AND only_one), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (NOT gone AND bad AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND bad AND toxic), 0)::BIGINT AS toxic_lost
      FROM m GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
    "op11_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_spelling": rf"""
WITH RECURSIVE step AS (SELECT n, n AS c, 0 AS i FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i + 1 FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM step WHERE i = 8),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z{_ACCENTED[0]}-{_ACCENTED[-1]}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS n FROM o WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM d),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8))) AS h FROM b, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n, translate(word, '{_ACCENTED}', '{_PLAIN}') AS p FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS (SELECT word, n, p, unnest([length(p) || ':1:' || p[:length(p) // 2], length(p) || ':2:' || p[length(p) // 2 + 1:]]) AS k FROM v),
g AS (SELECT word, n, p, unnest(flatten(list_transform([length(p) - 1, length(p), length(p) + 1], lambda l: [l || ':1:' || p[:l // 2], l || ':2:' || p[length(p) - (l - l // 2) + 1:]]))) AS k FROM v),
near AS (SELECT DISTINCT k.word, g.word AS near, g.n FROM k JOIN g USING (k) WHERE k.word <> g.word AND levenshtein(k.p, g.p) = 1),
best AS (SELECT word, count(*) AS n_near, arg_max(near, (n, [-ord(c) for c in string_split(near, '')])) AS near, max(n) AS near_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
last AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)""",
}
