"""URL filters: rules for hosts and paths, and for all other URLs logistic regression on hashed n-grams.

The model is trained by Spark's own LogisticRegression over HashingTF of the character n-grams of host and path, on a
small labelled table of URLs: the caller's (url, label), or the one that labelled_urls makes by a rule from general
words of site categories, as public block lists have them, and from made-up names, which are allowed. Each row is judged
alone.

Null URLs and those without `://` have empty host and path; no rule fits them and the method judges the
empty string. Repeated rows are judged each. A probability of just 0.5 blocks. Other columns don't matter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bind

FEATURES, SIZES, ROUNDS, SHRINK = 1 << 16, (3, 4), 60, 0.001


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Production rules.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

# Words of site categories, those to be blocked and others.
BLOCKED = {
    "gambling": "casino poker betting roulette blackjack jackpot slots bingo sportsbook gambling wager lotto",
    "adult": "porn sex xxx nude erotic escorts hentai fetish webcams adult",
    "drugs": "viagra cialis pharmacy pills steroids tramadol xanax weightloss",
    "advertising": "ads adserver banners popups tracker clicktrack adclick affiliate",
    "fraud": "spam phishing malware warez keygen cracks scam paydayloans replica botnet",
}
ALLOWED = {
    "learning": "university college school library museum archive history science mathematics physics grammar dictionary encyclopedia lecture",
    "society": "government parliament council city village church charity hospital doctor health police court library station post",
    "culture": "music theatre cinema literature poetry painting photography dance orchestra festival gallery novel",
    "living": "garden kitchen recipes cooking family weather travel hotel railway cycling hiking football tennis fashion furniture pets",
    "work": "developer documentation software network research engineering business finance bank insurance market news journal magazine radio",
}
#: What hosts are made of beside a word; either label has all of them alike.
BEFORE, AFTER = ("", "my", "the-", "best-", "online-", "www.", "m.", "blog."), ("", "24", "-online", "-world", "-club", "zone", "hub", "-service")
ENDINGS, PLACES = (".com", ".net", ".org", ".info"), ("/", "/index.html", "/en/12", "/2020/05/page", "/fr/88/", "/view?id=7")
#: Hosts of each word, and made-up names for each word of the tables.
HOSTS, NAMES = 6, 2


def labelled_hosts() -> list[tuple[str, str, int]]:
    """(word, host, label): 1 is to be blocked. Hosts go round the lists, so that only the words tell labels apart."""
    out, made = [], 0
    for words, label in ((BLOCKED, 1), (ALLOWED, 0)):
        for i, w in enumerate(" ".join(words.values()).split()):
            for k in range(HOSTS):
                out.append((w, f"{BEFORE[(i + 3 * k) % len(BEFORE)]}{w}{AFTER[(5 * i + k) % len(AFTER)]}{ENDINGS[(i + k) % len(ENDINGS)]}", label))
            for _ in range(NAMES):  # names of two to four syllables
                made += 1
                parts = ["bcdfghjklmnprstvwz"[(made * (7 + 4 * s) + s) % 18] + "aeiou"[(made * (3 + s) + 2 * s) % 5] + "nrslt "[(made + s) % 6].strip() for s in range(2 + made % 3)]
                out.append(("", f"{BEFORE[made % len(BEFORE)]}{''.join(parts)}{ENDINGS[made % len(ENDINGS)]}", 0))
    return out


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: every host with one of the places; and the empty URL, which is allowed."""
    return [(f"https://{h}{PLACES[i % len(PLACES)]}", label) for i, (_, h, label) in enumerate(labelled_hosts())] + [("", 0)]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A short list, compiled into one expression."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chain = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chain)
    return chain


def ngrams(text: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """All n-grams of the text between a start and an end mark."""

    def of(c: Column) -> Column:
        def run(n: int) -> Column:
            grams = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))
            return F.when(F.size(c) >= n, grams).otherwise(F.array().cast("array<string>"))

        return F.concat(*[run(n) for n in sizes])

    return bind(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), of)


def _featured(rows: DataFrame) -> DataFrame:
    grams = F.concat(F.transform(ngrams(F.col("host")), lambda g: F.concat(F.lit("h:"), g)), F.transform(ngrams(F.col("path")), lambda g: F.concat(F.lit("p:"), g)))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(rows.withColumn("grams", grams))


def train(spark: SparkSession, labelled: DataFrame | list[tuple[str, int]] | None = None) -> LogisticRegressionModel:
    """A model of a small labelled table (url, label), by default labelled_urls."""
    if not isinstance(labelled, DataFrame):
        labelled = spark.createDataFrame(labelled_urls() if labelled is None else list(labelled), "url string, label int").coalesce(1)
    rows = _featured(labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label")))
    return LogisticRegression(maxIter=ROUNDS, regParam=SHRINK, standardization=False).fit(rows.select("features", "label"))


def ruled(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, ruling: what the rules alone say; null where none fits."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruling"))


def judge(pages: DataFrame, model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, probability (of a URL to be blocked, by the method): one row per input row."""
    scored = model.transform(_featured(ruled(pages, id_col, url_col, rules))).withColumn("p", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("ruling"), F.when(F.col("p") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("p").alias("probability"))
