"""Operator 1: URL filters by hashed host-suffix / path-prefix expressions.

Each URL is expanded into expressions: its host and up to four suffixes of its
host's last five labels (at least two labels long), each combined with its path
and query, its path, and up to four leading directories of the path, the root
being one.  If a rule has more labels or directories, as many are expanded.  The
expressions' SHA-256 digests are joined with the rules' by their first 32 bits
(a narrow integer equi-join), then whole digests are compared.  Of a URL's
matching rules the one of highest priority holds; then the longest expression;
then the least rule_id.

Every distinct URL is expanded once; rules are broadcast only if their counted
rows fit, and shuffled on the prefix otherwise.

Defined cases: a null URL or one without a host gets the verdict ``invalid``
and no rule; a URL that no rule matches gets ``allow`` and no rule; hosts are
compared in lower case, without user, port or a final dot; a host of digits and
dots (an IPv4 address) or in brackets (IPv6) has no suffixes; rules of null or empty expression or
action never match; rules of equal expression are settled by the order above;
repeated pages each keep their row, null page_ids too; empty tables give empty
results (with no rules all pages pass); other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, require, sized

PREFIX_HEX = 8
HOST_LABELS = 5
PATH_DIRS = 4
#: (rule_id, expression, action, priority)
RULES: Sequence[tuple[int, str, str, int]] = (
    (1, "tionsh.example.net/", "block", 10),
    (2, "tionsh.example.net/fr/", "allow", 10),
    (3, "example.org/es/", "block", 5),
    (4, "ththre.example.org/", "review", 5),
    (5, "blog.tionble.example.com/en/", "block", 10),
    (6, "tionble.example.com/", "review", 8),
    (7, "example.com/de/", "review", 1),
    (8, "m.tiontion.example.com/", "block", 20),
    (9, "tiontion.example.com/", "allow", 5),
    (10, "ththan.example.net/en/", "block", 10),
    (11, "ththan.example.net/", "allow", 20),
    (12, "www.ththes.example.net/", "block", 10),
    (13, "www.ththes.example.net/", "review", 10),
    (14, "ththon.example.com/es/10646/", "allow", 10),
    (15, "ththon.example.com/es/", "block", 10),
    (16, "example.edu/", "block", 50),
    *(
        (100 + 3 * i + k, f"{name}.example.{tld}/", "block", 100)
        for i, name in enumerate(("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"))
        for k, tld in enumerate(("com", "net", "org"))
    ),
)
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*(\?[^#]*)"


def expressions(urls: DataFrame, labels: int = HOST_LABELS, depth: int = PATH_DIRS) -> DataFrame:
    """(url, expression) of the distinct URLs that have a host; ``urls`` has a column url.

    Suffixes have at most ``labels`` labels, and at most ``depth`` leading
    directories are taken, the root being the first.
    """
    parts = urls.select("url").where("url is not null").distinct().select(
        "url",
        F.lower(F.regexp_replace(F.regexp_extract("url", _HOST, 1), r"\.$", "")).alias("host"),
        F.regexp_extract("url", _PATH, 1).alias("path0"),
        F.regexp_extract("url", _QUERY, 1).alias("query"),
    )
    parts = parts.where("host <> ''").withColumns(
        {
            "path": F.when(F.col("path0") == "", F.lit("/")).otherwise(F.col("path0")),
            "labels": F.split("host", r"\."),
            "address": F.col("host").rlike(r"^([0-9.]+|\[.*)$"),
        }
    )
    hosts = f"""if(address or size(labels) <= 2, array(host), concat(array(host),
        transform(sequence(greatest(2, size(labels) - {labels - 1}), size(labels) - 1), i -> array_join(slice(labels, i, size(labels) - i + 1), '.'))))"""
    dirs = "slice(split(path, '/'), 2, greatest(size(split(path, '/')) - 2, 0))"
    paths = f"""concat(array(concat(path, query), path, '/'),
        transform(filter(sequence(0, {depth - 1}), k -> k > 0 and k <= size(dirs)), k -> concat('/', array_join(slice(dirs, 1, k), '/'), '/')))"""
    both = parts.withColumn("dirs", F.expr(dirs)).select("url", F.explode(F.expr(f"array_distinct({hosts})")).alias("h"), F.expr(f"array_distinct({paths})").alias("p"))
    return both.select("url", F.explode(F.expr("transform(p, x -> concat(h, x))")).alias("expression"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[int, str, str, int]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_id long, expression string, action string, priority int")


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, verdict, rule_id) of every page."""
    require(pages, "page_id", "url")
    require(rules, "rule_id", "expression", "action", "priority")
    rules = rules.where("length(expression) > 0 and action is not null")
    # A rule of more labels or directories than are usual is matched too.
    n, labels, depth = rules.agg(
        F.count(F.lit(1)),
        F.max(F.expr("size(split(substring_index(expression, '/', 1), '[.]'))")),
        F.max(F.expr("size(split(substring_index(expression, '?', 1), '/')) - 1")),
    ).first()
    rules = rules.select(
        F.sha2("expression", 256).alias("r_digest"), F.length("expression").alias("r_length"), "rule_id", "action", "priority"
    )
    key = lambda digest: F.conv(F.substring(digest, 1, PREFIX_HEX), 16, 10).cast("bigint")
    rules = rules.withColumn("r_key", key(F.col("r_digest")))
    rules = sized(rules, n, 160)
    mine = expressions(pages, max(HOST_LABELS, labels or 0), max(PATH_DIRS, depth or 0)).select("url", F.sha2("expression", 256).alias("digest"))
    hits = mine.withColumn("key", key(F.col("digest"))).join(rules, F.col("key") == F.col("r_key")).where("digest = r_digest")
    rank = F.struct(-F.coalesce("priority", F.lit(0)), -F.col("r_length"), F.coalesce("rule_id", F.lit(1 << 62)))
    best = hits.groupBy("url").agg(F.min_by(F.struct("action", "rule_id"), rank).alias("best"))
    best = best.withColumnRenamed("url", "b_url")
    host = F.regexp_replace(F.regexp_extract("url", _HOST, 1), r"\.$", "")
    verdict = F.when(F.col("url").isNull() | (host == ""), "invalid").otherwise(F.coalesce("best.action", F.lit("allow")))
    return pages.select("page_id", "url").join(best, F.col("url") == F.col("b_url"), "left").select("page_id", "url", verdict.alias("verdict"), F.col("best.rule_id").alias("rule_id"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "pages"), rule_table(spark))


_VALUES = ", ".join(f"({i}, '{e}', '{a}', {p})" for i, e, a, p in RULES)
OP1_SQL = f"""
WITH rules(rule_id, expression, action, priority) AS (VALUES {_VALUES}),
u AS (
  SELECT DISTINCT url, lower(regexp_replace(regexp_extract(url, '{_HOST}', 1), '\\.$', '')) AS host,
    regexp_extract(url, '{_PATH}', 1) AS path0, regexp_extract(url, '{_QUERY}', 1) AS query
  FROM pages WHERE url IS NOT NULL),
v AS (SELECT *, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path, string_split(host, '.') AS labels FROM u WHERE host <> ''),
w AS (SELECT *, string_split(path, '/')[2:-2] AS dirs FROM v),
hp AS (
  SELECT url, unnest(list_distinct(CASE WHEN len(labels) <= 2 OR regexp_matches(host, '^([0-9.]+|\\[.*)$') THEN [host]
      ELSE list_concat([host], [array_to_string(labels[i:], '.') FOR i IN range(greatest(2, len(labels) - {HOST_LABELS - 1}), len(labels))]) END)) AS h,
    list_distinct(list_concat([path || query, path, '/'],
      ['/' || array_to_string(dirs[1:k], '/') || '/' FOR k IN range(1, least({PATH_DIRS - 1}, len(dirs)) + 1)])) AS p
  FROM w),
e AS (SELECT url, h || unnest(p) AS expression FROM hp),
m AS (
  SELECT url, action, rule_id, row_number() OVER (PARTITION BY url ORDER BY priority DESC, length(e.expression) DESC, rule_id) AS rank
  FROM e JOIN rules USING (expression))
SELECT page_id, p.url,
  CASE WHEN p.url IS NULL OR regexp_replace(regexp_extract(p.url, '{_HOST}', 1), '\\.$', '') = '' THEN 'invalid' ELSE coalesce(m.action, 'allow') END AS verdict,
  CAST(m.rule_id AS BIGINT) AS rule_id
FROM pages p LEFT JOIN m ON p.url = m.url AND m.rank = 1
"""
