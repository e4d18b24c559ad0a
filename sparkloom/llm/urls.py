"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

A host is expanded to at most as many labels as some rule has, and a path only to lengths that rules of a fitting host
have, so very long hosts and paths stay cheap and rules of any number and shape are tried. Expressions meet rules on
32 bits of SHA-256; the full digest confirms; the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The rules of the query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_RULES = 10_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def _digest(host: Column, path: Column) -> Column:
    """Digest of a host-suffix and path-prefix expression; the host's end is part of it."""
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def _small(table: DataFrame, label: str) -> DataFrame:
    """table saved; marked for broadcast where it has BROADCAST_RULES rows or less, else left to Spark's own size check."""
    table = common.save(table, label)
    return F.broadcast(table) if table.count() <= BROADCAST_RULES else table


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; columns of `pages` with these names are replaced, others of any name stay.

    A rule (host, path, verdict) fits its host and all subdomains where the path starts with the rule's; the
    longest rule wins, then the longer host, then block. Null urls and urls without :// have empty host and path,
    fit no rule and get the default. Very long urls are cut to no prefix: only expansions that a rule can match are
    made. Repeated pages and null ids are judged one by one. Empty pages give no rows, empty rules the default.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    r = rules.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"),
        _digest(F.col("host"), F.col("path")).alias("digest"),
    ).withColumn("short", _short(F.col("digest")))
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    seen = pages.select(F.struct(*[pages[c] for c in own]).alias("r"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    both = common.save(seen.select("host", "path").where("host <> ''").distinct(), "urls-seen")
    # First the suffixes of each host meet the rules' hosts, then only path lengths that rules of such a host have are tried.
    parts = F.split("host", r"\.")
    tails = both.select("host").distinct().withColumn("p", parts).withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(max(1, labels))))))
    tails = tails.select("host", F.array_join(F.slice("p", F.size("p") - F.col("n") + 1, F.col("n")), ".").alias("tail"))
    tails = tails.withColumn("tail_digest", F.sha2("tail", 256)).withColumn("short", _short(F.col("tail_digest")))
    hosts = rules.select(F.col("host").alias("rule_host"), F.char_length("path").alias("chars")).distinct()
    hosts = _small(hosts.withColumn("host_digest", F.sha2("rule_host", 256)).withColumn("short", _short(F.col("host_digest"))), "urls-hosts")
    fits = common.save(tails.join(hosts, "short").where("tail_digest = host_digest").select("host", "tail", "chars"), "urls-fits")
    wide = both.join(fits, "host").where(F.char_length("path") >= F.col("chars"))
    wide = wide.withColumn("url_digest", _digest(F.col("tail"), F.col("path").substr(F.lit(1), F.col("chars"))))
    hits = wide.withColumn("short", _short(F.col("url_digest"))).join(_small(r, "urls-rules"), "short").where("url_digest = digest")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), F.char_length("rule_host").alias("h"), "rule_verdict", "rule")).alias("b"))
    # Saved, so that AQE can split the pages of one url; most pages fit no rule and are not in it.
    best = common.save(best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "b"), "urls-best")
    out = seen.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    return out.select(*[F.col(f"r.`{c}`").alias(c) for c in own], "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.rule_verdict", F.lit(default)).alias("verdict"))


def op9(spark, sf_dir: str) -> DataFrame:
    pages = common.load(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark)).drop("url")


OP9_SQL = r"""
with r(host, path, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p as (
  select row_number() over () as n, page_id, case when url is null then '' else url end as url from pages
), u as (
  select n, page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from p
), m as (
  select u.n, r.host || r.path as rule, r.verdict, row_number() over (partition by u.n order by length(r.host || r.path) desc, length(r.host) desc, r.verdict desc) as k
  from u join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join (select * from m where k = 1) m using (n)
"""
