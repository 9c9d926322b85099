"""URL filter [native]: host/path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter keeps eight 64-bit lanes per block; a listed URL sets one bit in each lane of one block. It grows with the
list up to the bound in ``bloom.py``, so it can be broadcast; a list beyond that meets all pages in the join. Pages that
it lets pass as possible hits meet the list in an exact join by hash, which removes false positives; the others skip the
join. Spark picks the join: a large list is sorted and may spill.

Defined cases: an empty table gives no rows; a very long url is judged like others; u_* and b_* columns of the input are
replaced by those made here; a null url or one without ``://`` has an empty host and path, fits no rule and is never
listed, so it is allowed; repeated rows give one result each; an empty list blocks nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import blocks_for, bloom, with_maybe

#: (verdict, host, path). A rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Hosts whose pages the query lists.
JUNK_HOSTS = "(^|[.-])(ads|casino|bets|spam|pills|adult)([.-]|$)"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query, all empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Without scheme, www. or m., closing slashes, utm_ parameters and fragment; null for an empty host."""
    site = F.regexp_replace(host, r"^(www|m)\.", "")
    kept = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&+", "")
    return F.when(host != "", F.concat(site, F.regexp_replace(path, r"/+$", ""), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Append u_host, u_path, u_key (canonical form), u_rule and u_rule_verdict. The longest rule wins."""
    host, path, query = url_parts(F.col("url"))
    df = pages.withColumns({"u_host": F.coalesce(host, F.lit("")), "u_path": F.coalesce(path, F.lit("")), "u_query": F.coalesce(query, F.lit(""))})
    rule, verdict = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("u_host") == h) | F.col("u_host").endswith("." + h)) & F.col("u_path").startswith(p)
        rule, verdict = rule.when(fits, h + p), verdict.when(fits, what)
    key = canonical(F.col("u_host"), F.col("u_path"), F.col("u_query"))
    return df.withColumns({"u_key": key, "u_rule": rule, "u_rule_verdict": verdict}).drop("u_query")


def listed(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """Append u_listed to pages that have u_key: whether it is among keys (column u_key; repeats and nulls are ignored)."""
    keys = keys.select("u_key").filter(F.col("u_key").isNotNull()).distinct()
    n = blocks_for(keys.count())
    exact = lambda df: df.join(keys.withColumn("u_listed", F.lit(True)), "u_key", "left").withColumn("u_listed", F.coalesce("u_listed", F.lit(False)))
    if not n:
        return exact(pages)
    maybe = with_maybe(pages, "u_key", bloom(keys, "u_key", n), n)
    passed = exact(maybe.filter("b_maybe").drop("b_maybe"))
    rest = maybe.filter(~F.col("b_maybe")).drop("b_maybe").withColumn("u_listed", F.lit(False))
    return rest.unionByName(passed)


def block_list(pages: DataFrame) -> DataFrame:
    """The query's list: the URLs of all pages on hosts with a junk word in their name."""
    return pages.filter(F.col("u_host").rlike(JUNK_HOSTS)).select("u_key")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_rules(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    df = listed(pages, block_list(pages))
    verdict = F.coalesce("u_rule_verdict", F.when(F.col("u_listed"), "block").otherwise("allow"))
    return df.select("page_id", F.col("u_host").alias("host"), F.col("u_path").alias("path"), F.col("u_rule").alias("rule"), verdict.alias("verdict"), F.col("u_listed").alias("listed"))


_RULE_SQL = "\n".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{what}}}{h}{p}'" for what, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)))
ORACLE = f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(query, '(^|&)utm_[^&]*', '', 'g'), '^&+', '') AS q,
        CASE {_RULE_SQL} END AS found FROM b),
d AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS key FROM c),
l AS (SELECT DISTINCT key FROM d WHERE key IS NOT NULL AND regexp_matches(host, '{JUNK_HOSTS}'))
SELECT page_id, host, path, substr(found, instr(found, '}}') + 1) AS rule,
  CASE WHEN starts_with(found, '{{block}}') THEN 'block' WHEN found IS NOT NULL THEN 'allow' WHEN key IN (SELECT key FROM l) THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(key IN (SELECT key FROM l), false) AS listed
FROM d
"""
