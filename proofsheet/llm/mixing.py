"""Mixing sources to target weights [native].

Weights go down a domain-language-source tree. Each node's budget is split among its children by weight; what
a child cannot supply goes to its siblings, and only what all siblings lack reaches the parent's siblings
(each parent's budget is capped by what its whole subtree can supply). A leaf supplies full seeded epochs of
its documents and then a token-prefix of one more epoch in seeded order.

Tokens of a document: a quarter of its UTF-8 bytes, rounded up, at least one. Only DataFrame functions run.
A row's place in the seeded order is a hash of id and text. A leaf's prefix is found by descending through the digits of
that hash: sums of at most 256 buckets a leaf, then of the buckets inside the one that the budget ends in; only the rows of
the last such bucket, one in 65,536, are ordered, so a leaf with any share of all rows is never ordered in one task.

Defined cases: null domain, language or source is ``unknown``; a null or empty text has one token; null ids
and repeated rows are ordered by id then text hash, equal rows are taken or left by their place in that order; a very long
text counts by its bytes like any other; an empty table gives no rows; the document that crosses the budget is still taken.
mixed's own m_* columns replace any of these names; stage wraps its rows and so keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import unwrapped, wrapped, written

LEVELS = ("m_domain", "m_lang", "m_source")
#: A leaf table up to this many rows is broadcast; a longer one is joined on salted keys.
BROADCAST_LEAVES = 50_000
SALTS = 16
#: Hexadecimal digits of a row's place that are looked at in each step.
DIGITS = (2, 4)


@dataclass(frozen=True)
class Mix:
    """Weights are relative among siblings; unlisted names have weight 100. Budget: per mille of all tokens."""

    domain: dict[str, int] = field(default_factory=lambda: {"web": 700, "curated": 300})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 500, "de": 200, "fr": 200, "es": 100})
    source: dict[str, int] = field(default_factory=lambda: {"src0": 300})
    budget_permille: int = 600
    max_epochs: int = 2
    seed: int = 17

    def weight(self, level: str, name: Column) -> Column:
        w = F.when(F.lit(False), 100)
        for k, v in getattr(self, level[2:]).items():
            w = w.when(name == k, v)
        return w.otherwise(100)


def tree_columns(docs: DataFrame) -> DataFrame:
    """Append m_domain, m_lang, m_source and m_tokens. Sources with an even number are the web, others curated."""
    return docs.withColumns({
        "m_domain": F.when(F.col("source").isNull(), "unknown").when(F.col("source").rlike("[02468]$"), "web").otherwise("curated"),
        "m_lang": F.coalesce("lang", F.lit("unknown")),
        "m_source": F.coalesce("source", F.lit("unknown")),
        "m_tokens": F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4)).cast("long"),
    })


def split_budget(nodes: DataFrame, parent: list[str], name: str, mix: Mix) -> DataFrame:
    """nodes(parent..., name, cap, given): append share, the part of the parent's given that this child gets.

    Children are ordered by capacity over weight. With ``level`` the tokens per weight left for a child and
    all after it, a child is full if its capacity is at most level times weight; the first one that is not
    full sets the level for the rest.
    """
    df = nodes.withColumn("w", mix.weight(name, F.col(name)).cast("double"))
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    df = df.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    top = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent))
    df = df.withColumn("top", top)
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(F.lit(0), F.least(F.col("cap"), F.floor(F.col("top") * F.col("w")))))
    return df.withColumn("share", share.cast("long")).drop("w", "level", "full", "top")


def budgets(docs: DataFrame, mix: Mix, leaf_table=lambda df, name: df) -> DataFrame:
    """One row per leaf: the levels, m_have (tokens it holds), m_budget, m_full epochs and m_rest tokens."""
    leaves = leaf_table(docs.groupBy(*LEVELS).agg(F.sum("m_tokens").alias("m_have")), "mix-sums")
    total = F.lit((leaves.agg(F.sum("m_have")).first()[0] or 0) * mix.budget_permille // 1000).cast("long")
    leaves = leaves.withColumn("cap", F.col("m_have") * mix.max_epochs)
    given = leaves.groupBy("m_domain").agg(F.sum("cap").alias("cap"), F.sum("m_have").alias("m_have")).withColumn("given", total)
    given = split_budget(given, [], "m_domain", mix).select("m_domain", F.col("share").alias("given"))
    langs = leaves.groupBy("m_domain", "m_lang").agg(F.sum("cap").alias("cap")).join(given, "m_domain")
    given = split_budget(langs, ["m_domain"], "m_lang", mix).select("m_domain", "m_lang", F.col("share").alias("given"))
    leaves = split_budget(leaves.join(given, ["m_domain", "m_lang"]), ["m_domain", "m_lang"], "m_source", mix)
    full = F.floor(F.col("share") / F.col("m_have")).cast("long")
    df = leaves.withColumn("m_full", full)
    return df.select(*LEVELS, "m_have", F.col("share").alias("m_budget"), "m_full", (F.col("share") - F.col("m_full") * F.col("m_have")).alias("m_rest"))


def _with_leaves(docs: DataFrame, leaves: DataFrame, small: bool) -> DataFrame:
    if small:
        return docs.join(F.broadcast(leaves), list(LEVELS))
    salts = leaves.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("m_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")).join(salts, [*LEVELS, "m_salt"]).drop("m_salt")


def mixed(docs: DataFrame, mix: Mix, leaf_table) -> DataFrame:
    """Chosen rows of docs, with m_* columns and m_copies: how often the row is used.

    leaf_table: writes a small DataFrame to shared storage and reads it again.
    """
    docs = tree_columns(docs)
    leaves = leaf_table(budgets(docs, mix, leaf_table), "mix-leaves")
    small = leaves.count() <= BROADCAST_LEAVES
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    hashed = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), text("m_full"), text("doc_id"), F.md5(text("text").cast("binary"))).cast("binary"))
    digits = lambda n: F.substring("m_place", 1, n)
    placed = lambda table: _with_leaves(docs, table, small).withColumn("m_place", hashed)
    leaves = leaves.withColumns({"m_end": F.lit(""), "m_left": F.col("m_rest")})
    for n in DIGITS:
        inside = placed(leaves).filter(F.col("m_place").startswith(F.col("m_end")))
        sums = inside.groupBy(*LEVELS, digits(n).alias("m_bucket")).agg(F.sum("m_tokens").alias("n"), F.first("m_left").alias("m_left"))
        upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("upto", upto).filter((F.col("upto") - F.col("n") < F.col("m_left")) & (F.col("upto") >= F.col("m_left")))
        ends = sums.select(*LEVELS, F.col("m_bucket").alias("m_end"), (F.col("m_left") - (F.col("upto") - F.col("n"))).alias("m_left"))
        leaves = leaf_table(leaves.drop("m_end", "m_left").join(ends, list(LEVELS), "left"), "mix-ends")
    rows = placed(leaves).withColumn("m_bucket", digits(DIGITS[-1]))
    # A rest of 0 has no end bucket: no document of the last epoch is taken.
    inner = rows.filter(F.coalesce(F.col("m_bucket") != F.col("m_end"), F.lit(True))).withColumn("m_more", F.coalesce((F.col("m_bucket") < F.col("m_end")).cast("long"), F.lit(0)))
    edge = rows.filter(F.col("m_bucket") == F.col("m_end"))
    order = Window.partitionBy(*LEVELS).orderBy("m_place", "doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("m_more", (F.coalesce(F.sum("m_tokens").over(order), F.lit(0)) < F.col("m_left")).cast("long"))
    df = inner.unionByName(edge).withColumn("m_copies", F.col("m_full") + F.col("m_more")).filter("m_copies > 0")
    return df.drop("m_place", "m_bucket", "m_end", "m_left", "m_more")


def stage(docs: DataFrame, mix: Mix, leaf_table) -> DataFrame:
    """The rows chosen, repeated for each epoch that uses them. Columns as in the input."""
    inner = wrapped(docs, **{c: F.col(c) for c in ("doc_id", "text", "lang", "source")})
    df = mixed(inner, mix, leaf_table)
    if mix.max_epochs > 1:
        df = df.withColumn("m_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m_copies"))))
    return unwrapped(df, docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    df = mixed(docs, Mix(), written)
    return df.select("doc_id", F.col("m_domain").alias("domain"), F.col("m_lang").alias("lang"), F.col("m_source").alias("source"), F.col("m_tokens").alias("tokens"), F.col("m_budget").alias("leaf_budget"), F.col("m_copies").alias("copies"))


def _share_sql(nodes: str, parent: str, name: str, weights: dict[str, int]) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    case = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 100 END"
    return f"""SELECT * EXCLUDE (w, lv, top, f), CAST(CASE WHEN f THEN cap ELSE greatest(0, least(cap, floor(top * w))) END AS BIGINT) AS share FROM (
  SELECT *, max(CASE WHEN NOT f THEN lv END) OVER ({by}) AS top FROM (SELECT *, cap <= lv * w AS f FROM (
    SELECT *, (given - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER ({by} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
    FROM (SELECT *, CAST({case} AS DOUBLE) AS w FROM {nodes}))))"""


def oracle(mix: Mix) -> str:
    return f"""
WITH d AS (SELECT doc_id, text, CASE WHEN source IS NULL THEN 'unknown' WHEN regexp_matches(source, '[02468]$') THEN 'web' ELSE 'curated' END AS domain,
  coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(greatest(1, ceil(coalesce(strlen(text), 0) / 4.0)) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS have, CAST(sum(tokens) * {mix.max_epochs} AS BIGINT) AS cap FROM d GROUP BY ALL),
n1 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(sum(have) * {mix.budget_permille} // 1000 AS BIGINT) FROM leaf) AS given FROM leaf GROUP BY domain),
s1 AS ({_share_sql('n1', '', 'domain', mix.domain)}),
n2 AS (SELECT l.domain, lang, CAST(sum(l.cap) AS BIGINT) AS cap, any_value(share) AS given FROM leaf l JOIN s1 USING (domain) GROUP BY l.domain, lang),
s2 AS ({_share_sql('n2', 'domain', 'lang', mix.lang)}),
n3 AS (SELECT l.domain, l.lang, source, have, l.cap, share AS given FROM leaf l JOIN s2 USING (domain, lang)),
s3 AS ({_share_sql('n3', 'domain, lang', 'source', mix.source)}),
b AS (SELECT domain, lang, source, share, share // have AS full_epochs, share - (share // have) * have AS rest FROM s3),
p AS (SELECT doc_id, text, tokens, b.*, md5('{mix.seed}:' || full_epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place FROM d JOIN b USING (domain, lang, source)),
q AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id NULLS FIRST, md5(coalesce(text, ''))
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT doc_id, domain, lang, source, tokens, share AS leaf_budget, CAST(full_epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM q WHERE full_epochs + CASE WHEN before < rest THEN 1 ELSE 0 END > 0
"""


ORACLE = oracle(Mix())
