"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove, skew_join

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any ordered type -> (node, root): each node of an edge with the least node of its component.

    A round costs two joins on the edges; a node with a large share of all edges is not gathered in one task for them.
    Each round is written to shared storage, so that lineage stays short and a lost executor costs one round at most.
    Null ends and loops are ignored; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    spark, schema, before = edges.sparkSession, edges.schema, None

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path), path

    edges, path = kept(edges)
    for _ in range(MAX_ROUNDS):
        mark = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        mark = (mark["n"], int(mark["h"]))
        if mark == before or mark[0] == 0:
            return edges.select(a.alias("node"), b.alias("root")).unionByName(edges.select(b.alias("node"), b.alias("root")).distinct())
        before = mark
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = skew_join(both, least, ["a"], "n").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).filter(a != b)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = skew_join(large, least, ["a"], "n")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        last = path
        edges, path = kept(small.filter(a != b).distinct())
        remove(spark, last)  # the new round does not need it any more
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
