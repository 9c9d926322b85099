"""Domain relations derived from the shared tables, in Spark and (for checks) in SQL.

The formulas are plain integer arithmetic, so that both engines give the same rows. Relations are lazy DataFrames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Side of the square test images that embeddings are stacked to.
SIDE = 64

# Pairs of texts: the turn before, or a planted variant of the turn itself.
_PAIR_VARIANTS = (
    (0, "text"),
    (1, "concat(text, ' LOT 42')"),
    (2, "substr(text, 12)"),
    (3, "replace(text, 'the', 'teh 7')"),
)

SQL = {
    "pixel": f"""SELECT vec_id // {SIDE} AS image_id, vec_id % {SIDE} AS y, unnest(range(len(embedding))) AS x,
        unnest(list_transform(embedding, lambda e: least(255, greatest(0, CAST(floor((CAST(e AS DOUBLE) + 0.6) * 212.5) AS BIGINT))))) AS v FROM embeddings
        UNION ALL SELECT image_id, y, unnest(range({SIDE})) AS x, 255 AS v FROM (SELECT m // {SIDE} AS image_id, unnest(range(m % {SIDE} + 1, {SIDE})) AS y FROM (SELECT max(vec_id) AS m FROM embeddings))""",
    "pixel_pair": """SELECT image_id, y, x, v AS a, CASE WHEN image_id % 5 > 0 AND y BETWEEN 3 AND 3 + 6 * (image_id % 5) AND x BETWEEN 10 AND 9 + 10 * (image_id % 5)
        AND (y + x) % 29 < 24 THEN (v + 128) % 256 ELSE v END AS b FROM pixel""",
    "ocr_line": """SELECT doc_id, pos, text, (doc_id * 37 + pos * 53) % 400 AS x1, pos * 24 AS y1, (doc_id * 37 + pos * 53) % 400 + 8 * least(length(line), 120) AS x2,
        pos * 24 + 18 AS y2, (800 + (doc_id * 31 + pos * 17) % 200) / 1000.0::DOUBLE AS confidence FROM (SELECT doc_id, p AS pos, trim(line) AS text, line FROM
        (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents)) WHERE text <> ''""",
    "region_candidate": """SELECT p_partkey % 20 AS page_index, p_partkey AS region_id, (p_partkey * 37) % 1000 AS x, (p_partkey * 91 + p_size * 13) % 1000 AS y,
        20 + p_size AS width, 10 + p_size % 17 AS height, (500 + (p_partkey * 7919) % 500) / 1000.0::DOUBLE AS confidence, (p_partkey % 3) % 2 AS class_id FROM part""",
    "match_candidate": """SELECT o_orderkey AS cand_id, o_orderkey % 40 AS page_index, (o_custkey % 4) * 90 AS rotation, (300 + (o_orderkey * 7919) % 700) / 1000.0::DOUBLE AS score,
        (o_custkey * 37) % 900 AS x1, (o_orderkey * 53) % 900 AS y1, (o_custkey * 37) % 900 + 60 + (o_orderkey % 5) * 10 AS x2, (o_orderkey * 53) % 900 + 50 + (o_orderkey % 7) * 10 AS y2 FROM orders""",
    "keypoint": """SELECT vec_id AS kp_id, vec_id % 2 AS side, (vec_id * 29) % 640 AS x, (vec_id * 43) % 480 AS y,
        CAST(list_sum(list_transform(range(32), lambda p: CASE WHEN embedding[p + 1] > 0 THEN 1::BIGINT << p ELSE 0 END)) AS BIGINT) AS d0,
        CAST(list_sum(list_transform(range(32), lambda p: CASE WHEN embedding[p + 33] > 0 THEN 1::BIGINT << p ELSE 0 END)) AS BIGINT) AS d1 FROM embeddings""",
    "alignment": """SELECT c_custkey AS region_id, ((c_custkey * 17) % 41 - 20) / 4.0::DOUBLE AS x, ((c_custkey * 23) % 37 - 18) / 4.0::DOUBLE AS y, ((c_custkey * 13) % 31 - 15) / 20.0::DOUBLE AS rotation_degrees,
        1 + ((c_custkey * 7) % 41 - 20) / 1000.0::DOUBLE AS scale, c_custkey % 11 <> 0 AS success, 600 + c_custkey % 5 * 100 AS w, 400 + c_custkey % 3 * 100 AS h FROM customer""",
    "text_pair": f"""SELECT conv_id, turn, coalesce(source, '') AS a, CASE {' '.join(f"WHEN (conv_id + turn) % 8 = {k} THEN {e}" for k, e in _PAIR_VARIANTS)} ELSE text END AS b FROM
        (SELECT conv_id, turn, text, CASE WHEN (conv_id + turn) % 8 < {len(_PAIR_VARIANTS)} THEN text ELSE lag(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS source FROM conversations) WHERE source IS NOT NULL""",
    "run_log": "SELECT event_id, user_id AS run_id, event_type AS stage, value AS elapsed_s, ts FROM events",
    "diff_box": """SELECT region_id, page_index, x, y, width, height, width * height % 97 AS area, (width * height % 97) / (1 + region_id % 5 * 4000.0::DOUBLE) AS area_ratio FROM region_candidate""",
    "feature_box": f"""SELECT p_partkey AS region_id, p_partkey % (SELECT max(vec_id) // {SIDE} + 1 FROM embeddings) AS image_id, (p_partkey * 37) % 56 AS x, (p_partkey * 91 + p_size) % 56 AS y,
        least(2 + (p_size * 7 + p_partkey) % 24, {SIDE} - (p_partkey * 37) % 56) AS width, least(2 + (p_size + p_partkey) % 9, {SIDE} - (p_partkey * 91 + p_size) % 56) AS height FROM part""",
}


def _striped(x):
    """Whether a sample of the second image differs, by its column and the row's image_id and y."""
    k = F.col("image_id") % 5
    return (k > 0) & F.col("y").between(F.lit(3), 3 + 6 * k) & x.between(F.lit(10), 9 + 10 * k) & ((F.col("y") + x) % 29 < 24)


class Relations:
    """Lazy DataFrames of the tables (by name) and of the derived relations."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def image_row(self) -> DataFrame:
        """image_id, y, a, b: the samples of one row of an image pair as arrays. Each vector is a row; the last image is filled
        up with white rows. b is a with stripes of a rectangle changed, whose size depends on the image."""
        vectors = self.table("embeddings")
        level = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.6) * 212.5))).cast("int")
        rows = vectors.select(F.floor(F.col("vec_id") / SIDE).alias("image_id"), (F.col("vec_id") % SIDE).alias("y"), F.transform("embedding", level).alias("a"))
        last = vectors.agg(F.max("vec_id").alias("m")).filter(F.col("m") % SIDE < SIDE - 1)
        blank = last.select(F.floor(F.col("m") / SIDE).alias("image_id"), F.explode(F.sequence(F.col("m") % SIDE + 1, F.lit(SIDE - 1).cast("long"))).alias("y"), F.array_repeat(F.lit(255), SIDE).alias("a"))
        return rows.unionByName(blank).withColumn("b", F.transform("a", lambda v, x: F.when(_striped(x), (v + 128) % 256).otherwise(v)))

    @cached_property
    def pixel(self) -> DataFrame:
        """image_id, y, x, v: one row a pixel."""
        df = self.image_row.select("image_id", "y", F.posexplode("a").alias("x", "v"))
        return df.select("image_id", "y", *[F.col(c).cast("long").alias(c) for c in ("x", "v")])

    @cached_property
    def pixel_pair(self) -> DataFrame:
        """image_id, y, x, a, b: one row a pixel of both images."""
        df = self.pixel.withColumnRenamed("v", "a")
        return df.withColumn("b", F.when(_striped(F.col("x")), (F.col("a") + 128) % 256).otherwise(F.col("a")))

    @cached_property
    def ocr_line(self) -> DataFrame:
        """doc_id, pos, text, x1, y1, x2, y2, confidence: the lines of documents with words, as recognised lines of a page."""
        df = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("text", F.trim("line")).filter("text <> ''")
        x1 = (F.col("doc_id") * 37 + F.col("pos") * 53) % 400
        y1 = F.col("pos").cast("long") * 24
        sure = (800 + (F.col("doc_id") * 31 + F.col("pos") * 17) % 200) / F.lit(1000.0)
        return df.select("doc_id", F.col("pos").cast("long").alias("pos"), "text", x1.alias("x1"), y1.alias("y1"), (x1 + 8 * F.least(F.length("line"), F.lit(120))).alias("x2"), (y1 + 18).alias("y2"), sure.alias("confidence"))

    @cached_property
    def region_candidate(self) -> DataFrame:
        k, s = F.col("p_partkey"), F.col("p_size").cast("long")
        return self.table("part").select(
            (k % 20).alias("page_index"), k.alias("region_id"), (k * 37 % 1000).alias("x"), ((k * 91 + s * 13) % 1000).alias("y"),
            (20 + s).alias("width"), (10 + s % 17).alias("height"), ((500 + k * 7919 % 500) / F.lit(1000.0)).alias("confidence"), (k % 3 % 2).alias("class_id"),
        )

    @cached_property
    def match_candidate(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        x, y = c * 37 % 900, k * 53 % 900
        return self.table("orders").select(
            k.alias("cand_id"), (k % 40).alias("page_index"), (c % 4 * 90).alias("rotation"), ((300 + k * 7919 % 700) / F.lit(1000.0)).alias("score"),
            x.alias("x1"), y.alias("y1"), (x + 60 + k % 5 * 10).alias("x2"), (y + 50 + k % 7 * 10).alias("y2"),
        )

    @cached_property
    def keypoint(self) -> DataFrame:
        """kp_id, side, x, y and a 64-bit descriptor as two numbers of 32 bits: the signs of the vector."""
        k = F.col("vec_id")

        def bits(first: int):
            part = F.transform(F.slice("embedding", first + 1, 32), lambda e, p: F.when(e > 0, F.pow(F.lit(2.0), p)).otherwise(0.0))
            return F.aggregate(part, F.lit(0.0), lambda a, b: a + b).cast("long")

        return self.table("embeddings").select(k.alias("kp_id"), (k % 2).alias("side"), (k * 29 % 640).alias("x"), (k * 43 % 480).alias("y"), bits(0).alias("d0"), bits(32).alias("d1"))

    @cached_property
    def alignment(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("region_id"), ((k * 17 % 41 - 20) / F.lit(4.0)).alias("x"), ((k * 23 % 37 - 18) / F.lit(4.0)).alias("y"), ((k * 13 % 31 - 15) / F.lit(20.0)).alias("rotation_degrees"),
            (1 + (k * 7 % 41 - 20) / F.lit(1000.0)).alias("scale"), (k % 11 != 0).alias("success"), (600 + k % 5 * 100).alias("w"), (400 + k % 3 * 100).alias("h"),
        )

    @cached_property
    def text_pair(self) -> DataFrame:
        """conv_id, turn, a, b: a text and another version of it, or the turn before and the turn."""
        kind = (F.col("conv_id") + F.col("turn")) % 8
        before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
        df = self.table("conversations").withColumn("source", F.when(kind < len(_PAIR_VARIANTS), F.col("text")).otherwise(before)).filter("source IS NOT NULL")
        b = F.when(F.lit(False), "")
        for k, e in _PAIR_VARIANTS:
            b = b.when(kind == k, F.expr(e))
        return df.select("conv_id", "turn", F.col("source").alias("a"), b.otherwise(F.col("text")).alias("b"))

    @cached_property
    def run_log(self) -> DataFrame:
        return self.table("events").select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("elapsed_s"), "ts")

    @cached_property
    def diff_box(self) -> DataFrame:
        area = F.col("width") * F.col("height") % 97
        return self.region_candidate.select("region_id", "page_index", "x", "y", "width", "height", area.alias("area"), (area / (1 + F.col("region_id") % 5 * F.lit(4000.0))).alias("area_ratio"))

    @cached_property
    def feature_box(self) -> DataFrame:
        """Boxes inside the test images."""
        k, s = F.col("p_partkey"), F.col("p_size").cast("long")
        x, y = k * 37 % 56, (k * 91 + s) % 56
        n_images = self.table("embeddings").agg(F.floor(F.max("vec_id") / SIDE) + 1).scalar()
        return self.table("part").select(k.alias("region_id"), (k % n_images).alias("image_id"), x.alias("x"), y.alias("y"), F.least(2 + (s * 7 + k) % 24, SIDE - x).alias("width"), F.least(2 + (s + k) % 9, SIDE - y).alias("height"))
