"""Cutting lineage, joins that withstand hot keys, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def shared(spark: SparkSession, tag: str) -> str:
    """A new folder in the one that all executors share, spark.checkpoint.dir; it goes when the session ends.

    Where that is unset, a local session gets a folder of this machine; any other must set it.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        own = tempfile.mkdtemp(prefix="chronoloom-")
        sc.setCheckpointDir(own)
        fs, p = _hadoop(spark, own)
        fs.deleteOnExit(p)
    path = f"{sc.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again, so that what follows doesn't recompute it and survives lost executors."""
    spark = df.sparkSession
    path, before = shared(spark, tag), spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")  # what was shuffled to write it isn't needed once it is written
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by `cut` that nothing reads any more."""
    for t in tables:
        fs, p = _hadoop(t.sparkSession, t._written)
        fs.delete(p, True)


#: A key is hot from this share of all rows on, so 1/HOT keys are at most, and not below HOT_ROWS.
HOT = 1e-5
HOT_ROWS = 10_000


def hot_join(left: DataFrame, right: DataFrame, key: str, n: str, rows: int, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """Join on one key. `right` has one row a key and in `n` its number of rows on the left, of `rows` in all; `counts` has n beside the key where `right` has not.

    A hot key is split: its left rows get one of as many salts as it has parts of HOT
    of all rows, and its right row comes once a salt. Of the hot keys, 1/HOT at
    most, only key and number of parts are broadcast. `right` itself grows with the data and is
    never broadcast, however small it is here, so that plans are alike at every size.
    """
    least = max(HOT_ROWS, int(rows * HOT))
    values = [c for c in right.columns if c not in (key, n)]
    if rows <= least:  # no key can be hot
        plain = right.select(F.col(key).alias("_rk"), *[F.col(c).alias(f"_v_{c}") for c in values])
        return left.join(plain.hint("merge"), left[key] == plain["_rk"], how).select(*left.columns, *[F.col(f"_v_{c}").alias(c) for c in values])
    hot = F.broadcast((right if counts is None else counts).filter(F.col(n) > least).select(F.col(key).alias("_hk"), F.ceil(F.col(n) / least).cast("int").alias("_parts")))
    by_row = F.xxhash64(*[F.col(c) for c in left.columns])
    out = left.join(hot, left[key] == F.col("_hk"), "left")
    # rows without a key match nothing, wherever they are
    salt = F.when(F.col(key).isNull(), -1 - F.pmod(by_row, F.lit(4096))).otherwise(F.pmod(by_row, F.coalesce("_parts", F.lit(1)))).cast("int")
    out = out.withColumn("_ls", salt).drop("_hk", "_parts")
    split = right.join(hot, right[key] == F.col("_hk"), "left").withColumn("_rs", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    split = split.select(F.col(key).alias("_rk"), "_rs", *[F.col(c).alias(f"_v_{c}") for c in values])
    out = out.join(split.hint("merge"), (out[key] == split["_rk"]) & (out["_ls"] == split["_rs"]), how)
    return out.select(*left.columns, *[F.col(f"_v_{c}").alias(c) for c in values])


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of edges (a, b): a row (node, root) for each node in an edge, root being the smallest node.

    Alternates large-star and small-star steps until nothing changes. Each step
    aggregates a minimum a node (combined before the shuffle) and joins it back, a hub's
    edges in parts; no neighbourhood is ever gathered. Loops and repeated edges don't matter.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), tag)
    before, rows = None, e.count()
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both, low.withColumnRenamed("k", "a"), "a", "n", 2 * rows, "inner")
        large = large.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, low, "a", "n", rows, "inner")
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        last, e = e, cut(small, tag)
        drop(last)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.count_distinct("a")).first()
        rows = state[0]
        if state[0] == state[2] and before == tuple(state):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = tuple(state)
