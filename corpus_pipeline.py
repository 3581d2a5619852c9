"""From raw documents to tokens: quality, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is
written as Parquet in the shared folder before the next one reads it. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from chronoloom.llm import bpe, linededup, minhash, mixing, quality
from chronoloom.llm._spark import cut
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more; the others go.

    Null and empty texts have no features and go or stay by the intercept; rows that repeat are scored alike; an empty table stays one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels), 0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least 10 documents hold; n_chars follows the text where there is such a column.

    A null text has no lines to lose and stays null; rows that repeat a doc_id with the same text are one document when lines are counted.
    """
    out = linededup.apply(docs, linededup.keep_bitmaps(docs, min_docs=10, min_chars=1))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id. Rows with a null doc_id stay; of rows that repeat a doc_id one stays."""
    kept = cut(minhash.report(docs, percent=70, width=5).filter("doc_id is not null and kept").select(F.col("doc_id").alias("_kept")).distinct(), "kept")
    out = docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        row = F.struct(*[F.col(c) for c in docs.columns])
        first = out.groupBy("doc_id").agg(F.min(F.xxhash64(row)).alias("_first")).withColumnRenamed("doc_id", "_id")
        out = out.withColumn("_hash", F.xxhash64(row)).join(first, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_first"))).dropDuplicates(["doc_id"]).select(*docs.columns)
    none = docs.filter("doc_id is null")
    return out if none.isEmpty() else out.union(none)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: each as often as the schedule takes the block that holds its middle word.

    A document may come twice at most, and one whose block isn't taken, or without
    words (null and empty texts), not at all. A null source is a source of its own, the last one. Rows that agree in
    source, doc_id and size come equally often.
    """
    rows, _, slots = mixing.plan(docs)
    middle = rows.filter("size > 0").selectExpr("s", "source", "doc_id", "size", "(start + size div 2) div 64 as block", "(start + size div 2) % 64 as at")
    seen = middle.join(slots.select(F.col("s").alias("_s"), F.col("block").alias("_block"), "words"), (F.col("s") == F.col("_s")) & (F.col("block") == F.col("_block")) & (F.col("words") > F.col("at")), "left")
    times = seen.groupBy("source", "doc_id", "size", "block", "at").agg(F.count("words").alias("n"))
    times = times.groupBy(F.col("source").alias("_source"), F.col("doc_id").alias("_id"), F.col("size").alias("_size")).agg(F.ceil(F.avg("n")).cast("int").alias("n")).filter("n > 0")
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    left = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), size.alias("_words"))
    on = F.col("row.source").cast("string").eqNullSafe(F.col("_source")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_size"))
    out = left.join(times.hint("shuffle_hash"), on).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, and the digests of nothing. Rows that repeat are encoded each.
    """
    return bpe.report(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Training a classifier can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
