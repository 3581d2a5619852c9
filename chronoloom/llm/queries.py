"""The queries op1 to op10 and the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(_read(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.report(_read(spark, sf_dir, "documents"), percent=70, width=5)


def op3_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.search(_read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.report(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(_read(spark, sf_dir, "pages"), min_bytes=100)


def op7_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hmm

    return hmm.score(_read(spark, sf_dir, "documents"))


def op8_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import itq

    return itq.links(_read(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    return linededup.report(_read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard(_read(spark, sf_dir, "documents"), n=16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_minhash_dedup, op3_quality_ftrl, op4_adaptive_scan, op5_byte_bpe, op6_warc_index, op7_hidden_markov_lm, op8_itq_dedup, op9_line_dedup, op10_hash_tree_shards)}


_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = f"""
WITH l AS (
  SELECT doc_id, i, line, {_FOLD.format(f"trim(line, {_STRIP})")} AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), bad AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(bad.k) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN bad ON l.k = bad.k GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    from . import itq, minhash, mixing, warc

    return {"op1_mix_sources": mixing.SQL, "op2_minhash_dedup": minhash.SQL, "op6_warc_index": warc.SQL, "op8_itq_dedup": itq.SQL, "op9_line_dedup": OP9_SQL}
