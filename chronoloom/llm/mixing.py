"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents are shuffled by hash and cut into blocks of equally many words (the
last one may be short), and a source needs as many slots as blocks make up its target: pass after
pass over its blocks, the last slot cut off where the target ends. Point i of the schedule is the
fraction of i * golden ratio, in integers of 64 bits so that no precision is lost as i
grows. The points are mapped through the sources' cumulative numbers of slots, so
every stretch of the schedule holds each source close to its share. Slots are ranked per
source, and slot r takes block r (modulo the source's blocks). Points beyond what a source needs
are left out, and the few slots that the points don't give a source follow at the end, so every
source's words taken are its target, rounded.

Nothing is gathered by source: positions are prefix sums over (source, hash bucket)
and slots are ranked by (source, stretch of points); both add the starts of buckets
computed from their sums. Only the table of sources passes through one task, and the
driver holds it as well; `most_sources` bounds it, and more sources raise an error.

Defined results: a null text has size 0; a document of size 0 takes nothing but is
returned; a null source is a source, ordered last. Repeated rows are documents each.
Ties of the shuffle are broken by doc_id and size; rows that agree in those as well
are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import cut

GOLDEN = 11400714819323198485  # 2**64 / golden ratio
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Share `share` of the total by weight; a source stops at `most` times its size and its excess is shared again."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    open_, rest = [i for i in range(len(sizes))], total
    while open_:
        w = sum(weights[i] for i in open_)
        level = rest / w if w else 0.0
        full = [i for i in open_ if level * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _shuffle_key(doc_id: str, size: str) -> str:
    return f"cast(conv(substr(md5(concat(coalesce(cast({doc_id} as string), ''), ':', cast({size} as string))), 1, 15), 16, 10) as long)"


def slots_needed(size: int, words: int, block: int) -> int:
    """Slots that take `words` words of a source of `size` words, pass after pass."""
    return words // size * -(-size // block) + -(-(words % size) // block) if size else 0


def _points(batches: Iterator[pa.RecordBatch], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = b.column(0).to_numpy().astype(np.uint64) * np.uint64(GOLDEN)
        s = np.searchsorted(edges, x, "right")
        yield pa.record_batch([b.column(0), pa.array(s.astype(np.int32))], ["i", "s"])


def plan(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block: int = 64, most_sources: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, pieces, slots) of the mix.

    rows: s, source, doc_id, size, h, copy, start and the source's source_size and target.
    pieces: the parts of documents in blocks (s, block, at, length, words).
    slots: the schedule (i, s, rank, block, words).
    """
    spark = docs.sparkSession
    small = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    small = cut(small.withColumn("h", F.expr(_shuffle_key("doc_id", "size"))), "mix")
    # count is at most one row a source
    per = small.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last())
    table = per.limit(most_sources + 1).collect()
    if len(table) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sizes = [r["size"] for r in table]
    weight = [weights[k % len(weights)] for k in range(len(table))]
    goal = targets(sizes, weight, share, most)
    words = [math.floor(g + 0.5) for g in goal]
    need = [slots_needed(n, w, block) for n, w in zip(sizes, words)]
    # from Arrow, as a list of tuples goes through Python workers of its own kind, which then wait beside the others
    columns = [("source", pa.string(), [r["source"] for r in table]), ("s", pa.int32(), range(len(table))), ("source_size", pa.int64(), sizes), ("target", pa.float64(), map(float, goal)), ("goal", pa.int64(), words), ("need", pa.int64(), need)]
    sources = spark.createDataFrame(pa.table({k: pa.array(list(x), t) for k, t, x in columns}))
    rows = small.join(F.broadcast(sources.drop("goal", "need").withColumnRenamed("source", "_source")), small["source"].eqNullSafe(F.col("_source")), "left").drop("_source")

    # prefix sums over (source, bucket of the shuffle order)
    n = max(1, sum(r["n"] for r in table))
    bits = max(0, math.ceil(math.log2(max(1, n / 20_000))))
    rows = rows.withColumn("_b", F.shiftright("h", 60 - bits) if bits else F.lit(0).cast("long"))
    starts = rows.groupBy("s", "_b").agg(F.sum("size").alias("_t"))
    starts = starts.select("s", "_b", (F.sum("_t").over(W.partitionBy("s").orderBy("_b")) - F.col("_t")).alias("_o"))
    within = W.partitionBy("s", "_b").orderBy("h", "doc_id", "size")
    rows = rows.withColumn("_p", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).withColumn("copy", F.row_number().over(within))
    rows = rows.join(starts, ["s", "_b"]).withColumn("start", F.col("_o") + F.col("_p")).drop("_b", "_o", "_p")
    rows = cut(rows, "mix-rows")

    inside = rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    at = f"greatest(start, block * {block})"
    pieces = inside.selectExpr("s", "doc_id", "size", "h", "copy", "start", "block", f"{at} - block * {block} as at", f"least(start + size, (block + 1) * {block}) - {at} as length")

    count = sum(need)
    edges = np.array([(k << 64) // max(1, count) for k in itertools.accumulate(need[:-1])], np.uint64)  # the last source has what is left
    points = spark.range(count).mapInArrow(lambda it: _points(it, edges), "i long, s int").withColumn("_c", F.expr("i div 65536"))
    begun = points.groupBy("s", "_c").agg(F.count("*").alias("_n"))
    given = begun.groupBy("s").agg(F.sum("_n").alias("_given"))  # one row a source at most
    begun = begun.select("s", "_c", (F.sum("_n").over(W.partitionBy("s").orderBy("_c")) - F.col("_n")).alias("_o"))
    ranked = points.withColumn("_r", F.row_number().over(W.partitionBy("s", "_c").orderBy("i"))).join(begun, ["s", "_c"]).select("i", "s", (F.col("_o") + F.col("_r") - 1).alias("rank"))
    short = sources.select("s", "need").join(given, "s", "left").withColumn("_given", F.coalesce("_given", F.lit(0))).filter("_given < need")
    short = short.select((F.lit(count) + F.col("s")).alias("i"), "s", F.explode(F.expr("sequence(_given, need - 1)")).alias("rank"))
    slots = ranked.union(short).join(F.broadcast(sources.drop("source")), "s").filter("rank < need").withColumn("_blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    before = f"rank div _blocks * source_size + rank % _blocks * {block}"
    slots = slots.selectExpr("i", "s", "rank", "rank % _blocks as block", f"least({block}, source_size - rank % _blocks * {block}, goal - ({before})) as words")
    return rows, pieces, slots


def stream(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """The mix itself: for every slot i the parts of documents that it takes, with the words taken."""
    # keys are single blocks, each met by at most a few slots and a block's worth of pieces
    out = pieces.join(slots, ["s", "block"]).withColumn("taken", F.expr("greatest(0L, least(at + length, words) - at)"))
    return out.filter("taken > 0")


def mix(docs: DataFrame, **how: object) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    rows, pieces, slots = plan(docs, **how)
    got = stream(pieces, slots).groupBy(*[F.col(c).alias(f"_{c}") for c in ("s", "start", "doc_id", "size", "copy")]).agg(F.sum("taken").alias("_taken"))
    on = (F.col("s") == F.col("_s")) & (F.col("start") == F.col("_start")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("size") == F.col("_size")) & (F.col("copy") == F.col("_copy"))
    return rows.join(got, on, "left").select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), g AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM d GROUP BY source
), w AS (
  SELECT source, source_size, s, CASE s % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM g
), o AS (  -- sources by the level at which they are full
  SELECT *, sum(source_size) OVER () * 1.5 - coalesce(sum(2.0 * source_size) OVER before, 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w
  FROM w WINDOW before AS (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max(rest / open_w) FILTER (WHERE rest / open_w * w < 2.0 * source_size) AS l FROM o
), t AS (
  SELECT source, source_size, s, least(coalesce(l, 1e300) * w, 2.0 * source_size) AS target FROM o, level
), q AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal, (source_size + 63) // 64 AS blocks FROM t
), n AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE goal // source_size * blocks + (goal % source_size + 63) // 64 END AS need FROM q
), e AS (
  SELECT *, CAST(sum(need) OVER () AS HUGEINT) AS every, CAST(sum(need) OVER (ORDER BY s) AS HUGEINT) AS upto, CAST(sum(need) OVER (ORDER BY s) - need AS HUGEINT) AS before FROM n
), points AS (
  SELECT i, (CAST(i AS HUGEINT) * 11400714819323198485) % 18446744073709551616 AS u FROM range((SELECT CAST(sum(need) AS BIGINT) FROM n)) r(i)
), met AS (
  SELECT s, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS rank
  FROM points JOIN e ON u >= before * 18446744073709551616 // every AND u < CASE WHEN upto = every THEN 18446744073709551616 ELSE upto * 18446744073709551616 // every END
), slots AS (  -- the ranks that the points give a source and those they don't are all that it needs
  SELECT s, rank FROM met JOIN n USING (s) WHERE rank < need
  UNION ALL SELECT s, unnest(range(coalesce((SELECT count(*) FROM met WHERE met.s = n.s), 0), need)) FROM n
), taken_slots AS (
  SELECT s, rank % blocks AS block, least(64, source_size - rank % blocks * 64, goal - (rank // blocks * source_size + rank % blocks * 64)) AS words FROM slots JOIN n USING (s)
), placed AS (
  SELECT d.doc_id, d.size, t.s, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY t.s ORDER BY ('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.size), 1, 15))::BIGINT, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), pieces AS (
  SELECT doc_id, s, block, greatest(start, block * 64) - block * 64 AS off, least(start + size, (block + 1) * 64) - greatest(start, block * 64) AS length
  FROM (SELECT *, unnest(range(CAST(start AS BIGINT) // 64, (CAST(start AS BIGINT) + size - 1) // 64 + 1)) AS block FROM placed WHERE size > 0)
), got AS (
  SELECT doc_id, sum(greatest(0, least(off + length, words) - off)) AS taken FROM pieces JOIN taken_slots USING (s, block) GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN got USING (doc_id)
"""
