"""Inputs for the registered queries, built from the driver's tables, and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Events: one an order, in the document of its customer.
EVENTS_SQL = """ev AS (
  SELECT o_custkey AS doc_id, 'ei' || o_orderkey AS eiid, CAST(o_orderkey % 997 AS INT) AS b, CAST(o_orderkey % 997 + 3 + o_orderkey % 7 AS INT) AS e,
         CAST(o_orderkey AS INT) AS seq, CAST(o_orderkey % 997 // 100 AS INT) AS sentence,
         CASE o_orderkey % 3 WHEN 0 THEN 'PAST' WHEN 1 THEN 'PRESENT' ELSE 'FUTURE' END AS tense,
         CASE o_orderkey % 5 WHEN 0 THEN 'PERFECTIVE' WHEN 1 THEN 'PROGRESSIVE' ELSE 'NONE' END AS aspect,
         CASE WHEN o_orderkey % 4 = 0 THEN 'NOUN' ELSE 'VERB' END AS epos
  FROM orders)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.concat(F.lit("ei"), k).alias("eiid"), (k % 997).cast("int").alias("begin"), (k % 997 + 3 + k % 7).cast("int").alias("end"),
        k.cast("int").alias("seq"), F.floor(k % 997 / 100).cast("int").alias("sentence"),
        F.when(k % 3 == 0, "PAST").when(k % 3 == 1, "PRESENT").otherwise("FUTURE").alias("tense"),
        F.when(k % 5 == 0, "PERFECTIVE").when(k % 5 == 1, "PROGRESSIVE").otherwise("NONE").alias("aspect"),
        F.when(k % 4 == 0, "NOUN").otherwise("VERB").alias("epos"), F.lit("EVENT").alias("name"),
    )


#: Subordination links: an order and the next one of the same customer.
SLINKS_SQL = """sl AS (
  SELECT doc_id, 'l' || seq AS lid, eiid AS src, lead(eiid) OVER (PARTITION BY doc_id ORDER BY seq) AS tgt,
         CASE seq % 4 WHEN 0 THEN 'FACTIVE' WHEN 1 THEN 'MODAL' ELSE 'EVIDENTIAL' END AS relation, seq FROM ev)"""


def slinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = events(spark, sf_dir)
    link = F.when(F.col("seq") % 4 == 0, "FACTIVE").when(F.col("seq") % 4 == 1, "MODAL").otherwise("EVIDENTIAL")
    out = e.select("doc_id", F.concat(F.lit("l"), "seq").alias("lid"), F.col("eiid").alias("src"), F.lead("eiid").over(W.partitionBy("doc_id").orderBy("seq")).alias("tgt"), link.alias("relation"), "seq")
    return out.filter("tgt is not null")


#: Line items numbered within their order without repetition.
LINES_SQL = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS n FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return read(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w))


#: Times: one a line item, in the document of its order, as a day, a month or a year.
TIMES_SQL = f"""{LINES_SQL}, tx AS (
  SELECT l_orderkey AS doc_id, 't' || n AS tid, 'DATE' AS type, CAST(n AS INT) AS seq, CAST(n * 20 AS INT) AS b, CAST(n * 20 + 8 AS INT) AS e,
         CASE n % 3 WHEN 0 THEN strftime(l_shipdate, '%Y%m%d') WHEN 1 THEN strftime(l_shipdate, '%Y%m') ELSE strftime(l_shipdate, '%Y') END AS value
  FROM li)"""


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    v = F.when(n % 3 == 0, F.date_format("l_shipdate", "yyyyMMdd")).when(n % 3 == 1, F.date_format("l_shipdate", "yyyyMM")).otherwise(F.date_format("l_shipdate", "yyyy"))
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("t"), n).alias("tid"), F.lit("DATE").alias("type"), n.cast("int").alias("seq"), (n * 20).cast("int").alias("begin"), (n * 20 + 8).cast("int").alias("end"), v.alias("value"), F.lit("TIMEX3").alias("name"))


#: Sentences over orders: an absolute date and two that depend on the document's date.
SENTENCES_SQL = """sn AS (
  SELECT o_orderkey AS doc_id, 'Order A' || o_orderkey || ' was placed on ' || strftime(o_orderdate, '%B %-d, %Y') || '.' AS s1, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k FROM orders)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    first = F.concat(F.lit("Order A"), F.col("o_orderkey"), F.lit(" was placed on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("."))
    return o.select(F.col("o_orderkey").alias("doc_id"), first.alias("text"), F.col("o_orderdate").cast("date").alias("dct"), F.col("o_orderkey").alias("k"))


#: Nodes of a sentence, one a line item: its kind, text, event and time.
NODES_SQL = f"""{LINES_SQL}, nd AS (
  SELECT l_orderkey AS doc_id, 1 AS sentence, CAST(n AS INT) AS pos,
         CASE (l_orderkey + n) % 4 WHEN 1 THEN 'lex' WHEN 2 THEN 'ng' ELSE 'vg' END AS node,
         CASE WHEN (l_orderkey + n) % 4 = 1 THEN CASE l_orderkey % 5 WHEN 0 THEN 'after' WHEN 1 THEN 'Before' WHEN 2 THEN 'during' WHEN 3 THEN 'on' ELSE 'beside' END ELSE 'x' END AS text,
         CASE WHEN (l_orderkey + n) % 4 IN (0, 3) AND l_partkey % 5 > 0 THEN 'ei' || n END AS eiid,
         CASE WHEN (l_orderkey + n) % 4 = 2 AND l_partkey % 3 > 0 THEN 't' || n END AS tid
  FROM li)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n = (F.col("l_orderkey") + F.col("n")) % 4, F.col("n")
    word = F.element_at(F.array(*map(F.lit, ("after", "Before", "during", "on", "beside"))), (F.col("l_orderkey") % 5 + 1).cast("int"))
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("sentence"), n.cast("int").alias("pos"), F.when(m == 1, "lex").when(m == 2, "ng").otherwise("vg").alias("node"),
        F.when(m == 1, word).otherwise("x").alias("text"), F.when(m.isin(0, 3) & (F.col("l_partkey") % 5 > 0), F.concat(F.lit("ei"), n)).alias("eiid"),
        F.when((m == 2) & (F.col("l_partkey") % 3 > 0), F.concat(F.lit("t"), n)).alias("tid"),
    )


#: Trees: a document an order, a token a line item; sentences of four tokens, noun groups of two, an event on odd tokens of some parts.
def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.col("n").cast("int")
    last = F.count("*").over(W.partitionBy("l_orderkey")).cast("int")  # lines are numbered from 1 without gaps
    l = lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), n.alias("n"), last.alias("last"), ((n % 2 == 1) & (F.col("l_partkey") % 3 == 0)).alias("event"), "l_returnflag")  # noqa: E741
    n = F.col("n")
    attrs = lambda *kv: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in kv]), F.array(*[v for _, v in kv]))
    node = lambda name, to, a: F.struct(F.lit(name).alias("name"), (n * 10).alias("begin"), (to * 10 + 5).alias("end"), n.alias("seq"), a.alias("attrs"))
    none = F.create_map().cast("map<string,string>")
    lex = node("lex", n, attrs(("text", F.concat("l_returnflag", n.cast("string")))))
    ev = F.when(F.col("event"), node("EVENT", n, attrs(("eid", F.concat(F.lit("e"), n.cast("string"))))))
    groups = [F.when((n - 1) % k == 0, node(name, F.least(n + (k - 1), F.col("last")), none)) for name, k in (("s", 4), ("ng", 2))]
    return l.select("doc_id", F.explode(F.array(lex, ev, *groups)).alias("x")).filter("x is not null").select("doc_id", "x.*")
