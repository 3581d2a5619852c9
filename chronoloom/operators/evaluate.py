"""Comparing annotation with gold: counts, precision, recall, alignment and regression tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common(gold: DataFrame, system: DataFrame, key: str = "file", leave_out: tuple[str, ...] = ()) -> DataFrame:
    """Files that both sides have."""
    return gold.select(key).intersect(system.select(key)).filter(~F.col(key).isin(*leave_out) if leave_out else F.lit(True))


def entity_counts(gold: DataFrame, system: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp and fn of spans (by..., begin, end), each counted once."""
    k = [*by, "begin", "end"]
    g = gold.select(*k).distinct().withColumn("g", F.lit(1))
    s = system.select(*k).distinct().withColumn("s", F.lit(1))
    both = g.join(s, k, "full_outer")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.groupBy(*by).agg(n(F.col("g").isNotNull() & F.col("s").isNotNull()).alias("tp"), n(F.col("g").isNull()).alias("fp"), n(F.col("s").isNull()).alias("fn"))


def scores(counts: DataFrame) -> DataFrame:
    """precision, recall and F; null where nothing is divided by nothing."""
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f", F.try_divide(2 * p * r, p + r))


def accuracy(correct: Column, incorrect: Column) -> Column:
    return F.try_divide(correct, correct + incorrect)


def link_counts(gold: DataFrame, system: DataFrame, by: list[str]) -> DataFrame:
    """Links between the same spans in the same direction: how many have the same relation, and the accuracy.

    Both: by..., b1, e1, b2, e2, relation.
    """
    k = [*by, "b1", "e1", "b2", "e2"]
    both = gold.select(*k, F.col("relation").alias("g")).join(system.select(*k, F.col("relation").alias("s")), k)
    out = both.groupBy(*by).agg(F.count("*").alias("overlap"), F.sum((F.col("g") == F.col("s")).cast("int")).cast("long").alias("correct"), F.sum((F.col("g") != F.col("s")).cast("int")).cast("long").alias("incorrect"))
    return out.withColumn("accuracy", accuracy(F.col("correct"), F.col("incorrect")))


def totals(counts: DataFrame, by: str) -> DataFrame:
    """Counts of each file and, with a null file, of all."""
    return counts.rollup(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def status(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """How a gold span (1) and a system span (2) meet; null stands for no span."""
    return F.when(b1.isNull(), "NO_MATCH_FP").when(b2.isNull(), "NO_MATCH_FN").when((b1 == b2) & (e1 == e2), "EXACT").when((b1 < e2) & (b2 < e1), "PARTIAL").otherwise("NO_MATCH")


ALIGNED = "doc_id string, g_begin long, g_end long, s_begin long, s_end long"


def _align(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def walk(doc_id: str, rows: pd.DataFrame) -> list[tuple]:
        g = sorted({(b, e) for b, e, s in zip(rows["begin"], rows["end"], rows["side"]) if s == "g"})
        s = sorted({(b, e) for b, e, x in zip(rows["begin"], rows["end"], rows["side"]) if x == "s"})
        i = j = 0
        out = []
        while i < len(g) or j < len(s):
            if i < len(g) and j < len(s) and g[i][0] < s[j][1] and s[j][0] < g[i][1]:
                out.append((doc_id, *g[i], *s[j]))
                i, j = i + 1, j + 1
            elif j >= len(s) or (i < len(g) and g[i] < s[j]):
                out.append((doc_id, *g[i], None, None))
                i += 1
            else:
                out.append((doc_id, None, None, *s[j]))
                j += 1
        return out

    names = ALIGNED.replace(",", "").split()[::2]
    held = None
    for pdf in it:
        both = pdf if held is None else pd.concat([held, pdf])
        if not len(both):
            continue
        last = both["doc_id"].iloc[-1]
        done, held = both[both["doc_id"] != last], both[both["doc_id"] == last]
        out = [r for d, rows in done.groupby("doc_id", sort=False) for r in walk(d, rows)]
        if out:
            yield pd.DataFrame(out, columns=names).astype(dict.fromkeys(names[1:], "Int64"))
    if held is not None and len(held):
        yield pd.DataFrame(walk(held["doc_id"].iloc[0], held), columns=names).astype(dict.fromkeys(names[1:], "Int64"))


def align(gold: DataFrame, system: DataFrame) -> DataFrame:
    """Greedy alignment from left to right of the distinct spans of each document."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id")  # rows without an id are one document
    both = gold.select(key, "begin", "end", F.lit("g").alias("side")).union(system.select(key, "begin", "end", F.lit("s").alias("side")))
    out = both.repartition("doc_id").sortWithinPartitions("doc_id").mapInPandas(_align, ALIGNED)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit("")).cast("long"))


def alignment_counts(aligned: DataFrame, limit: int | None = None) -> DataFrame:
    """Strict (exact) and relaxed (exact or partial) counts; with `limit`, of that many documents by their ids."""
    if limit is not None:
        aligned = aligned.join(aligned.select("doc_id").distinct().orderBy("doc_id").limit(limit), "doc_id", "left_semi")
    s = status(F.col("g_begin"), F.col("g_end"), F.col("s_begin"), F.col("s_end"))
    n = lambda *x: F.sum(F.col("status").isin(*x).cast("int")).cast("long")
    return aligned.withColumn("status", s).agg(n("EXACT").alias("exact"), n("PARTIAL").alias("partial"), n("NO_MATCH_FP").alias("fp"), n("NO_MATCH_FN").alias("fn"))


def compare_baseline(old: DataFrame, new: DataFrame, attributes: list[str]) -> DataFrame:
    """Tags of two runs by (doc_id, name, begin): only in the old, only in the new, or attributes that differ."""
    k = ["doc_id", "name", "begin"]
    o = old.select(*k, F.struct(*attributes).alias("o"))
    n = new.select(*k, F.struct(*attributes).alias("n"))
    both = o.join(n, k, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"o.{a}").eqNullSafe(F.col(f"n.{a}")), F.lit(a)) for a in attributes]))
    return both.select(*k, F.when(F.col("n").isNull(), "OLD").when(F.col("o").isNull(), "NEW").when(F.size(differ) > 0, "DIFF").otherwise("SAME").alias("state"), F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), F.array_join(differ, ",")).alias("differ"))


def trend(results: DataFrame) -> DataFrame:
    """Case results by run: identifier, then a column a run with + or -."""
    return results.groupBy("identifier").pivot("run").agg(F.first("result"))


def report(counts: DataFrame) -> Column:
    del counts
    return F.format_string("tp=%d fp=%d fn=%d precision=%.2f recall=%.2f f-score=%.2f", "tp", "fp", "fn", "precision", "recall", "f")


def slink_cases(docs: DataFrame, sentences: DataFrame, events: DataFrame, links: DataFrame) -> DataFrame:
    """A case a subordination link: doc_id, relation, syntax, b1, e1, b2, e2 (within the sentence, its white space made single) and the sentence.

    docs: doc_id, text. sentences: doc_id, begin, end. events: doc_id, eiid, begin, end. links: doc_id, src, tgt, relation, syntax.
    """
    a = events.select("doc_id", F.col("eiid").alias("src"), F.col("begin").alias("p1"), F.col("end").alias("q1"))
    z = events.select("doc_id", F.col("eiid").alias("tgt"), F.col("begin").alias("p2"), F.col("end").alias("q2"))
    s = sentences.select("doc_id", F.col("begin").alias("sb"), F.col("end").alias("se"))
    rows = links.join(a, ["doc_id", "src"]).join(z, ["doc_id", "tgt"]).join(s, "doc_id").filter("sb <= p1 and se >= p1").join(docs.select("doc_id", "text"), "doc_id")
    part = lambda b, e: F.substring(F.col("text"), F.col(b) + 1, F.col(e) - F.col(b))
    rows = rows.withColumn("sentence", F.trim(F.regexp_replace(part("sb", "se"), r"\s+", " "))).withColumn("w1", part("p1", "q1")).withColumn("w2", part("p2", "q2"))
    at = lambda w: F.expr(f"position({w}, sentence) - 1")
    rows = rows.withColumn("b1", at("w1")).withColumn("b2", at("w2")).filter("b1 >= 0 and b2 >= 0")
    return rows.select("doc_id", "relation", "syntax", "b1", (F.col("b1") + F.length("w1")).alias("e1"), "b2", (F.col("b2") + F.length("w2")).alias("e2"), "sentence")


def html_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """(row, html): a table row for each row of a table, its cells being these columns as text; null is an empty cell. Write them between HEAD and TAIL."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = [F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in columns]
    return table.select(F.col(columns[0]).alias("row"), F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


HEAD, TAIL = "<html><body><table>", "</table></body></html>"


def graph_html(edges: DataFrame) -> DataFrame:
    """(doc_id, html): a document's graph of links as a page with a row an edge: source, relations, target, where it comes from."""
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<tr><td>"), "src", F.lit("</td><td>"), safe("relations"), F.lit("</td><td>"), "tgt", F.lit("</td><td>"), "source", F.lit("</td></tr>"))
    out = edges.withColumn("_l", line).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "tgt", "_l"))), lambda x: x["_l"]), "").alias("_b"))
    return out.select("doc_id", F.concat(F.lit(HEAD), "_b", F.lit(TAIL)).alias("html"))
