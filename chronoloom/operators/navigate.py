"""Walking the tree of tags: paths, what lies under a node, neighbours, and predicates on nodes.

A tree is the result of `tags.tree`: a row a node with doc_id, node (its place in
pre-order), parent, name, begin, end, attrs. It is never deeper than `tags.LEVEL` has
levels and chunks nest. A parent comes before its children, so what a node takes from
those above it is known when it comes: one pass over a document's nodes in order.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from . import tags



def _by_document(nodes: DataFrame, columns: list[str], fields: list[StructField], f: Callable[..., list[list]]) -> DataFrame:
    """Nodes with more columns: `f` of the lists of a document's columns, in the order of its nodes, and whether it has an id.

    One pass over the sorted nodes: a document is in one task, and its columns named here are in memory together.
    """
    arrow = [to_arrow_type(x.dataType) for x in fields]

    def walk(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, *lists = (tags.values(b.column(b.schema.get_field_index(c))) for c in ("doc_id", *columns))
        out, k = [[] for _ in arrow], 0
        while k < len(ids):
            j = k + 1
            while j < len(ids) and ids[j] == ids[k]:
                j += 1
            for c, more in zip(out, f(ids[k] is not None, *[x[k:j] for x in lists])):
                c += more
            k = j
        return pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, t) for c, t in zip(out, arrow)]], names=[*b.schema.names, *[x.name for x in fields]])

    rows = nodes.repartition(tags.partitions(nodes), "doc_id").sortWithinPartitions("doc_id", "node")
    return rows.mapInArrow(lambda it: tags.in_groups(it, ("doc_id",), walk), StructType([*nodes.schema.fields, *fields]))


def _syntax(known: bool, nodes: list[int], parents: list[int | None], names: list[str]) -> list[list]:
    out: dict[int, str] = {}  # parents come first
    for n, p, name in zip(nodes, parents, names):
        out[n] = f"{out[p]}-{name}" if known and p in out else name
    return [list(out.values())]


def syntax(nodes: DataFrame) -> DataFrame:
    """Nodes with `syntax`: the names from the top down to the node, joined by hyphens."""
    return _by_document(nodes, ["node", "parent", "name"], [StructField("syntax", StringType())], _syntax)


def preorder(nodes: DataFrame) -> DataFrame:
    """Nodes numbered from 0 in the order of a walk that sees parents first."""
    return nodes.withColumn("order", F.row_number().over(W.partitionBy("doc_id").orderBy("node")) - 1)


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that no node has as its parent."""

    def inner(known: bool, nodes: list[int], parents: list[int | None]) -> list[list]:
        above = set(parents) if known else ()
        return [[n in above for n in nodes]]

    return _by_document(nodes, ["node", "parent"], [StructField("_inner", BooleanType())], inner).filter("not _inner").drop("_inner")


def under(nodes: DataFrame, top: str, name: str) -> DataFrame:
    """Nodes called `name` at any depth under nodes called `top`: doc_id, top, node and the node's other columns."""
    t = nodes.filter(F.col("name") == top).select("doc_id", "begin", "end", F.col("node").alias("top"))
    n = nodes.filter(F.col("name") == name)
    out = tags.within(t, n, [c for c in n.columns if c != "doc_id"], ["top"])
    return out.withColumnRenamed("o_top", "top").filter("node <> top")


def embedded(nodes: DataFrame, name: str) -> DataFrame:
    """The first child called `name` of each node that has any: doc_id, node, child, attrs."""
    kids = nodes.filter((F.col("name") == name) & F.col("parent").isNotNull())
    return kids.groupBy("doc_id", F.col("parent").alias("node")).agg(F.min_by(F.struct(F.col("node").alias("child"), "attrs"), "node").alias("x")).select("doc_id", "node", "x.*")


def event_list(nodes: DataFrame) -> DataFrame:
    """For each sentence its events in order: doc_id, top, events array of (position among the sentence's nodes, eid)."""
    e = under(nodes, "s", "EVENT").withColumn("eid", F.col("attrs")["eid"])
    item = F.struct((F.col("node") - F.col("top") - 1).alias("position"), "eid")
    return e.groupBy("doc_id", "top").agg(F.array_sort(F.collect_list(item)).alias("events"))  # a sentence's


def _next(known: bool, nodes: list[int], parents: list[int | None], *carried: list) -> list[list]:
    sibling: dict[int, int | None] = {}
    after: dict[int | None, int] = {}
    for n, p in zip(reversed(nodes), reversed(parents)):
        sibling[n] = after.get(p)
        after[p] = n
    out: dict[int, int | None] = {}  # parents come first
    for n, p in zip(nodes, parents):
        out[n] = sibling[n] if sibling[n] is not None or not known else out.get(p)
    place = {n: k for k, n in enumerate(nodes)}
    return [list(out.values()), *[[None if x is None else c[place[x]] for x in out.values()] for c in carried]]


def next_node(nodes: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Nodes with `next_node`: the next sibling, or that of the nearest ancestor that has one; null at the right edge. `carry`: columns of that node, renamed next_..."""
    more = [StructField(f"next_{c}", nodes.schema[c].dataType) for c in carry or []]
    return _by_document(nodes, ["node", "parent", *(carry or [])], [StructField("next_node", IntegerType()), *more], _next)


def words(nodes: DataFrame, top: str) -> DataFrame:
    """The tokens under each node called `top`: doc_id, top, words array."""
    t = under(nodes, top, "lex").withColumn("text", F.col("attrs")["text"])
    return t.groupBy("doc_id", "top").agg(F.transform(F.array_sort(F.collect_list(F.struct("begin", "text"))), lambda x: x["text"]).alias("words"))


def event_markers(nodes: DataFrame, top: str = "s") -> DataFrame:
    """Tokens with the last event that covers them: doc_id, node, eid (null: none)."""

    def mark(known: bool, nodes: list[int], names: list[str], begins: list[int], ends: list[int | None], eids: list[str | None]) -> list[list]:
        out, opened = [], []  # events that the next token may lie in, the last one first
        for name, b, e, eid in zip(names, begins, ends, eids):
            opened = [x for x in opened if x[0] >= b]
            if name == "EVENT" and e is not None:
                opened.insert(0, (e, eid))
            out.append(next((x for end, x in opened if e is not None and end >= e), None) if known and name == "lex" else None)
        return [out]

    rows = nodes.filter(F.col("name").isin("lex", "EVENT")).select("doc_id", "node", "name", "begin", "end", F.col("attrs")["eid"].alias("_eid"))
    out = _by_document(rows, ["node", "name", "begin", "end", "_eid"], [StructField("eid", StringType())], mark)
    return out.filter("name = 'lex'").select("doc_id", "node", "eid")


# Predicates

AUXILIARIES = ("be", "am", "is", "are", "was", "were", "been", "being", "have", "has", "had", "having", "do", "does", "did", "done")


def token_class(pos: Column) -> Column:
    return F.when(pos.startswith("JJ"), "AdjectiveToken").otherwise("Token")


def is_main_verb(text: Column, pos: Column) -> Column:
    return pos.startswith("V") & ~F.lower(text).isin(*AUXILIARIES)


def is_preposition(pos: Column) -> Column:
    return pos == "IN"


def is_chunk(name: Column) -> Column:
    return name.isin("ng", "vg")


#: What may stand inside a verb group beside verbs.
BESIDE_VERBS = ("RB", "RBR", "RBS", "RP", ",", '"', "``", "''")


def adverbs_only(pos: Column) -> Column:
    """Whether a sequence of tags has nothing but adverbs, particles and signs; true of an empty one."""
    return F.forall(pos, lambda p: p.isin(*BESIDE_VERBS))


def without_interjections(pos: Column, items: Column) -> Column:
    """The items before the first and after the last comma or quotation mark; all where there is none."""
    sign = lambda p: p.isin(",", '"', "``")
    first = F.filter(F.transform(pos, lambda p, i: F.when(sign(p), i)), lambda i: i.isNotNull())
    low, high = F.array_min(first), F.array_max(first)
    return F.when(F.size(first) == 0, items).otherwise(F.concat(F.slice(items, 1, low), F.slice(items, high + 2, F.size(items))))
