"""The tag table: look-ups, containment joins, numbering and renaming.

Containment joins meet on (doc_id, bin) with bins of a fixed width instead of
comparing all tags of a document with all elements.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from .annotate import partitions

BIN = 256


def order() -> list[Column]:
    """Begin up, wider first, no extent last, then insertion order."""
    return [F.col("begin").asc_nulls_last(), F.col("end").desc(), F.col("seq").asc()]


def find(tags: DataFrame, name: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Tags of a name, or those of them within [begin, end]."""
    out = tags.filter(F.col("name") == name)
    return out if begin is None else out.filter((F.col("begin") >= begin) & (F.col("end") <= end))


def find_at(tags: DataFrame, begin: int) -> DataFrame:
    return tags.filter(F.col("begin") == begin)


def first_of(tags: DataFrame, name: str) -> DataFrame:
    """The tag of a name that was inserted first, a row a document."""
    t = find(tags, name)
    return t.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in t.columns if c != "doc_id"]), "seq").alias("t")).select("doc_id", "t.*")


def within(outer: DataFrame, inner: DataFrame, keep: list[str], carry: list[str]) -> DataFrame:
    """Inner rows that lie in outer ones: `keep` of the inner, `carry` of the outer (renamed o_...)."""
    o = outer.select("doc_id", F.col("begin").alias("o_begin"), F.col("end").alias("o_end"), *[F.col(c).alias(f"o_{c}") for c in carry if c not in ("begin", "end")])
    o = o.withColumn("bin", F.explode(F.sequence(F.floor(F.col("o_begin") / BIN), F.floor(F.col("o_end") / BIN))))
    i = inner.withColumn("bin", F.floor(F.col("begin") / BIN))
    out = i.join(o, ["doc_id", "bin"]).filter((F.col("begin") >= F.col("o_begin")) & (F.col("end") <= F.col("o_end")))
    return out.select("doc_id", *keep, *[f"o_{c}" for c in carry])


def has_event(spans: DataFrame, events: DataFrame, there: bool = True) -> DataFrame:
    """Spans that hold (or don't hold) an event with exactly their extent."""
    return spans.join(events.select("doc_id", "begin", "end"), ["doc_id", "begin", "end"], "left_semi" if there else "left_anti")


def add(tags: DataFrame, more: DataFrame) -> DataFrame:
    return tags.unionByName(more)


def add_events(tags: DataFrame, more: DataFrame) -> DataFrame:
    """Add events, the first one at a span winning; those at a span that has one are dropped."""
    both = tags.withColumn("_new", F.lit(0)).unionByName(more.withColumn("_new", F.lit(1)))
    first = W.partitionBy("doc_id", "begin", "end", F.when(F.col("name") == "EVENT", F.lit(0)).otherwise(F.struct("_new", "seq", "name").cast("string").isNotNull().cast("int") + 1)).orderBy("_new", "seq")
    return both.withColumn("_k", F.row_number().over(first)).filter((F.col("name") != "EVENT") | (F.col("_k") == 1)).drop("_k", "_new")


def remove(tags: DataFrame, name: str) -> DataFrame:
    return tags.filter(F.col("name") != name)


def import_tags(tags: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """Tags with those of one name from another table, in its order after one's own."""
    last = tags.groupBy("doc_id").agg(F.max("seq").alias("_m"))
    more = find(source, name).join(last, "doc_id", "left")
    place = F.coalesce("_m", F.lit(-1)) + F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))
    return tags.unionByName(more.withColumn("seq", place.cast("int")).select(*tags.columns))


def number(tags: DataFrame, prefix: str, to: str = "id") -> DataFrame:
    """Identifiers prefix1, prefix2, ... in tag order within each document."""
    return tags.withColumn(to, F.concat(F.lit(prefix), F.row_number().over(W.partitionBy("doc_id").orderBy(*order()))))


def identifier(tid: Column, eiid: Column, lid: Column) -> Column:
    return F.coalesce(tid, eiid, lid)


def rename_reserved(attrs: Column) -> Column:
    """Attributes named begin or end become begin_1 and end_1, or the next free number."""
    keys = F.map_keys(attrs)

    def name(k: Column) -> Column:
        free = F.filter(F.sequence(F.lit(1), F.size(keys) + 1), lambda n: ~F.array_contains(keys, F.concat(k, F.lit("_"), n.cast("string"))))
        return F.when(k.isin("begin", "end"), F.concat(k, F.lit("_"), F.element_at(free, 1).cast("string"))).otherwise(k)

    return F.transform_keys(attrs, lambda k, _: name(k))


def link_extents(links: DataFrame, ends: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Links with the extent of their two ends, both of which must lie in [low, high]; links with an unknown end are dropped.

    `ends`: (doc_id, id, begin, end) of events and times.
    """
    s = ends.select("doc_id", F.col("id").alias("src"), F.col("begin").alias("b1"), F.col("end").alias("e1"))
    t = ends.select("doc_id", F.col("id").alias("tgt"), F.col("begin").alias("b2"), F.col("end").alias("e2"))
    out = links.join(s, ["doc_id", "src"]).join(t, ["doc_id", "tgt"])
    out = out.withColumn("begin", F.least("b1", "b2")).withColumn("end", F.greatest("e1", "e2"))
    return out if low is None else out.filter((F.col("begin") >= low) & (F.col("end") <= high))


def text_of(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, begin + 1, end - begin)


def includes(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    return (b1 <= b2) & (e1 >= e2)


def overlaps(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Touching ends overlap as well."""
    return ~((e1 < b2) | (e2 < b1))


#: For equal extents: sentence, chunk, event or time, token.
LEVEL = {"docelement": 5, "s": 4, "ng": 3, "vg": 3, "EVENT": 2, "TIMEX3": 2, "lex": 1}


def level(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LEVEL.items() for x in kv])[name]


def tree(tags: DataFrame) -> DataFrame:
    """Parent of each tag: the smallest tag that contains it, of a higher level where extents are equal.

    Adds node (place in the order of the document) and parent (its node, null at the top), depth-first order as
    sort order, and `orphan`: it crosses a tag that came before it in the order of levels.
    """
    t = tags.filter(F.col("begin").isNotNull()).withColumn("_level", level(F.col("name"))).filter("_level is not null")
    t = t.repartition(partitions(t), "doc_id").sortWithinPartitions("doc_id", "begin", F.col("end").desc(), F.col("_level").desc(), "seq")
    added = [StructField("node", IntegerType()), StructField("parent", IntegerType()), StructField("orphan", BooleanType())]
    out = t.mapInArrow(_parents, StructType([*t.schema.fields, *added]))
    return out.select("doc_id", "node", *[c for c in tags.columns if c != "doc_id"], "parent", "orphan")


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tags in order with their place, parent and whether they cross another: those that may hold the next one stay open."""
    doc, place, opened = None, 0, []  # opened: end, level, begin, place

    def walk(b: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal doc, place, opened
        ids, begins, ends, levels = (values(b.column(b.schema.get_field_index(c))) for c in ("doc_id", "begin", "end", "_level"))
        nodes, parents, orphans = [], [], []
        k, n = 0, len(ids)
        while k < n:
            d, at = ids[k], begins[k]
            if d != doc:
                doc, place, opened = d, 0, []
            elif opened:
                opened = [x for x in opened if x[0] >= at]
            j = k
            while j < n and begins[j] == at and ids[j] == d:  # tags that begin together may hold or cross each other
                place += 1
                nodes.append(place)
                if levels[j] > 1 and ends[j] is not None and ends[j] >= at and d is not None:
                    opened.append((ends[j], levels[j], at, place))
                j += 1
            for i in range(k, j):
                e, lv, best, cross = ends[i], levels[i], None, False
                if e is not None:
                    for pe, pl, pb, p in opened:
                        if pl > lv:
                            if pe >= e:
                                if best is None or (pe - pb, pl, p) < best:
                                    best = (pe - pb, pl, p)
                            elif pe > at:
                                cross = True
                parents.append(best and best[2])
                orphans.append(cross)
            k = j
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.int32()), pa.array(parents, pa.int32()), pa.array(orphans, pa.bool_())], names=[*b.schema.names, "node", "parent", "orphan"])

    return in_groups(batches, ("doc_id", "begin"), walk)


def values(a: pa.Array) -> list:
    """A column as a list, by way of NumPy, which takes a tenth of the time."""
    if pa.types.is_string(a.type) or (not a.null_count and pa.types.is_integer(a.type)):
        return a.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(a.type):
        return [None if gone else x for gone, x in zip(a.is_null().to_numpy(zero_copy_only=False).tolist(), a.fill_null(0).to_numpy().tolist())]
    return a.to_pylist()


def in_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`f` of batches that never end within a group of rows with equal keys; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.get_field_index(c)) for c in keys]
        last = [c[-1].as_py() for c in columns]
        cut = b.num_rows
        if [c[0].as_py() for c in columns] == last:
            cut = 0
        else:
            lists = [values(c) for c in columns]
            while all(v[cut - 1] == x for v, x in zip(lists, last)):
                cut -= 1
        if held:
            first = [held[-1].column(b.schema.get_field_index(c))[-1].as_py() for c in keys]
            if cut == 0 and first == last:
                held.append(b)
                continue
        if cut or held:
            yield f(_one([*held, b.slice(0, cut)]))
        held = [b.slice(cut)]
    if held:
        yield f(_one(held))


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    batches = [b for b in batches if b.num_rows]
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def children(nodes: DataFrame) -> DataFrame:
    """Nodes with their position among their parent's children and the next sibling's node."""
    w = W.partitionBy("doc_id", "parent").orderBy("node")
    return nodes.withColumn("position", F.row_number().over(w) - 1).withColumn("next", F.lead("node").over(w))
