"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards. A row descends level by
level: at each node every child draws `-ln(u) / weight`, u being a hash of the row's
key and the child's name, and the least draw wins. A child's draw depends on its own
name and weight alone, so when the weight of one child grows (or one child is added)
a row moves only if that child now wins, and rows below the siblings never move:
movement is confined to the subtrees whose weights change.

Law `key`: the key and the tree decide, nothing else. A tree for n shards is grown to
n + 1 by a region of its own for the new shard, so no draw between old nodes changes
and the new shard takes rows only into itself.

Groups of equal texts are not kept together: under this law doc_id and number of shards decide alone, so
the copies of a text lie where their own ids put them.

Defined results: a null key draws as the text "null"; rows with equal keys share a shard (copies of a
text under different keys needn't); a null text has no bytes. Slots number the rows
of a shard from 0 without gaps, ordered by (bucket, doc_id, size, text_crc32), and
exact copies of a row get consecutive slots. Extra columns are carried along by `assign`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 1.0
    children: tuple["Node", ...] = ()
    shard: int = -1

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree(n: int, racks: int = 2, per_rack: int = 2, grown: int = 0) -> Node:
    """n shards of equal weight in regions of `racks` racks of `per_rack` shards; then `grown` more, each in a region of its own."""
    regions, k = [], 0
    while k < n:
        r = len(regions)
        inside = []
        for a in range(racks):
            shards = tuple(Node(f"r{r}/k{a}/s{i}", 1.0, (), i) for i in range(k, min(k + per_rack, n)))
            k += len(shards)
            if shards:
                inside.append(Node(f"r{r}/k{a}", 0, shards))
        regions.append(Node(f"r{r}", 0, tuple(inside)))
    for g in range(grown):
        regions.append(Node(f"g{g}", 0, (Node(f"g{g}/k0", 0, (Node(f"g{g}/k0/s{n + g}", 1.0, (), n + g),)),)))
    return Node("root", 0, tuple(regions))


def place(key: Column, root: Node) -> Column:
    """The shard number that a key descends to, as one expression over the key."""
    inner: dict[str, Node] = {}
    shards: dict[str, int] = {}
    depth = 0

    def walk(node: Node, level: int) -> None:
        nonlocal depth
        depth = max(depth, level)
        if not node.children:
            shards[node.name] = node.shard
            return
        inner[node.name] = node
        for c in node.children:
            walk(c, level + 1)

    walk(root, 0)
    table = F.create_map(*[x for name, node in inner.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(c.total).alias("weight")) for c in node.children]))])
    numbers = F.create_map(*[x for name, k in shards.items() for x in (F.lit(name), F.lit(k))])
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def draw(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-F.log(u) / child["weight"]).alias("d"), child["name"].alias("name"))

    at = F.lit(root.name)
    for _ in range(depth):  # a shard above the lowest level stays where it is
        below = F.array_min(F.transform(F.element_at(table, at), draw))["name"]
        at = F.when(F.array_contains(F.map_keys(numbers), at), at).otherwise(below) if len({len(n.split("/")) for n in shards}) > 1 else below
    return F.element_at(numbers, at)


def assign(docs: DataFrame, root: Node, key: str = "doc_id", to: str = "shard") -> DataFrame:
    """`docs` with the shard of each row in column `to`, in place: no row is moved."""
    return docs.withColumn(to, place(docs[key], root).cast("int"))


def slots(placed: DataFrame, by: list[str], rows_per_bucket: int = 100_000) -> DataFrame:
    """Add `slot`, gapless from 0 within each `shard`.

    Shards may be huge, so they are numbered by hash buckets: equal rows are first
    counted (combined before the shuffle), buckets are counted, their starts summed,
    and rows numbered within their bucket only.
    """
    from pyspark.sql import Window as W

    total = placed.count()
    buckets = max(1, -(-total // rows_per_bucket))
    cols = [c for c in placed.columns if c not in by and c != "shard"]
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets))
    rows = placed.groupBy("shard", bucket.alias("_bucket"), *by, *cols).agg(F.count("*").alias("_n"))
    starts = rows.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_rows"))
    over = W.partitionBy("shard").orderBy("_bucket")
    starts = starts.select("shard", "_bucket", (F.sum("_rows").over(over) - F.col("_rows")).alias("_start"))
    within = W.partitionBy("shard", "_bucket").orderBy(*by, *cols)
    rows = rows.withColumn("_at", F.sum("_n").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    rows = rows.join(starts, ["shard", "_bucket"]).withColumn("_first", F.col("_start") + F.col("_at"))
    # copies of one row take a block of slots, opened in two steps to keep arrays short
    rows = rows.withColumn("_block", F.explode(F.expr("sequence(0L, (_n - 1) div 65536)")))
    rows = rows.withColumn("_i", F.explode(F.expr("sequence(_block * 65536, least(_n, (_block + 1) * 65536) - 1)")))
    return rows.select(*placed.columns, (F.col("_first") + F.col("_i")).alias("slot"))


def shard(docs: DataFrame, n: int = 16, racks: int = 2, per_rack: int = 2) -> DataFrame:
    """Per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    small = assign(small, tree(n, racks, per_rack))
    small = assign(small, tree(n, racks, per_rack, 1), to="grown_shard")
    out = slots(cut(small, "shards"), ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, n: int = 16, key: str = "doc_id", racks: int = 2, per_rack: int = 2) -> None:
    """Write all rows and columns under `path/shard=k/`, several files a shard as its size needs."""
    assign(docs, tree(n, racks, per_rack), key).write.partitionBy("shard").parquet(path)
