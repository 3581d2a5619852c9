"""MinHash near-dedup with odd sketches.

1. Each document becomes its set of word shingles, as 64-bit hashes; documents of
   equal sets are one class, so copies are never compared.
2. A class has BANDS * ROWS MinHash values in bands, and odd sketches: sample i sets
   (toggles) one bit of a parity bitmap, so the bits in which two bitmaps differ
   tell how many samples differ, very sharply where similarity is high.
3. Classes that share a band are candidates. In a bucket every member is paired with
   one member picked by hash, a different one in each band, so a bucket of m gives m
   pairs, not m * m. Pairs whose sketches are too far apart are dropped; the rest are
   confirmed on full sets, and linked.
4. What is linked is put together in components. Pairs in a bucket whose
   members are still in different components are then looked at exhaustively: bucket
   members go in blocks to tasks that compare sketches of block against block, and
   only pairs that pass are confirmed on full sets. So no link is lost for want of a
   lucky partner, and no pair within a component is ever made again. Members of a
   bucket beyond BLOCK meet only where they share a second such bucket too, as a
   linked pair does, so that what a template makes alike isn't compared all with all.

Candidate search misses a pair of similarity 0.7 with probability
(1 - 0.7**ROWS)**BANDS, 2e-8 here, and 5e-7 if all buckets that the pair shares are beyond BLOCK;
less above. The sketch test lets a pair pass that is at the threshold with all but SLACK standard deviations.

Defined results: texts without words (null, empty) have an empty set and link with
nothing. With fewer words than a shingle, the whole sequence is the only one. Rows that
repeat a doc_id share its component and the smallest doc_id of all copies is kept.
Rows with a null doc_id can't be named by a component: they are returned with a null
component, kept, and link nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import components, cut, drop, hot_join

U64 = T.U64
ROWS, BANDS = 3, 42
SKETCH_BITS = 1024
SLACK = 5.0
BLOCK = 1024
FILTER_BITS = 26  # log2 of the size of a filter, at most: 8 MB
_rng = np.random.default_rng(20_240_607)
_MUL = (_rng.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint64) | U64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts of a slice: (row, hash), by row and hash."""
    low = T.LOWER[data]
    start, end, row = T.words(low, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    word = T.hashes(low, start, end)
    h = word.copy()
    number = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(number) - number
    size = np.minimum(number, width)
    # a window begins at every word but the last width - 1 of a text, at the first in any case
    begin = np.arange(len(word)) - first[row] <= number[row] - size[row]
    n = len(word)
    for k in range(1, width):
        more = np.zeros(n, U64)
        more[: max(n - k, 0)] = word[k:]
        inside = size[row] > k
        h = np.where(inside, T.mix(h * U64(0x9E3779B97F4A7C15) + more), h)
    h = T.mix(h + size[row].astype(U64))[begin]
    row = row[begin]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def signatures(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that have shingles, their MinHash values, where their shingles begin)."""
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    out = np.empty((len(edge), ROWS * BANDS), np.uint32)
    x = (h >> U64(32)).astype(np.uint32)
    buffer = np.empty_like(x)
    for k in range(ROWS * BANDS):
        np.multiply(x, _MUL[k], out=buffer)
        buffer += _ADD[k]
        if len(edge):
            out[:, k] = np.minimum.reduceat(buffer, edge)
    return row[edge] if len(edge) else edge, out, edge


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """Parity bitmaps of MinHash samples: 64-bit words, a row each."""
    n, k = mins.shape
    place = (T.mix(mins.astype(U64) + (np.arange(k, dtype=U64) << U64(32))) % U64(SKETCH_BITS)).astype(np.int64)
    bits = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + place).ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(U64)


def most_differing(threshold: float) -> int:
    """Differing bits that a pair of this similarity has at most, SLACK standard deviations beyond the mean."""
    k = ROWS * BANDS
    differ = k * (1 - threshold) + SLACK * np.sqrt(k * threshold * (1 - threshold))  # samples
    p = (1 - (1 - 2 / SKETCH_BITS) ** (2 * min(k, differ))) / 2
    return int(np.ceil(SKETCH_BITS * p + 1))


def sketch_similarity(differing: np.ndarray) -> np.ndarray:
    """The similarity that a number of differing bits speaks for."""
    k = ROWS * BANDS
    samples = np.log1p(-np.minimum(2 * np.asarray(differing) / SKETCH_BITS, 0.999999)) / (2 * np.log1p(-2 / SKETCH_BITS))
    return np.clip(1 - samples / k, 0, 1)


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


@T.tidy
def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data_all, at_all = T.bytes_of(b.column(1))
        for lo, hi in T.slices(at_all):
            data, at = data_all[at_all[lo] : at_all[hi]], at_all[lo : hi + 1] - at_all[lo]
            row, h = shingles(data, at, width)
            have, mins, edge = signatures(row, h)
            n = hi - lo
            size, a, c = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            sketch: list[bytes | None] = [None] * n
            bands: list[np.ndarray | None] = [None] * n
            if len(have):
                size[have] = np.diff(np.append(edge, len(h)))
                a[have] = np.add.reduceat(T.mix(h ^ U64(1)), edge).view(np.int64)
                c[have] = np.add.reduceat(T.mix(h ^ U64(2)), edge).view(np.int64)
                odd = odd_sketch(mins)
                key = np.zeros((len(have), BANDS), U64)
                for k in range(ROWS):
                    key = T.mix(key * U64(0x9E3779B97F4A7C15) + mins[:, k::ROWS] + np.arange(BANDS, dtype=U64))
                key = key.view(np.int64)
                for i, r in enumerate(have.tolist()):
                    sketch[r], bands[r] = odd[i].tobytes(), key[i]
            yield pa.record_batch([b.column(0).slice(lo, n), pa.array(size), pa.array(a), pa.array(c), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], [x.split()[0] for x in SIGNED.split(", ")])


@T.tidy
def _sets(batches: Iterator[pa.RecordBatch], width: int, seen: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Shingles of the texts that may be asked for: those whose place in the filter, the first bits of their hash, is set."""
    for b in batches:
        at = b.column(2).to_numpy().view(U64) >> U64(64 - bits)
        b = b.filter(pa.array((seen[at >> U64(6)] >> (at & U64(63)) & U64(1)).astype(bool)))
        data_all, at_all = T.bytes_of(b.column(1))
        for lo, hi in T.slices(at_all):
            row, h = shingles(data_all[at_all[lo] : at_all[hi]], at_all[lo : hi + 1] - at_all[lo], width)
            edge = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array([h[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])], pa.binary())], ["id", "hashes"])


@T.tidy
def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            both = 0
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                z = np.concatenate([x, y])
                z.sort()
                both = int((z[1:] == z[:-1]).sum())
            good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        mask = pa.array(good, pa.bool_())
        yield pa.record_batch([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])


def _far(a, b):  # noqa: ANN001, ANN202
    """Differing bits of two sketch columns."""

    @F.arrow_udf("int")
    def count(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.int32())
        p, q = (np.frombuffer(b"".join(v.to_pylist()), U64).reshape(len(x), -1) for v in (x, y))
        return pa.array(np.bitwise_count(p ^ q).sum(1).astype(np.int32))

    return count(a, b)


@T.tidy
def _blocks(batches: Iterator[pa.RecordBatch], percent: int, far: int) -> Iterator[pa.RecordBatch]:
    """Within runs of (band, block pair): pairs of different components whose sizes and sketches allow a link."""
    for t in T.whole_runs(batches, ["key"], 5_000):
        key = t["key"].combine_chunks().to_numpy()
        cuts = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        ids, size, root, side = (t[c].combine_chunks().to_numpy() for c in ("id", "n", "root", "side"))
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), U64).reshape(len(key), -1)
        left, right = [], []
        for s, e in zip(cuts[:-1], cuts[1:]):
            for i in range(s, e):
                # side 2: a block against itself; 0 and 1: two blocks against each other
                other = np.arange(i + 1, e)
                if side[i] != 2:
                    other = other[side[other] != side[i]]
                other = other[root[other] != root[i]]
                small, large = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
                other = other[100 * small >= percent * large]
                if len(other):
                    other = other[np.bitwise_count(sketch[other] ^ sketch[i]).sum(1) <= far]
                    left.append(np.full(len(other), ids[i]))
                    right.append(ids[other])
        if left:
            yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def links(docs: DataFrame, percent: int = 70, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(documents with their class, components of classes): doc_id, n_shingles, rep; and node, root.

    A class is named by its smallest doc_id. Where a doc_id repeats with other texts, that
    may name several classes; they are one component anyway, so their links need not be told apart.
    """
    text = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(text.mapInArrow(lambda it: _sign(it, width), SIGNED), "signed")
    rows = max(1, signed.count())
    # classes of equal sets, by 128 bits and their size
    keyed = signed.withColumn("k", F.when(F.col("n_shingles") > 0, F.struct("set_a", "set_b", "n_shingles")))
    classes = keyed.filter("n_shingles > 0").groupBy("k").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    member = cut(hot_join(keyed.select("doc_id", "n_shingles", "k"), classes, "k", "copies", rows).select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "member")
    reps = keyed.join(classes.select(F.col("k").alias("ck"), "rep"), (F.col("k") == F.col("ck")) & (F.col("doc_id") == F.col("rep"))).dropDuplicates(["k"])
    reps = cut(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch", "bands"), "classes")

    banded = reps.select("id", F.posexplode("bands").alias("band", "hash")).select("id", "band", F.xxhash64("band", "hash").alias("bucket"))
    # in each bucket one member, by hash: another one in each band
    centre = banded.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "id").alias("p"), F.col("id"))).alias("c"), F.count("*").alias("n")).filter("n > 1")
    shared_ = cut(hot_join(banded, centre.select("bucket", F.col("c.id").alias("centre"), "n", F.col("n").alias("m")), "bucket", "n", rows * BANDS, "inner"), "buckets")

    far = most_differing(percent / 100)
    thin = reps.select("id", "n", "sketch")
    pairs = shared_.filter("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()

    def beside(p: DataFrame, table: DataFrame, total: int) -> DataFrame:
        """`p`, pairs (a, b), with the columns of `table` (id, x, ...) of both as a_x and b_x; a much paired member is met in parts."""
        pairs = p
        for side in ("a", "b"):
            met = table.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in table.columns if c != "id"])
            p = hot_join(p, met, side, "_n", total, "inner", pairs.groupBy(side).agg(F.count("*").alias("_n")))
        return p

    def near(p: DataFrame) -> DataFrame:
        p = cut(p, "met")
        p = beside(p, thin, p.count()).filter(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
        return p.withColumn("far", _far(F.col("a_sketch"), F.col("b_sketch"))).filter(F.col("far") <= far).select("a", "b", "far")

    def confirm(p: DataFrame) -> DataFrame:
        """Links among pairs, on the full sets of those classes that are in a pair."""
        p = cut(p.select("a", "b"), "asked")
        needed = cut(p.select(F.col("a").alias("id")).union(p.select(F.col("b").alias("id"))).distinct(), "needed")
        # a filter of bounded size lets the texts of all these documents pass and few others, which the join then
        # drops: only sets of those are shuffled, neither all texts nor all sets
        bits = min(FILTER_BITS, max(10, (16 * needed.count()).bit_length()))
        place = needed.select(F.shiftrightunsigned(F.xxhash64("id"), 64 - bits).alias("at"))
        words = place.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()  # 2**20 at most
        seen = np.zeros((1 << bits) // 64, np.int64)
        seen[words["word"].to_numpy()] = words["bits"].to_numpy()
        seen = seen.view(U64)
        sets = text.withColumn("h", F.xxhash64("doc_id")).mapInArrow(lambda it: _sets(it, width, seen, bits), "id long, hashes binary").filter("length(hashes) > 0")
        sets = cut(sets.join(needed.withColumnRenamed("id", "_id").hint("merge"), F.col("id") == F.col("_id")).select("id", "hashes").distinct(), "sets")
        both = beside(p, sets, p.count()).select("a", "b", "a_hashes", "b_hashes")
        out = cut(both.mapInArrow(lambda it: _confirm(it, percent), "a long, b long").distinct(), "links")
        drop(p, needed, sets)
        return out

    candidates = cut(near(pairs), "pairs")
    # first the likeliest partner of every class, then what is still apart
    best = candidates.groupBy("a").agg(F.min(F.struct("far", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    linked = confirm(best)
    tree = components(linked)

    def apart(p: DataFrame, tree: DataFrame) -> DataFrame:
        x, y = tree.toDF("a", "ra"), tree.toDF("b", "rb")
        p = p.join(x, "a", "left").join(y, "b", "left")
        return p.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    second = cut(apart(candidates.join(best, ["a", "b"], "left_anti"), tree), "apart")
    if not second.isEmpty():
        linked = linked.union(confirm(second))
        tree = components(linked)
    # buckets that still hold several components, whole
    inside = shared_.join(tree.toDF("id", "root"), "id", "left").select("bucket", "band", "id", "m", F.coalesce("root", "id").alias("root"))
    mixed = inside.filter("m > 2").groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    left = cut(hot_join(inside, mixed.select("bucket", "n"), "bucket", "n", rows * BANDS, "inner"), "mixed")
    # of a large bucket only those need meet that share another large one as well: a linked pair
    # shares many, and if one of them is small, it is found there
    few, many = left.filter(F.col("m") <= BLOCK), left.filter(F.col("m") > BLOCK)
    several = many.groupBy("id", "root").agg(F.sort_array(F.collect_list(F.struct("band", "bucket"))).alias("s"))  # BANDS at most
    several = several.select("id", "root", F.posexplode("s").alias("at", "x"), "s")
    several = several.select("id", "root", F.explode(F.expr("transform(slice(s, at + 2, size(s)), y -> xxhash64(x.bucket, y.bucket))")).alias("bucket"))
    size = several.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    refined = hot_join(several, size.select("bucket", "n", F.col("n").alias("m")), "bucket", "n", rows * BANDS * BANDS // 2, "inner")
    left = few.select("bucket", "id", "m", "root").union(refined.select("bucket", "id", "m", "root")).join(thin, "id")
    # m members are ceil(m / BLOCK) blocks; a member goes to each pair of blocks that has its own
    left = left.withColumn("blocks", F.expr(f"cast((m + {BLOCK - 1}) div {BLOCK} as int)")).withColumn("mine", F.expr("cast(pmod(xxhash64(id, bucket), blocks) as int)"))
    left = left.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    left = left.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"), "id", "n", "root", "sketch")
    third = left.repartition("key").sortWithinPartitions("key", "side", "id").mapInArrow(lambda it: _blocks(it, percent, far), "a long, b long")
    third = third.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    third = cut(third.join(tried, ["a", "b"], "left_anti"), "third")
    if not third.isEmpty():
        linked = linked.union(confirm(third))
    # from classes to documents: a member is tied to its class
    own = member.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return member, components(linked.union(own))


def report(docs: DataFrame, percent: int = 70, width: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    member, tree = links(docs, percent, width)
    out = member.join(tree, member["doc_id"] == tree["node"], "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    none = docs.filter("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    none = none.mapInArrow(lambda it: _sign(it, width), SIGNED).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(none)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT w.doc_id, CAST(count(g.g) AS BIGINT) AS n FROM w LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY w.doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 70 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, min(r.b) = n.doc_id AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
