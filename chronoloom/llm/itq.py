"""Embedding near-dedup by iterative quantisation (ITQ).

1. Equal vectors are one class. On a bounded sample, principal directions and then a
   rotation are learnt that bring the sample close to the corners of a hypercube, so
   that bits are balanced; CODES independently initialised rotations give one code of
   CODES * d bits.
2. A multi-index finds candidates: vectors that agree in all symbols that a table reads
   share a bucket of it. A symbol is the strongest of up to STRONG coordinates, with its sign,
   after a random rotation, which a pair at the threshold shares more often than as many
   bits of a code; vectors of fewer than SHORT components use the bits of the code. The
   symbols a table grow with the logarithm of the number of vectors and the tables with them,
   so that a pair at the threshold is missed with a probability of about `miss`.
3. Buckets are compared by Hamming distance of the codes, block against block
   where a bucket is too large for one task; members with a near partner go on. A pair belongs to
   the first table in which it meets and is looked at there alone. Tables are worked off in
   rounds, so that what lies on disk at once stays in proportion to the vectors.
4. Those members are reranked with their original vectors, in double precision:
   degrees are counted where blocks meet, and for components each block gives a spanning forest,
   not its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are returned with no links and their own id. Vectors of
different lengths never link; a length of up to FEW vectors needs no codes. Rows that repeat a vec_id share its component; each
counts as another vector. A null vec_id can be in no component: it is returned with a
null component, kept, and no links.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import HOT, HOT_ROWS, components, cut, drop, hot_join

SAMPLE = 10_000
CODES = 4
SYMBOLS = 96
STRONG = 64  # coordinates a symbol is chosen from, at most: it fits a byte
SHORT = 16
CROWD = 32  # vectors that may share a bucket by chance
ROUND_BYTES = 1 << 30  # of bucket entries that a round of tables may always shuffle, and 1.5 times the vectors' bytes
FEW = 64  # vectors of one length that are compared without codes
RERANKED = "cid long, degree long, root long"
SLACK = 5.0
U64 = T.U64


def valid(vec):  # noqa: ANN001, ANN201
    """Whether a vector column can link: finite, whole and not zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; each is first scaled by a power of two, so that neither large nor small ones overflow."""
    x = np.ldexp(v.astype(np.float64), -np.frexp(np.abs(v).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(sample: np.ndarray, codes: int = CODES, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Projections (d, codes * d): the principal directions, rotated by ITQ from several random starts."""
    x = unit(sample)
    d = x.shape[1]
    _, vectors = np.linalg.eigh(x.T @ x)
    v = x @ vectors
    rng, out = np.random.default_rng(seed), []
    for _ in range(codes):
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(vectors @ r)
    return np.concatenate(out, axis=1)


def rotations(d: int, seed: int = 13) -> np.ndarray:
    """SYMBOLS random sets of orthonormal directions: (SYMBOLS, d, min(d, STRONG))."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((d, min(d, STRONG))))[0] for _ in range(SYMBOLS)]).astype(np.float32)


def strongest(x: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """A byte a rotation: which coordinate is the largest in size, and its sign."""
    out = np.empty((len(x), len(turns)), np.uint8)
    x, rows = x.astype(np.float32), np.arange(len(x))
    for k, r in enumerate(turns):
        y = x @ r
        at = np.abs(y).argmax(1)
        out[:, k] = 2 * at + (y[rows, at] > 0)
    return out


def symbol_differs(d: int, threshold: float, samples: int = 50_000, seed: int = 17) -> float:
    """How often a symbol of two vectors of this cosine differs, as sampled with independent coordinates."""
    m, rng = min(d, STRONG), np.random.default_rng(seed)
    x = rng.standard_normal((samples, m))
    y = threshold * x + math.sqrt(1 - threshold * threshold) * rng.standard_normal((samples, m))
    one = np.eye(m)[None]
    return float((strongest(x, one) != strongest(y, one)).mean())


def plan(n: int, bits: int, threshold: float, miss: float = 1e-4, differs: float | None = None, width: int | None = None) -> tuple[int, int]:
    """(bits of a substring, tables) for n vectors: pairs at the threshold are missed with probability `miss`, averaged over their Hamming distance as of independent bits.

    `differs`: how often a bit (or another symbol) of such a pair differs, if not as a sign does; `width`: the longest substring, if not by n.
    """
    p = math.acos(threshold) / math.pi if differs is None else differs
    log = np.array([math.lgamma(k + 1) for k in range(bits + 1)])  # of factorials
    h = np.arange(bits + 1)  # Hamming distance of a pair at the threshold
    chance = np.exp(log[bits] - log - log[::-1] + h * math.log(p) + (bits - h) * math.log(1 - p))
    width = min(bits, max(6, min(32, math.ceil(math.log2(max(2, n))) - 1)) if width is None else width)
    while width > 1 and chance[bits - width + 1 :].sum() > miss / 2:  # short codes: too often no substring agrees
        width -= 1
    never = chance[bits - width + 1 :].sum()
    few = h[: bits - width + 1]
    differs = -np.expm1(log[bits - few] - log[bits - few - width] - log[bits] + log[bits - width])
    missed = lambda tables: float((chance[few] * differs**tables).sum())
    low, high = 0, 1
    while missed(high) > max(miss - never, miss / 2):
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if missed(mid) > max(miss - never, miss / 2) else (low, mid)
    return width, high


def substrings(bits: int, width: int, tables: int, seed: int = 11) -> np.ndarray:
    """Which bits of the code each table reads: disjoint while they last, then shuffled anew."""
    rng = np.random.default_rng(seed)
    per = max(1, bits // width)
    rows = []
    while len(rows) < tables:
        p = rng.permutation(bits)
        rows += [p[k * width : (k + 1) * width] if bits >= width else p for k in range(per)]
    return np.stack(rows[:tables])


def index(n: int, d: int, bits: int, threshold: float, miss: float = 1e-4) -> tuple[np.ndarray | None, np.ndarray]:
    """(rotations, or None where bits are the symbols; which symbols each table reads) for n vectors of d components."""
    if d < SHORT:
        return None, substrings(bits, *plan(n, bits, threshold, miss))
    width = next(k for k in range(1, 7) if k == 6 or n <= CROWD * (2 * min(d, STRONG)) ** k)
    return rotations(d), substrings(SYMBOLS, *plan(n, SYMBOLS, threshold, miss, symbol_differs(d, threshold), width))


def most_differing(bits: int, threshold: float) -> int:
    """Hamming distance that a pair at the threshold keeps below, but for SLACK standard deviations (of independent codes of d bits)."""
    p = math.acos(threshold) / math.pi
    return math.ceil(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def keys(symbols: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(tables, rows): the symbols that a table reads as one number; bits of 0 and 1 take one bit each."""
    shift = U64(1 if tables.shape[1] > 6 else 8)
    out = np.zeros((len(tables), len(symbols)), U64)
    for k, t in enumerate(tables):
        for c in t:
            out[k] = (out[k] << shift) | symbols[:, c]
    return out


@T.tidy
def _encode(batches: Iterator[pa.RecordBatch], projection: np.ndarray, turns: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Class and code: the bits of the ITQ code, then the symbols that tables read, a byte each."""
    for b in batches:
        for lo in range(0, b.num_rows, 10_000):
            part = b.slice(lo, 10_000)
            x = unit(_matrix(part.column(1)))
            bits = x @ projection >= 0
            code = np.concatenate([np.packbits(bits, axis=1), bits if turns is None else strongest(x, turns)], axis=1).astype(np.uint8)
            yield pa.record_batch([part.column(0), pa.array([c.tobytes() for c in code], pa.binary())], ["cid", "code"])


def _coded(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ITQ codes as 64-bit words, and the symbols, of a column of codes."""
    code = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    size = -(-bits // 8)
    wide = np.zeros((len(code), -(-size // 8) * 8), np.uint8)
    wide[:, :size] = code[:, :size]
    return wide.view(U64), code[:, size:]


@T.tidy
def _entries(batches: Iterator[pa.RecordBatch], bits: int, tables: np.ndarray, number: list[int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            k = keys(_coded(b.column(1), bits)[1], tables[number])
            bucket = T.mix(T.mix(k) + np.array(number, U64)[:, None])  # a hash may only add members that are told apart later
            yield pa.record_batch([b.column(0), b.column(1), pa.array(list(np.ascontiguousarray(bucket.T).view(np.int64)), pa.list_(pa.int64()))], ["cid", "code", "buckets"])


def _met(symbols: np.ndarray, table: np.ndarray, tables: np.ndarray):  # noqa: ANN202
    """Which pairs (i, j) of rows are of one table, agree there and in no table before."""
    of = functools.cache(lambda k: keys(symbols, tables[k : k + 1])[0])

    def first(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for t in np.unique(table[i]).tolist():
            live = np.flatnonzero((table[i] == t) & (table[j] == t))
            live = live[of(t)[i[live]] == of(t)[j[live]]]
            for k in range(t):
                if not len(live):
                    break
                live = live[of(k)[i[live]] != of(k)[j[live]]]
            out.append(live)
        return np.concatenate(out)

    return first


def _pairs(start: np.ndarray, size: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) within runs, about `most` or a row's at a time."""
    row, place = T.ragged(size)
    last = np.repeat(start + size, size)
    here = np.repeat(start, size) + place
    count = last - here - 1
    here, count = here[count > 0], count[count > 0]
    ends = np.cumsum(count)
    lo = 0
    while lo < len(here):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        r, k = T.ragged(count[lo:hi])
        i = here[lo:hi][r]
        yield i, i + 1 + k
        lo = hi


@T.tidy
def _codes(batches: Iterator[pa.RecordBatch], bits: int, tables: np.ndarray, far: int) -> Iterator[pa.RecordBatch]:
    """Members of a bucket's block pair that have a partner within the Hamming distance whose first table this is."""
    for t in T.whole_runs(batches, ["key"], 20_000):
        key, table, side = (t[c].combine_chunks().to_numpy() for c in ("key", "t", "side"))
        code, symbols = _coded(t["code"].combine_chunks(), bits)
        first = _met(symbols, table, tables)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        go = np.zeros(len(key), bool)
        for i, j in _pairs(cuts[:-1], np.diff(cuts)):
            near = np.bitwise_count(code[i, 0] ^ code[j, 0]).astype(np.int32)
            for w in range(1, code.shape[1]):
                near += np.bitwise_count(code[i, w] ^ code[j, w])
            near = (near <= far) & ((side[i] == 2) | (side[i] != side[j]))
            i, j = i[near], j[near]
            mine = first(i, j)
            go[i[mine]] = go[j[mine]] = True
        if go.any():
            yield pa.record_batch([t[c].combine_chunks().filter(pa.array(go)) for c in ("key", "t", "side", "cid", "code")], ["key", "t", "side", "cid", "code"])


@T.tidy
def _rerank(batches: Iterator[pa.RecordBatch], bits: int, tables: np.ndarray | None, threshold: float) -> Iterator[pa.RecordBatch]:
    """Within a bucket's block pair: each member's number of linked vectors, and its root in the block's forest."""
    for t in T.whole_runs(batches, ["key"], 2_000):
        key, table, side, cid, copies = (t[c].combine_chunks().to_numpy() for c in ("key", "t", "side", "cid", "copies"))
        vectors = t["v"].combine_chunks()
        first = None if tables is None else _met(_coded(t["code"].combine_chunks(), bits)[1], table, tables)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        degree = np.zeros(len(key), np.int64)
        root = np.arange(len(key))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for s, e in zip(cuts[:-1], cuts[1:]):
            v = unit(_matrix(vectors.slice(s, e - s)))  # a run's vectors have one length
            for lo in range(s, e, 512):
                hi = min(e, lo + 512)
                link = np.triu(v[lo - s : hi - s] @ v[lo - s :].T >= threshold, 1)
                link &= (side[lo:hi, None] == 2) | (side[lo:hi, None] != side[None, lo:e])
                i, j = np.nonzero(link)
                i, j = i + lo, j + lo
                if first is not None and len(i):
                    mine = first(i, j)
                    i, j = i[mine], j[mine]
                np.add.at(degree, i, copies[j])
                np.add.at(degree, j, copies[i])
                for x, y in zip(i.tolist(), j.tolist()):
                    x, y = top(x), top(y)
                    if x != y:
                        root[max(x, y)] = min(x, y)
        some = np.flatnonzero(degree > 0)
        if len(some):
            yield pa.record_batch([pa.array(cid[some]), pa.array(degree[some]), pa.array(cid[[top(i) for i in some.tolist()]])], ["cid", "degree", "root"])


def links(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, miss: float = 1e-4) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    kept_type = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kept_type).alias("v"))
    whole = whole.withColumn("ok", valid(F.col("v")) & F.col("vec_id").isNotNull())
    whole = whole.withColumn("k", F.when(F.col("ok"), F.struct(F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(3), "v").alias("k2"), F.size("v").alias("d"))))
    slim = cut(whole.select("vec_id", "ok", "k"), "vectors")
    rows = slim.count()
    # equal vectors (by 128 bits) are one class, whose number is fixed by writing it
    classes = whole.filter("ok").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("d", F.col("k.d")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    counted = classes.groupBy("d").count()  # one row a length
    sizes = [r["d"] for r in counted.filter(F.col("count") > FEW).collect()]
    # lengths with few vectors: all of one against each other
    here = classes.join(F.broadcast(counted.filter(F.col("count").between(2, FEW)).select("d")), "d")
    few = here.select(F.xxhash64("d").alias("key"), F.lit(0).alias("t"), F.lit(2).alias("side"), "cid", F.lit(b"\0").alias("code"), "v", "copies")
    done = few.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(lambda it: _rerank(it, 0, None, threshold), RERANKED)
    parts = [cut(done, "reranked")]
    for d in sizes:
        here = classes.filter(F.col("d") == d)
        n = here.count()
        taken = here.orderBy("k").limit(sample).select("v").toPandas()["v"]  # at most `sample` rows
        projection = learn(np.array(taken.tolist()))
        bits = projection.shape[1]
        turns, tables = index(n, d, bits, threshold, miss)
        count, far = len(tables), most_differing(bits, threshold)
        coded = cut(here.select("cid", "v").mapInArrow(lambda it, p=projection, t=turns: _encode(it, p, t), "cid long, code binary"), "codes")
        entry_bytes = 40 + bits // 8 + (SYMBOLS if turns is not None else bits)
        each = max(1, int(max(ROUND_BYTES, 1.5 * 4 * d * n) / (entry_bytes * max(1, n))))  # tables a round
        # a bucket that is too large for one task is cut in blocks, and its members go to each pair of blocks that has their own;
        # how many blocks is told from a sample of the vectors, which decides about nothing else
        large = max(HOT_ROWS, int(n * count * HOT))
        one_in = max(1, large // 600)
        for lo in range(0, count, each):
            number = list(range(lo, min(count, lo + each)))
            read = lambda it, b=bits, t=tables, m=number: _entries(it, b, t, m)
            if n > large:
                some = coded.filter(F.pmod(F.xxhash64("cid"), F.lit(one_in)) == 0).mapInArrow(read, "cid long, code binary, buckets array<long>")
                some = some.select(F.explode("buckets").alias("_b")).groupBy("_b").agg((F.count("*") * one_in).alias("m")).filter(F.col("m") > large)
                some = F.broadcast(some.select("_b", F.ceil(F.col("m") / (large // 4)).cast("int").alias("blocks")))  # 1/HOT at most
            entry = coded.mapInArrow(read, "cid long, code binary, buckets array<long>").select("cid", "code", F.posexplode("buckets").alias("t", "bucket")).withColumn("t", F.col("t") + lo)
            if n > large:
                entry = entry.join(some, entry["bucket"] == some["_b"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
                entry = entry.withColumn("mine", F.expr("cast(pmod(xxhash64(cid, bucket), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
                entry = entry.select(F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))).alias("key"), "t", F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"), "cid", "code")
            else:
                entry = entry.select(F.col("bucket").alias("key"), "t", F.lit(2).alias("side"), "cid", "code")
            near = entry.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it, b=bits, t=tables, f=far: _codes(it, b, t, f), "key long, t int, side int, cid long, code binary")
            near = cut(near, "near")
            met = near.join(here.select("cid", "v", "copies"), "cid")
            done = met.repartition("key").sortWithinPartitions("key", "side", "cid").mapInArrow(lambda it, b=bits, t=tables: _rerank(it, b, t, threshold), RERANKED)
            parts.append(cut(done, "reranked"))
            drop(near)
        drop(coded)
    reranked = functools.reduce(DataFrame.union, parts)
    degrees = reranked.groupBy("cid").agg(F.sum("degree").alias("degree"))
    out = hot_join(slim.select("vec_id", "k"), classes.select("k", "cid", "rep", "copies", F.col("copies").alias("n")), "k", "n", rows)
    found = degrees.join(classes.select("cid", F.col("copies").alias("n")), "cid")
    out = hot_join(out, found, "cid", "n", rows)
    named = classes.select("cid", "rep")
    trees = reranked.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b"))
    edges = trees.join(named.toDF("a", "pa"), "a").join(named.toDF("b", "pb"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    edges = edges.union(out.filter("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    tree = components(edges)
    out = out.join(tree, out["vec_id"] == tree["node"], "left")
    out = out.select("vec_id", (F.coalesce("degree", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), n AS (SELECT a, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, min(r.b) AS component_id, min(r.b) = vec_id AS kept
FROM v JOIN r ON r.a = vec_id LEFT JOIN n ON n.a = vec_id GROUP BY vec_id, n.n
"""
