"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors get one more dimension that makes all norms equal, so that the largest inner
product is the least Euclidean distance, and are rotated at random, so that any few
coordinates estimate the whole distance. k-means on a bounded sample gives the lists, about
sqrt(n), and, where the sample is too small for so many, k-means on what its centroids leave
over divides each list again; every vector is in one. A query probes its nearest lists, as many as reached
`recall` on the sample by brute force (checked on at most `tune` queries). Within a
list, distances grow column block by column block: after each, a candidate whose
partial distance, scaled up, exceeds the query's bound by the margin of a hypothesis
test is abandoned; the bound falls as more of the list is seen. Survivors are scored with their
original vectors in double precision.

Vectors of one length whose magnitudes lie within 2**-10 to 2**10 of the median are one group with lists
of its own, vectors beyond are groups of their own by magnitude, scaled by powers of two, so that a few
enormous or tiny ones neither overflow nor blur the lists of all others. A group of up to SINGLE
vectors is one list. A query is searched in all groups of its length.

Lists and the queries that probe them are cut in blocks, so a list that holds a third
of all vectors is many tasks, and no task sees more than BLOCK candidates and QUERIES
queries at a time.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part,
neither do null ids. Vectors of different lengths have no inner product, so each length is
searched by itself. A query is never its own candidate: a row with the query's vec_id isn't one, even
if it repeats. Other rows that repeat a vec_id are candidates each; queries that repeat one with other
components are answered each, with the same query_id. A score that overflows is infinite, and one that
is no number ranks last. Ties go to the smaller vec_id. With fewer candidates than `k`, all that there are
are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text as T
from ._spark import cut
from .itq import _matrix, valid

SAMPLE = 20_000
SINGLE = 2_000
BLOCK, QUERIES, COLUMNS = 16_384, 4_096, 16
AT_ONCE = 4_194_304  # distances in memory at a time
EPSILON = 2.1


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = size > 0
        c[full] = total[full] / size[full, None]
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    out, step = [], max(1, AT_ONCE // len(c))
    for s in range(0, len(x), step):
        d = (c * c).sum(1) - 2 * x[s : s + step] @ c.T
        if n == 1:
            out.append(d.argmin(1)[:, None])
        else:
            out.append(d.argsort(1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


class Lists:
    """The lists of one group of vectors: their common scale and norm, rotation, centroids and the number of lists to probe."""

    def __init__(self, first: int, shift: int, most: float, sample: np.ndarray | None, n: int, k: int, recall: float, tune: int, seed: int = 5) -> None:
        self.first, self.shift, self.most = first, shift, most * (1 + 1e-12)
        self.rotation = self.coarse = self.fine = None
        self.count = self.probes = 1
        if sample is None:
            return
        rng = np.random.default_rng(seed)
        x = self.grown(sample)
        self.coarse = kmeans(x, max(1, min(len(x) // 8, int(math.sqrt(n)))))
        parts = int(math.sqrt(n)) // len(self.coarse)
        if parts > 1:
            self.fine = kmeans(x - self.coarse[nearest(x, self.coarse, 1)[:, 0]], parts)
        self.count = len(self.centroids())
        self.probes = self._tune(x, sample, k, recall, tune, rng)

    def centroids(self) -> np.ndarray:
        if self.coarse is None:
            return np.zeros((1, 1))
        return self.coarse if self.fine is None else (self.coarse[:, None] + self.fine[None]).reshape(-1, self.coarse.shape[1])

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Rotated coordinates, in single precision."""
        if self.rotation is None:
            self.rotation, _ = np.linalg.qr(np.random.default_rng(6).standard_normal((x.shape[1], x.shape[1])))
        return (x @ self.rotation).astype(np.float32)

    def grown(self, v: np.ndarray) -> np.ndarray:
        """Candidates with one more coordinate, up to the common norm."""
        x = np.ldexp(v, -self.shift)
        rest = np.sqrt(np.maximum(self.most * self.most - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def asked(self, v: np.ndarray) -> np.ndarray:
        """Queries, brought to the common norm, as their length doesn't change what is nearest."""
        x = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])
        x *= self.most / np.sqrt((x * x).sum(1, keepdims=True))
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1)

    def _tune(self, x: np.ndarray, sample: np.ndarray, k: int, recall: float, tune: int, rng: np.random.Generator) -> int:
        ask = rng.choice(len(x), min(tune, len(x)), replace=False)
        q = self.asked(sample[ask])
        ip = q[:, :-1] @ x[:, :-1].T
        ip[np.arange(len(ask)), ask] = -np.inf
        m = min(k, len(x) - 1)
        if m < 1:
            return self.count
        true = np.argpartition(-ip, m - 1, axis=1)[:, :m]
        c = self.centroids()
        home = nearest(x, c, 1)[:, 0]
        needed = []
        for i in range(len(ask)):
            place = np.empty(self.count, np.int64)
            place[nearest(q[i : i + 1], c, self.count)[0]] = np.arange(self.count)
            needed.append(place[home[true[i]]])
        needed = np.sort(np.concatenate(needed))
        return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


Groups = dict[tuple[int, int], Lists]


def _by(*keys: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Each distinct combination of the keys and the rows that have it."""
    seen, which = np.unique(np.stack(keys), axis=1, return_inverse=True)
    for k in range(seen.shape[1]):
        yield tuple(int(x) for x in seen[:, k]), np.flatnonzero(which.reshape(-1) == k)


@T.tidy
def _assign(batches: Iterator[pa.RecordBatch], groups: Groups) -> Iterator[pa.RecordBatch]:
    centroids = {g: x.centroids() for g, x in groups.items()}
    for b in batches:
        if not b.num_rows:
            continue
        home = np.zeros(b.num_rows, np.int32)
        for g, rows in _by(b.column("d").to_numpy(), b.column("g").to_numpy()):
            x = groups[g]
            home[rows] = x.first
            if x.count > 1:
                home[rows] += nearest(x.grown(_matrix(b.column("v").take(pa.array(rows)))), centroids[g], 1)[:, 0].astype(np.int32)
        yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array(home)], ["vec_id", "v", "list"])


@T.tidy
def _probe(batches: Iterator[pa.RecordBatch], groups: Groups, size: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    centroids = {g: x.centroids() for g, x in groups.items()}
    for b in batches:
        if not b.num_rows:
            continue
        for (d,), rows in _by(b.column("d").to_numpy()):
            for g, x in groups.items():
                if g[0] != d:
                    continue
                held = size[x.first : x.first + x.count]
                step = max(1, AT_ONCE // x.count)
                for s in range(0, len(rows), step):
                    mine = b.take(pa.array(rows[s : s + step]))
                    if x.count == 1:
                        order = np.zeros((mine.num_rows, 1), np.int64)
                    else:
                        order = nearest(x.asked(_matrix(mine.column("v"))), centroids[g], x.count)
                    # more lists where the first ones hold too few candidates
                    enough = (np.cumsum(held[order], axis=1) < k + 1).sum(1) + 1
                    n = np.minimum(np.maximum(x.probes, enough), x.count)
                    row, at = T.ragged(n)
                    for c in range(0, len(row), 65_536):
                        r = pa.array(row[c : c + 65_536])
                        yield pa.record_batch([mine.column("vec_id").take(r), mine.column("v").take(r), pa.array((x.first + order[row[c : c + 65_536], at[c : c + 65_536]]).astype(np.int32))], ["vec_id", "v", "list"])


def scan(q: np.ndarray, c: np.ndarray, k: int, same: np.ndarray, bound: np.ndarray | None = None) -> list[np.ndarray]:
    """For each rotated query the candidates that survive: none of the k nearest is abandoned but by the test's error.

    `same` marks pairs that aren't candidates. `bound`: a distance of each query beyond which
    nothing is wanted (squared), infinite if not known.
    """
    n, d = c.shape
    if bound is None:
        bound = np.full(len(q), np.inf)
    if n > 2 * k:
        # the k-th least full distance among a first few candidates
        first = min(n, max(4 * k, 64))
        full = ((q * q).sum(1)[:, None] + (c[:first] * c[:first]).sum(1) - 2 * q @ c[:first].T).astype(np.float64)
        full[same[:, :first]] = np.inf
        bound = np.minimum(bound, np.partition(full, k - 1, axis=1)[:, k - 1])
    slack = 1e-6 * float((c * c).sum(1).max(initial=0)) * 4
    bound = bound * (1 + 1e-6) + slack
    if not np.isfinite(bound).any():
        return [np.flatnonzero(~s) for s in same]
    partial = np.zeros((len(q), n), q.dtype)
    alive = ~same
    for s in range(0, d, COLUMNS):
        e = min(d, s + COLUMNS)
        x, y = q[:, s:e], c[:, s:e]
        i, j = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(i):
            break
        if alive.sum() > 0.1 * len(i) * len(j):
            partial[np.ix_(i, j)] += (x[i] * x[i]).sum(1)[:, None] + (y[j] * y[j]).sum(1) - 2 * x[i] @ y[j].T
        else:
            a, b = np.nonzero(alive)
            diff = x[a] - y[b]
            partial[a, b] += (diff * diff).sum(1)
        margin = (1 + EPSILON / math.sqrt(e)) ** 2 if e < d else 1 + 1e-5
        alive &= partial * (d / e) <= (bound * margin)[:, None]
    return [np.flatnonzero(a) for a in alive]


def best_of(c: np.ndarray, ids: np.ndarray, q: np.ndarray, asks: np.ndarray, x: Lists, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (vectors q, ids asks) the ids and exact scores of the nearest candidates of one list."""
    cr, qr = x.turned(x.grown(c)), x.turned(x.asked(q))
    norm = x.most * x.most
    for a in range(0, len(q), 512):
        mine = q[a : a + 512]
        found = [(np.zeros(0, np.int64), np.zeros(0))] * len(mine)
        bound = np.full(len(mine), np.inf)
        # a query's inner products in the scale that distances are in
        scale = x.most / np.sqrt((np.ldexp(mine, -np.frexp(np.abs(mine).max(1, keepdims=True))[1]) ** 2).sum(1))
        down = -np.frexp(np.abs(mine).max(1))[1]
        for b in range(0, len(c), 4096):
            part, names = c[b : b + 4096], ids[b : b + 4096]
            for i, keep in enumerate(scan(qr[a : a + 512], cr[b : b + 4096], k, names[None, :] == asks[a : a + 512, None], bound)):
                if not len(keep):
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    exact = (part[keep] * mine[i]).sum(1)
                exact[np.isnan(exact)] = -np.inf
                who, score = np.concatenate([found[i][0], names[keep]]), np.concatenate([found[i][1], exact])
                order = np.lexsort((who, -score))[:k]
                found[i] = who[order], score[order]
                if len(order) == k and np.isfinite(score[order[-1]]):
                    least = math.ldexp(score[order[-1]] * scale[i] if abs(score[order[-1]]) < 1e300 else 0.0, int(down[i]) - x.shift) if abs(down[i] - x.shift) < 900 else -norm
                    bound[i] = max(2 * norm - 2 * least, 0)
        yield from found


@T.tidy
def _search(batches: Iterator[pa.RecordBatch], groups: Groups, k: int) -> Iterator[pa.RecordBatch]:
    lists = sorted(groups.values(), key=lambda x: x.first)
    firsts = np.array([x.first for x in lists])
    for t in T.whole_runs(batches, ["key"], BLOCK):
        key, side, ids, at = (t[c].combine_chunks().to_numpy() for c in ("key", "side", "vec_id", "list"))
        v = t["v"].combine_chunks()
        cuts = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        who, version, other, score = [], [], [], []
        for s, e in zip(cuts[:-1], cuts[1:]):
            m = s + int((side[s:e] == 0).sum())  # candidates come first
            if m == s or m == e:
                continue
            x = lists[int(np.searchsorted(firsts, at[s], "right")) - 1]
            mark = t["mark"].combine_chunks().slice(m, e - m).to_numpy()
            for i, (names, exact) in enumerate(best_of(_matrix(v.slice(s, m - s)), ids[s:m], _matrix(v.slice(m, e - m)), ids[m:e], x, k)):
                who.append(np.full(len(names), ids[m + i]))
                version.append(np.full(len(names), mark[i]))
                other.append(names)
                score.append(exact)
        if who:
            yield pa.record_batch([pa.array(np.concatenate(z)) for z in (who, version, other, score)], ["query_id", "mark", "vec_id", "score"])


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95, sample: int = SAMPLE, tune: int = 200) -> DataFrame:
    """For every row that `queries` (a condition on `vec_id`) picks, its k nearest others: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    slim = slim.filter(valid(F.col("v")) & F.col("vec_id").isNotNull())
    size_of = F.floor(F.log2(F.array_max(F.transform("v", F.abs)))).cast("int")  # binary magnitude
    slim = cut(slim.select("vec_id", "v", F.size("v").alias("d"), F.greatest(size_of, F.lit(-1000)).alias("e")), "vectors")
    middle = slim.groupBy("d").agg(F.percentile_approx("e", 0.5).alias("m"))  # one row a length
    slim = slim.join(F.broadcast(middle), "d").withColumn("g", F.round((F.col("e") - F.col("m")) / 20).cast("int")).withColumn("shift", F.col("m") + 20 * F.col("g"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x * F.pow(F.lit(2.0), -F.col("shift"))) * (x * F.pow(F.lit(2.0), -F.col("shift")))))
    groups: Groups = {}
    first = 0
    # a row for each length and magnitude
    for r in slim.groupBy("d", "g", "shift").agg(F.count("*").alias("n"), F.max(norm).alias("most")).orderBy("d", "g").collect():
        some = None
        if r["n"] > SINGLE:
            rows = slim.filter((F.col("d") == r["d"]) & (F.col("g") == r["g"])).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)  # at most `sample` rows
            some = np.array(rows.select("v").toPandas()["v"].tolist())
        groups[r["d"], r["g"]] = Lists(first, r["shift"], r["most"], some, r["n"], k, recall, tune)
        first += groups[r["d"], r["g"]].count
    vectors_in = cut(slim.select("vec_id", "v", "d", "g").mapInArrow(lambda it: _assign(it, groups), "vec_id long, v array<double>, list int"), "lists")
    held = {r["list"]: r["n"] for r in vectors_in.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list, sqrt(n) a group
    size = np.array([held.get(i, 0) for i in range(first)], np.int64)
    asked = slim.filter(queries).select("vec_id", "v", "d").dropDuplicates(["vec_id", "v"]).mapInArrow(lambda it: _probe(it, groups, size, k), "vec_id long, v array<double>, list int")
    asked = cut(asked, "probes")
    wanted = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame([(i, max(1, -(-int(size[i]) // BLOCK)), max(1, -(-wanted.get(i, 0) // QUERIES))) for i in range(first)], "list int, cb int, qb int")
    blocks = F.broadcast(table)  # as many rows as lists
    c = vectors_in.join(blocks, "list").withColumn("c", F.expr("cast(pmod(xxhash64(vec_id), cb) as int)")).withColumn("q", F.explode(F.expr("sequence(0, qb - 1)"))).withColumn("side", F.lit(0))
    q = asked.join(blocks, "list").withColumn("q", F.expr("cast(pmod(xxhash64(vec_id), qb) as int)")).withColumn("c", F.explode(F.expr("sequence(0, cb - 1)"))).withColumn("side", F.lit(1))
    cols = ["list", "c", "q", "side", "vec_id", "v"]
    both = c.select(*cols, F.lit(0).cast("long").alias("mark")).union(q.select(*cols, F.xxhash64("v").alias("mark"))).withColumn("key", F.xxhash64("list", "c", "q"))
    met = both.select("key", "side", "vec_id", "v", "list", "mark").repartition("key").sortWithinPartitions("key", "side", "vec_id").mapInArrow(lambda it: _search(it, groups, k), "query_id long, mark long, vec_id long, score double")
    best = W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
