"""Language model scoring with a hidden Markov model over words.

Words are lower-cased runs of visible bytes; a text is its words and an end token. Every
word of the training texts has emissions of its own. A state s emits a word with
N/(N + V + 1) * c * (r_s + A/N) / (G_s + A), where c is the word's count, r_s the share of its
occurrences that the state is expected to have made, G_s the sum of c * r_s over all words, and A (SMOOTH) draws
states towards the unigram model; words never seen are one event of (V + 1)/(N + V + 1).
(N: tokens to learn from, V: distinct words among them.)

The vocabulary is never broadcast and no word is left out for being rare:

1. One pass cuts the corpus in chunks of CHUNK_BYTES. A chunk is one packed row of its texts, as
   numbers of its own dictionary, and packed rows of that dictionary by hash bucket; there is a
   bucket for every BUCKET_BYTES of text. A bucket's task sums the words of all chunks and answers
   each chunk with its words' totals and shares r. Neither tokens nor single words are rows.
2. Baum-Welch: in each round the chunks are met by the shares of their words, run forward and backward
   over whole texts, and send the expected counts of their words to the buckets, which
   sum them into new shares. Starts, transitions and G are summed across tasks to a few numbers. Rounds go on until
   one raises the likelihood of the training texts by less than TOLERANCE of itself.
3. Scoring runs the scaled forward recursion over each whole text: its likelihood is
   exact, whatever its length.

The tables that meet, chunks and dictionaries, are written in as many parts as they are shuffled in (bucketed by
chunk or bucket), so only the words' shares and counts move in a round: at most SHARE and COUNT bytes
for each word of a chunk and state.

Defined results: a null or empty text is its end token alone. Rows with a null doc_id
are scored and learnt from (their remainder isn't 2). With nothing to learn from, every token
has probability one. Rows that repeat are texts each.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import cut, drop, shared

U64 = T.U64
STATES, SMOOTH, TOLERANCE = 6, 100.0, 1e-3
CHUNK_BYTES, BUCKET_BYTES = 16 << 20, 64 << 20
TOKENS_AT_ONCE = 400_000
SCALE_EVERY = 4  # steps; each takes a sum down by 1e-7 or so at worst, and single precision ends at 1e-38
SHARE, COUNT = 2, 3  # bytes of a share and of an expected count
END = np.array([-7_046_029_254_386_353_131], np.int64).view(U64)  # the end token's hash

PACKED = "kind int, chunk long, bucket int, a binary, b binary, ids array<long>"
_PACKED = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("ids", pa.list_(pa.int64()))])
TEXTS, WORDS = 0, 1
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(x: np.ndarray, drop_bytes: int = 0) -> bytes:
    """Numbers in few bytes: all first bytes, then all second ones and so on (but the lowest `drop_bytes`), compressed."""
    import zstandard

    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T[drop_bytes:].tobytes())


def unsqueeze(raw: bytes, kind: type, drop_bytes: int = 0) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    n = len(flat) // (size - drop_bytes)
    planes = np.zeros((size, n), np.uint8)
    planes[drop_bytes:] = flat.reshape(size - drop_bytes, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze_counts(x: np.ndarray) -> bytes:
    """Expected counts to 16 bits of precision."""
    bits = np.ascontiguousarray(x, np.float32).ravel().view(np.uint32)
    return squeeze((bits.astype(np.uint64) + 128).clip(max=(1 << 32) - 1).astype(np.uint32), 4 - COUNT)


def unsqueeze_counts(raw: bytes) -> np.ndarray:
    return unsqueeze(raw, np.uint32, 4 - COUNT).view(np.float32).reshape(-1, STATES).astype(np.float64)


def squeeze_shares(r: np.ndarray) -> bytes:
    return squeeze(np.rint(r * 65_535).astype(np.uint16).ravel())


def unsqueeze_shares(raw: bytes) -> np.ndarray:
    return unsqueeze(raw, np.uint16).reshape(-1, STATES) / 65_535.0


def first_shares(h: np.ndarray) -> np.ndarray:
    """Shares of words before anything is learnt, drawn by their hashes: each state prefers other words."""
    draw = np.stack([-np.log(((T.mix(h ^ U64(s * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1)) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) for s in range(STATES)], axis=1)
    return 0.5 / STATES + 0.5 * draw / draw.sum(1, keepdims=True)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    blank = dict.fromkeys(_PACKED.names)
    return pa.RecordBatch.from_pylist([blank | r for r in rows], schema=_PACKED)


@partial(T.tidy, lean=False)
def _pack(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A TEXTS row a chunk (a: numbers of tokens, held out; b: words) and a WORDS row a bucket (a: hashes, b: counts to learn from, numbers in the chunk)."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32

    def pack(ids: list[int | None], held: np.ndarray, hashes: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, count = np.concatenate(hashes), np.concatenate(counts)
        hashes.clear()
        value, which, n = np.unique(h, return_inverse=True, return_counts=True)
        learnt = np.bincount(which[~np.repeat(held, count)], minlength=len(value)).astype(np.uint32)
        # by bucket, and within one by falling frequency; numbers are small for frequent words
        bucket = (value >> U64(24)) % U64(buckets)
        order = np.lexsort((-n, bucket))
        rank = np.empty(len(n), np.uint32)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(n), dtype=np.uint32)
        yield _rows([{"kind": TEXTS, "chunk": number, "bucket": -1, "a": squeeze(np.concatenate([count.astype(np.uint32), held.astype(np.uint32)])), "b": squeeze(rank[which]), "ids": ids}])
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U64))
        rows = []
        for k in np.flatnonzero(np.diff(edge)).tolist():
            o = order[edge[k] : edge[k + 1]]
            rows.append({"kind": WORDS, "chunk": number, "bucket": k, "a": value[o].tobytes(), "b": squeeze(np.concatenate([learnt[o], rank[o]]))})
        for s in range(0, len(rows), 64):
            yield _rows(rows[s : s + 64])

    ids, held, hashes, counts, size = [], [], [], [], 0
    for b in batches:
        data_all, at_all = T.bytes_of(b.column(2))
        names, out = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in T.slices(at_all):
            data, at = T.LOWER[data_all[at_all[lo] : at_all[hi]]], at_all[lo : hi + 1] - at_all[lo]
            start, end, row = T.words(data, at)
            n = np.bincount(row, minlength=hi - lo)
            hashes.append(np.insert(T.hashes(data, start, end), np.cumsum(n), END[0]))  # the end token after each text
            counts.append(n + 1)
            ids += names[lo:hi]
            held.append(out[lo:hi])
            size += len(data) + 8 * (hi - lo)
            if size >= CHUNK_BYTES:
                yield from pack(ids, np.concatenate(held), hashes, counts)
                number += 1
                ids, held, hashes, counts, size = [], [], [], [], 0
    if ids:
        yield from pack(ids, np.concatenate(held), hashes, counts)


MEMBERS = "bucket int, chunk long, which binary, total binary, rank binary, n long, v long"


@partial(T.tidy, lean=False)
def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket and chunk: the number in the bucket's vocabulary of each of the chunk's words, their totals and numbers in the chunk; with a bucket's first chunk its N and V."""
    for t in T.whole_runs(batches, ["bucket"]):
        bucket = t["bucket"].combine_chunks().to_numpy()
        cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
        for s, e in zip(cuts[:-1], cuts[1:]):
            x = t.slice(s, e - s)
            h = [np.frombuffer(v, U64) for v in x["a"].to_pylist()]
            more = [unsqueeze(v, np.uint32).reshape(2, -1) for v in x["b"].to_pylist()]
            value, which = np.unique(np.concatenate(h), return_inverse=True)
            total = np.bincount(which, np.concatenate([m[0] for m in more]).astype(np.float64), len(value)).astype(np.int64)
            at = 0
            for k, (chunk, m) in enumerate(zip(x["chunk"].to_pylist(), more)):
                w = which[at : at + m.shape[1]]
                at += m.shape[1]
                # the words' hashes give the shares of the first round
                row = [int(bucket[s]), chunk, squeeze(w.astype(np.uint32)), squeeze(total[w]), squeeze(m[1]), int(total.sum()) if k == 0 else 0, int((total > 0).sum()) if k == 0 else 0, squeeze_shares(first_shares(value[w]))]
                yield pa.record_batch([pa.array([c]) for c in row[:2]] + [pa.array([c], pa.binary()) for c in row[2:5]] + [pa.array([c], pa.int64()) for c in row[5:7]] + [pa.array([row[7]], pa.binary())], ["bucket", "chunk", "which", "total", "rank", "n", "v", "shares"]).cast(_MEMBERS)


_MEMBERS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("which", pa.binary()), ("total", pa.binary()), ("rank", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("shares", pa.binary())])


class Chain:
    """What is the same for all words: start and transition probabilities, G, N and V."""

    def __init__(self, n: int, v: int) -> None:
        self.n, self.v = n, v
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.02 / (STATES - 1))
        np.fill_diagonal(self.move, 0.98)
        self.mass = np.full(STATES, n / STATES)

    def emissions(self, total: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Of words with these totals and shares, a row a word."""
        n, v = self.n, self.v
        known = n / (n + v + 1) * total[:, None] * (r + SMOOTH / max(n, 1)) / (self.mass + SMOOTH)
        return np.where(total[:, None] > 0, known, (v + 1) / (n + v + 1))

    def update(self, start: np.ndarray, move: np.ndarray, mass: np.ndarray) -> None:
        self.start = (start + 1) / (start + 1).sum()
        self.move = (move + 1) / (move + 1).sum(1, keepdims=True)
        self.mass = mass


def _columns(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences in order of length, longest first: (their order, where each begins, how many are that long at each step)."""
    order = np.argsort(-count, kind="stable")
    begin = (np.cumsum(count) - count)[order]
    longest = int(count.max()) if len(count) else 0
    active = len(count) - np.searchsorted(np.sort(count), np.arange(longest), "right")
    return order, begin, active


def forward(seq: np.ndarray, count: np.ndarray, chain: Chain, emit: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence, by the scaled recursion, all sequences a step at a time."""
    order, begin, active = _columns(count)
    total = np.zeros(len(count))
    a = None
    table, back, first = np.ascontiguousarray(emit.T), np.ascontiguousarray(chain.move.T), chain.start[:, None]
    for t, k in enumerate(active.tolist()):
        e = table[:, seq[begin[:k] + t]]
        a = e * first if t == 0 else (back @ a[:, :k]) * e
        scale = a.sum(0)
        a /= scale
        total[:k] += np.log10(scale)
    out = np.empty(len(count))
    out[order] = total
    return out


def expected(seq: np.ndarray, count: np.ndarray, chain: Chain, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of whole sequences, and their log10 likelihood.

    A row a state and a column a token, by step: all sequences of a batch go a step at a time. Emissions are
    relative to a word's largest one, so sums need scaling only every SCALE_EVERY steps.
    """
    top = emit.max(1)
    start, move, counts = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(emit), STATES))
    likelihood = float(np.bincount(seq, minlength=len(emit)) @ np.log10(top))
    table, there = np.ascontiguousarray((emit / top[:, None]).T, np.float32), chain.move.astype(np.float32)
    back, first = np.ascontiguousarray(there.T), chain.start.astype(np.float32)[:, None]
    count = count[count > 0]
    begins = np.cumsum(count) - count
    by_length = np.argsort(-count, kind="stable")
    # sequences of like lengths together, so many tokens at a time
    part = (np.cumsum(count[by_length]) - 1) // TOKENS_AT_ONCE
    for mine in np.split(by_length, np.flatnonzero(np.diff(part)) + 1) if len(count) else []:
        begin, sizes = begins[mine], count[mine]
        active = len(mine) - np.searchsorted(np.sort(sizes), np.arange(int(sizes[0])), "right")
        step, k = T.ragged(active)
        spots = seq[begin[k] + step].astype(np.intp)
        active, edge = active.tolist(), np.concatenate([[0], np.cumsum(active)])
        last = edge[sizes - 1] + np.arange(len(mine))
        edge = edge.tolist()
        e = np.take(table, spots, 1)
        alpha, scales, a = np.empty_like(e), {}, None
        for t, k in enumerate(active):
            x, here = alpha[:, edge[t] : edge[t + 1]], e[:, edge[t] : edge[t + 1]]
            if t:
                np.matmul(back, a[:, :k], out=x)
                x *= here
            else:
                np.multiply(first, here, out=x)
            if t % SCALE_EVERY == SCALE_EVERY - 1:
                scales[t] = x.sum(0)
                x /= scales[t]
            a = x
        rest = alpha[:, last].sum(0)
        likelihood += float(np.log10(np.concatenate([rest, *scales.values()]).astype(np.float64)).sum())
        beta = np.empty((STATES, len(mine)), np.float32)
        beta[:] = 1 / rest
        for t in range(len(active) - 1, 0, -1):
            lo, hi, k = edge[t], edge[t + 1], active[t]
            b, w = beta[:, :k], e[:, lo:hi]
            w *= b
            if t in scales:
                w /= scales[t]
            move += alpha[:, edge[t - 1] : edge[t - 1] + k] @ w.T
            alpha[:, lo:hi] *= b
            np.matmul(there, w, out=b)
        alpha[:, : edge[1]] *= beta
        alpha /= alpha.sum(0)  # now what each state is expected to have emitted
        start += alpha[:, : edge[1]].sum(1)
        for s in range(STATES):
            counts[:, s] += np.bincount(spots, alpha[s], len(emit))
    return start, move * chain.move, counts, likelihood


def _open(left: pa.Table, right: pa.Table, chain: Chain):  # noqa: ANN202
    """Of a chunk and its words: (ids, numbers of tokens, held out, words, totals by word, emissions by word, words in the order of buckets, their number by bucket, buckets)."""
    p = left.to_pylist()[0]
    count, held = unsqueeze(p["a"], np.uint32).astype(np.int64).reshape(2, -1)
    seq = unsqueeze(p["b"], np.uint32)
    right = right.sort_by("bucket")
    rank = [unsqueeze(x, np.uint32) for x in right["rank"].to_pylist()]
    sizes = [len(x) for x in rank]
    at = np.concatenate(rank)
    total, r = np.empty(len(at), np.int64), np.empty((len(at), STATES))
    total[at] = np.concatenate([unsqueeze(x, np.int64) for x in right["total"].to_pylist()])
    r[at] = np.concatenate([unsqueeze_shares(x) for x in right["shares"].to_pylist()])
    return p["ids"], count, held.astype(bool), seq, total, chain.emissions(total, r), at, sizes, right["bucket"].to_pylist()


SENT = "bucket int, chunk long, counts binary, sums array<double>"
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("counts", pa.binary()), ("sums", pa.list_(pa.float64()))])


def _learn(left: pa.Table, right: pa.Table, chain: Chain) -> pa.Table:
    """Expected counts of a chunk's words by bucket, and in one more row (bucket -1) all other sums."""
    if not left.num_rows or not right.num_rows:
        return _SENT.empty_table()
    _, count, held, seq, total, emit, at, sizes, buckets = _open(left, right, chain)
    chunk = left["chunk"][0].as_py()
    start, move, counts, likelihood = expected(seq[np.repeat(~held, count)], count[~held], chain, emit)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    rows = [{"bucket": k, "chunk": chunk, "counts": squeeze_counts(counts[at[a:z]]), "sums": None} for k, a, z in zip(buckets, edge[:-1], edge[1:])]
    rows.append({"bucket": -1, "chunk": chunk, "counts": None, "sums": np.concatenate([start, move.ravel(), counts.sum(0), [likelihood]]).tolist()})
    return pa.Table.from_pylist(rows, schema=_SENT)


_SHARED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("total", pa.binary()), ("rank", pa.binary()), ("shares", pa.binary())])
SHARED = "chunk long, bucket int, total binary, rank binary, shares binary"


def _share(left: pa.Table, right: pa.Table) -> pa.Table:
    """New shares of a bucket's words, for each chunk that has any."""
    if not left.num_rows:
        return _SHARED.empty_table()
    left, right = left.sort_by("chunk"), right.sort_by("chunk")
    which = [unsqueeze(x, np.uint32) for x in left["which"].to_pylist()]
    sent = dict(zip(right["chunk"].to_pylist(), right["counts"].to_pylist()))
    counts = np.zeros((max(int(w.max()) for w in which) + 1, STATES))
    for chunk, w in zip(left["chunk"].to_pylist(), which):
        if chunk in sent:
            counts[w] += unsqueeze_counts(sent[chunk])  # a chunk has a word once
    whole = counts.sum(1, keepdims=True)
    r = np.divide(counts, whole, out=np.zeros_like(counts), where=whole > 0)
    return pa.Table.from_arrays([left["chunk"], left["bucket"], left["total"], left["rank"], pa.array([squeeze_shares(r[w]) for w in which], pa.binary())], schema=_SHARED)


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])


def _score(left: pa.Table, right: pa.Table, chain: Chain) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return _RESULT.empty_table()
    ids, count, held, seq, total, emit, *_ = _open(left, right, chain)
    row = np.repeat(np.arange(len(count)), count)
    base = np.log10((total + 1) / (chain.n + chain.v + 1))
    columns = [pa.array(ids, pa.int64()), pa.array(held), pa.array(count), pa.array(np.bincount(row, total[seq] > 0, len(count)).astype(np.int64)), pa.array(np.full(len(count), chain.n)), pa.array(np.bincount(row, base[seq], len(count))), pa.array(forward(seq, count, chain, emit))]
    return pa.Table.from_arrays(columns, schema=_RESULT)


def _parted(df: DataFrame, key: str, parts: int, tag: str) -> DataFrame:
    """Written in `parts` parts by key, so that a meeting on that key doesn't move it. The catalog forgets its name at once; the files stay for the session."""
    name = f"chronoloom_{tag}_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", shared(df.sparkSession, tag)).mode("overwrite").saveAsTable(name)
    out = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")
    return out


def _with(f: Callable, chain: Chain) -> Callable:
    return lambda a, b: f(a, b, chain)


def score(docs: DataFrame, held_out=None, tolerance: float = TOLERANCE) -> DataFrame:  # noqa: ANN001
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    if held_out is None:
        held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    size = slim.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)).first()[0] or 0
    buckets, least = -(-max(1, size) // BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, min(least, -(-size // (1 << 20)))) if size < least * CHUNK_BYTES else -(-size // CHUNK_BYTES)
    packed = cut(slim.mapInArrow(lambda it: _pack(it, buckets), PACKED), "packed")
    words = packed.filter(F.col("kind") == WORDS).repartition(min(buckets, max(1, size // (8 << 20))), "bucket").sortWithinPartitions("bucket", "chunk")
    members = words.mapInArrow(_members, MEMBERS + ", shares binary")
    members = _parted(members, "bucket", buckets, "members")
    texts = _parted(packed.filter(F.col("kind") == TEXTS).select("chunk", "a", "b", "ids"), "chunk", chunks, "texts")
    drop(packed)
    n, v = members.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    chain = Chain(n, v)
    shares = members.select("chunk", "bucket", "total", "rank", "shares")
    meet = lambda a, b, key, f, schema: a.groupBy(key).cogroup(b.groupBy(key)).applyInArrow(f, schema)
    before, last = -math.inf, None
    while True:
        sent = cut(meet(texts, shares, "chunk", _with(_learn, chain), SENT), "sent")
        sums = sent.filter("bucket = -1").select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
        x = np.array([r["x"] for r in sums]) if sums else np.zeros(2 * STATES + STATES * STATES + 1)
        likelihood = x[-1]
        if not n or (math.isfinite(before) and likelihood - before < tolerance * abs(likelihood)):
            drop(sent)  # `shares`, from the counts before these, and `chain` are those that this likelihood is of
            break
        if last is not None:
            drop(last)
        before, last = likelihood, sent
        chain = Chain(n, v)
        chain.update(x[:STATES], x[STATES : STATES + STATES * STATES].reshape(STATES, STATES), x[-1 - STATES : -1])
        shares = meet(members.select("bucket", "chunk", "which", "total", "rank"), sent.filter("bucket >= 0").select("bucket", "chunk", "counts"), "bucket", _share, SHARED)
    return meet(texts, shares, "chunk", _with(_score, chain), RESULT)
