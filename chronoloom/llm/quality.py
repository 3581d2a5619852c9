"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is split into words and runs of signs. Features are hashed n-grams of the
words themselves (lower-cased, n = 1, 2) and of their shapes (case, digits, the sign,
a word that repeats the one before it; n = 1, 2, 3), each kind as shares of its
number in the text. Only the text is ever an input.

Training is one pass of FTRL-proximal updates in a fixed order over at most
`max_rows` labelled rows (those with the smallest hash of doc_id), in one task that
streams them. The weights are 2**bits floats whatever the size of the corpus; they go
to every task, where whole texts are scored as sparse dot products.

Defined results: null and empty texts have no features and score by the intercept
alone. Labels that are null don't train, repeated ones train each, and labels
without a document don't count. Without any labels every score is 0.5. Rows with
a null doc_id are scored, never learnt from. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

U64 = T.U64
BITS = 18
MAX_ROWS = 20_000
ALPHA, BETA, L1, L2 = 1.0, 0.05, 1e-4, 1e-3

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 word, 2 sign
_KIND[T.SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOW = np.zeros(256, bool)
_LOW[97:123] = True


def features(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram of the texts of a slice: (row, hashed place) of every occurrence."""
    n = len(data)
    if not n:
        return
    kind = _KIND[data]
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[at[:-1][at[:-1] < n]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    if not len(start):
        return
    row = np.searchsorted(at, start, "right") - 1
    word = T.hashes(T.LOWER[data], start, end)
    count = lambda mask: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(mask[data])]))
    upper, low, digit = count(_UPPER), count(_LOW), count(_DIGIT)
    sign = kind[start] == 2
    shape = np.select([digit == end - start, (upper > 0) & (low == 0) & (end - start > 1), _UPPER[data[start]] & (upper == 1), upper == 0], [1, 2, 3, 4], 5).astype(U64)
    shape[sign] = word[sign]
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    shape[same & ~sign] = 6
    mask = U64((1 << bits) - 1)
    for seq, salt, most in ((word, 1, 2), (T.mix(shape + U64(99)), 7, 3)):
        h = seq
        for k in range(most):
            if k:
                h = T.mix(h[:-1] * U64(0x9E3779B97F4A7C15) + seq[k:])
            r = row[k:]
            inside = r == row[: len(r)]
            yield r[inside], (T.mix(h[inside] + U64(salt + k)) & mask).astype(np.int64)


def vectors(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse vector (places, values) of each text of a slice."""
    rows = len(at) - 1
    parts = []
    for r, j in features(data, at, bits):
        size = np.bincount(r, minlength=rows)
        parts.append((r, j, 1.0 / size[r]))
    if not parts:
        return [(np.zeros(0, np.int64), np.zeros(0))] * rows
    r, j, v = (np.concatenate(x) for x in zip(*parts))
    key, where = np.unique(r << bits | j, return_inverse=True)
    v = np.bincount(where, v, len(key))
    r, j = key >> bits, key & ((1 << bits) - 1)
    edge = np.searchsorted(r, np.arange(rows + 1))
    return [(j[a:b], v[a:b]) for a, b in zip(edge[:-1], edge[1:])]


class Ftrl:
    """FTRL-proximal for logistic loss; the last place is the intercept, which isn't regularised."""

    def __init__(self, bits: int = BITS) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, j: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[j], self.n[j]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, j: np.ndarray, x: np.ndarray, y: int) -> None:
        j, x = np.append(j, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(j)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        s = (np.sqrt(self.n[j] + g * g) - np.sqrt(self.n[j])) / ALPHA
        self.z[j] += g - s * w
        self.n[j] += g * g


@T.tidy
def _train(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    model, seen = Ftrl(bits), 0
    for b in batches:
        data, at = T.bytes_of(b.column(0))
        quality = b.column(1).to_numpy(zero_copy_only=False)
        for lo, hi in T.slices(at):
            for k, (j, x) in enumerate(vectors(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], bits)):
                model.learn(j, x, int(quality[lo + k]))
                seen += 1
    w = model.weights(slice(None)).astype(np.float32)
    yield pa.record_batch([pa.array([w.tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["w", "seen"])


def held_out(doc_id: str = "doc_id"):  # noqa: ANN201
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights learnt from at most `max_rows` labelled rows that aren't held out."""
    some = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality"))
    some = some.withColumn("_order", F.xxhash64("_id", F.lit(17))).orderBy("_order", "_id", "_quality").limit(max_rows)
    text = docs.select(F.col("doc_id").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = text.join(F.broadcast(some), F.col("_doc") == F.col("_id"))  # at most max_rows of them
    rows = rows.select("_text", "_quality", "_order", "_id").repartition(1).sortWithinPartitions("_order", "_id", "_quality", F.xxhash64("_text"))
    out = rows.select("_text", "_quality").mapInArrow(lambda it: _train(it, bits), "w binary, seen long").collect()
    w = np.frombuffer(bytes(out[0]["w"]), np.float32) if out else np.zeros((1 << bits) + 1, np.float32)
    return w.astype(np.float64)


def scores(data: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores of the texts of a slice."""
    bits = int(len(w) - 1).bit_length() - 1
    rows = len(at) - 1
    total = np.full(rows, w[-1])
    for r, j in features(data, at, bits):
        total += np.bincount(r, w[j], rows) / np.maximum(np.bincount(r, minlength=rows), 1)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _score_column(w: np.ndarray):  # noqa: ANN202
    @F.pandas_udf("double")
    def score(text):  # noqa: ANN001, ANN202
        import pandas as pd

        data, at = T.bytes_of(pa.array(text, pa.string()))
        out = [scores(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], w) for lo, hi in T.slices(at)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def score(docs: DataFrame, w: np.ndarray, to: str = "score", text_col: str = "text") -> DataFrame:
    """`docs` with the score of each text, 0 to 1, in column `to`."""
    return docs.withColumn(to, _score_column(w)(docs[text_col].cast("string")))


@T.tidy
def _keep(batches: Iterator[pa.RecordBatch], w: np.ndarray, least: float, at_text: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = T.bytes_of(b.column(at_text))
        for lo, hi in T.slices(at):
            s = scores(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], w)
            yield b.slice(lo, hi - lo).filter(pa.array(s >= least))


def keep(docs: DataFrame, w: np.ndarray, least: float = 0.3) -> DataFrame:
    """The rows of `docs` that score at least `least`; their columns are unchanged."""
    at_text = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _keep(it, w, least, at_text), docs.schema)


@T.tidy
def _report(batches: Iterator[pa.RecordBatch], w: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = T.bytes_of(b.column(2))
        out = [scores(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], w) for lo, hi in T.slices(at)]
        s = np.concatenate(out) if out else np.zeros(0)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array((s >= least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def report(docs: DataFrame, labels: DataFrame, least: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    w = train(docs, labels, max_rows)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lambda it: _report(it, w, least), "doc_id long, held_out boolean, score double, predicted int")
