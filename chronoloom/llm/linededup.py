"""Line dedup: range-partitioned line hashes, streamed in order, answered with keep bitmaps.

Every line becomes a small row (128-bit digest, document, position). The rows are range
partitioned and sorted by all three, so a line that a third of all documents hold
spans as many partitions as its rows need. One pass over each sorted partition
decides the runs that lie within it; the first and the last run, which may go on
in a neighbour, and runs of very many lines in few documents are settled from one summary row for each partition and run. Texts never
take part in that shuffle: the answer is a compressed bitmap for each document that
loses a line.

Defined results: a null text counts as empty, which is one empty line. Lines whose
key is empty (or shorter than `min_chars`) are always kept. A document is a
(doc_id, text) pair, so repeated rows count once and get the same answer; null
doc_ids are documents like any other. No row is ever dropped. Columns beside
doc_id and text are carried along untouched by `apply`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import cut

LINES = "h long, h2 long, doc_id long, text_hash long, pos int"


@T.tidy
def _keys(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data_all, at_all = T.bytes_of(batch.column(1))
        ids, marks = batch.column(0), batch.column(2)
        for lo, hi in T.slices(at_all):
            data, at = T.LOWER[data_all[at_all[lo] : at_all[hi]]], at_all[lo : hi + 1] - at_all[lo]
            start, end, row = T.spans(data != 10, at)
            # a line's number is the count of \n before it in its row
            breaks = np.concatenate([[0], np.cumsum(data == 10)])
            pos = breaks[start] - breaks[at[row]]
            solid = np.flatnonzero(~T.SPACE[data])
            first, last = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
            has = first <= last
            start, end, row, pos = solid[first[has]], solid[last[has]] + 1, row[has], pos[has]
            if min_chars > 1:
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                long = chars[end] - chars[start] >= min_chars
                start, end, row, pos = start[long], end[long], row[long], pos[long]
            raw = data.tobytes()
            digest = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
            h, h2 = np.frombuffer(digest, np.int64).reshape(-1, 2).T
            rows = pa.array(row + lo)
            yield pa.record_batch([pa.array(h), pa.array(h2), ids.take(rows), marks.take(rows), pa.array(pos.astype(np.int32))], ["h", "h2", "doc_id", "text_hash", "pos"])


#: Rows of a run in too few documents so far that a task holds; longer runs are settled from a summary.
HELD_ROWS = 1_000_000
DECIDED = "kind int, h long, h2 long, part long, n long, first_doc long, first_hash long, last_doc long, last_hash long, doc_id long, text_hash long, pos int"


def _starts(t: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Where a row differs from the one before it; nulls equal nulls."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for k in names:
        c = t[k].combine_chunks() if isinstance(t[k], pa.ChunkedArray) else t[k]
        v = c.fill_null(0).to_numpy(zero_copy_only=False)
        out[1:] |= v[1:] != v[:-1]
        if c.null_count:
            z = c.is_null().to_numpy(zero_copy_only=False)
            out[1:] |= z[1:] != z[:-1]
    return out


@T.tidy
def _decide(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Stream one sorted partition. Of the rows of a run, only as many wait as leave its decision open.

    Yields kind 0: lines to drop; kind 1: lines of an edge run, with the partition;
    kind 2: a summary of an edge run.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("h2", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), *[(c, pa.int64()) for c in ("first_doc", "first_hash", "last_doc", "last_hash")], ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32())])

    def rows(kind: int, t: pa.Table, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        t = t.filter(pa.array(mask))
        if t.num_rows:
            none = pa.nulls(t.num_rows, pa.int64())
            cols = [pa.array(np.full(t.num_rows, kind, np.int32)), t["h"], t["h2"], pa.array(np.full(t.num_rows, part)), none, none, none, none, none, t["doc_id"], t["text_hash"], t["pos"]]
            yield from pa.Table.from_arrays(cols, schema=schema).to_batches()

    run = None  # [h, h2, docs, first doc, last doc] of the run that is open
    held: list[pa.Table] = []
    edge = True  # the open run began at the partition's start
    doc_of = lambda t, i: (t["doc_id"][i].as_py(), t["text_hash"][i].as_py())

    def summary() -> pa.RecordBatch:
        h, h2, docs, a, b = run
        return pa.record_batch([[2], [h], [h2], [part], [docs], [a[0]], [a[1]], [b[0]], [b[1]], [None], [None], [None]], schema=schema)

    def flush() -> Iterator[pa.RecordBatch]:
        """The open run began here and has documents enough, whatever the next partition adds."""
        for x in held:
            yield from rows(0, x, ~(x["first"].to_numpy() & keep_first))
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        new_run = _starts(t, ("h", "h2"))
        new_doc = _starts(t, ("h", "h2", "doc_id", "text_hash"))
        if run and (t["h"][0].as_py(), t["h2"][0].as_py()) == (run[0], run[1]):
            new_run[0] = False
            new_doc[0] = doc_of(t, 0) != run[4]
        cuts = np.flatnonzero(new_run)
        until = int(cuts[0]) if len(cuts) else t.num_rows
        if until:  # the open run goes on
            head = t.slice(0, until)
            run[2] += int(new_doc[:until].sum())
            run[4] = doc_of(head, until - 1)
            if edge:
                yield from rows(1, head, np.ones(until, bool))
            else:
                held.append(head.append_column("first", pa.array(np.zeros(until, bool))))
                if run[2] >= min_docs:
                    yield from flush()
                elif sum(x.num_rows for x in held) > most:  # settled from a summary, like a run at the edge
                    for x in held:
                        yield from rows(1, x.drop_columns(["first"]), np.ones(x.num_rows, bool))
                    held.clear()
                    edge = True
        if not len(cuts):
            continue
        if run:  # it ended here
            if edge:
                yield summary()
        held, edge = [], run is None
        # runs that lie within this batch, then the one left open
        ends = np.append(cuts[1:], t.num_rows)
        docs = np.add.reduceat(new_doc.astype(np.int64), cuts)
        if not edge or len(cuts) > 1:
            lo = 1 if edge else 0
            if edge:
                a, b = int(cuts[0]), int(ends[0])
                run = [t["h"][a].as_py(), t["h2"][a].as_py(), int(docs[0]), doc_of(t, a), doc_of(t, b - 1)]
                yield from rows(1, t.slice(a, b - a), np.ones(b - a, bool))
                yield summary()
                edge = False
            drop = np.zeros(t.num_rows, bool)
            for i in lo + np.flatnonzero(docs[lo : len(cuts) - 1] >= min_docs):
                drop[cuts[i] : ends[i]] = True
                if keep_first:
                    drop[cuts[i]] = False
            yield from rows(0, t, drop)
        a = int(cuts[-1])
        tail = t.slice(a)
        run = [t["h"][a].as_py(), t["h2"][a].as_py(), int(docs[-1]), doc_of(t, a), doc_of(t, t.num_rows - 1)]
        if edge:
            yield from rows(1, tail, np.ones(tail.num_rows, bool))
        else:
            held = [tail.append_column("first", pa.array(np.arange(tail.num_rows) == 0))]
        if not edge and run[2] >= min_docs:
            yield from flush()
    if run:
        if not edge:
            for x in held:
                yield from rows(1, x.drop_columns(["first"]), np.ones(x.num_rows, bool))
        yield summary()


@T.tidy
def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in T.whole_runs(batches, ["_g"], 20_000):
        pos = t["pos"].combine_chunks().to_numpy()
        cuts = np.flatnonzero(_starts(t, ("doc_id", "text_hash")))
        ends = np.append(cuts[1:], t.num_rows)
        maps, counts = [], []
        for a, b in zip(cuts, ends):
            p = np.unique(pos[a:b])
            keep = np.ones((int(p[-1]) // 8 + 1) * 8, bool)
            keep[p] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
            counts.append(len(p))
        at = pa.array(cuts)
        yield pa.record_batch([t["doc_id"].combine_chunks().take(at), t["text_hash"].combine_chunks().take(at), pa.array(maps, pa.binary()), pa.array(counts, pa.int32())], ["doc_id", "text_hash", "keep", "n_dropped"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that lose lines: (doc_id, text_hash, keep binary, n_dropped).

    A line whose key (stripped of `[\\x20\\x09-\\x0D]`, A-Z lower-cased) is found in at
    least `min_docs` documents goes; with `keep_first` its first occurrence stays.
    `keep` is a zlib-compressed bitmap, most significant bit first, of the lines up to
    the last one dropped: 1 stays, 0 goes; lines beyond it stay. text_hash is xxhash64 of the text (null: empty).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    lines = cut(slim.mapInArrow(lambda it: _keys(it, min_chars), LINES), "lines")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order, most = ["h", "h2", "doc_id", "text_hash", "pos"], HELD_ROWS
    found = cut(lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lambda it: _decide(it, min_docs, keep_first, most), DECIDED), "decided")
    # One or two summaries a partition: those of a run that crosses partitions are put together in order.
    # Counts of documents overlap by one where a document's equal lines fall on both sides of a border.
    by = F.struct("part", "n", "first_doc", "first_hash", "last_doc", "last_hash")
    edges = found.filter("kind = 2").groupBy("h", "h2").agg(F.sort_array(F.collect_list(by)).alias("s"))
    overlap = F.expr("size(filter(sequence(1, size(s)), i -> i < size(s) and s[i].first_doc <=> s[i - 1].last_doc and s[i].first_hash <=> s[i - 1].last_hash))")
    edges = edges.select("h", "h2", (F.expr("aggregate(s, 0L, (t, x) -> t + x.n)") - overlap).alias("docs"), F.expr("s[0].part").alias("first_part"))
    # at most two runs a partition, and one more for every HELD_ROWS lines
    gone = edges.filter(F.col("docs") >= min_docs)
    open_ = found.filter("kind = 1").select("h", "h2", "part", "doc_id", "text_hash", "pos").join(F.broadcast(gone), ["h", "h2"])
    if keep_first:
        at = F.struct("doc_id", "text_hash", "pos")
        low = open_.filter("part = first_part").groupBy("h", "h2").agg(F.min(at).alias("low"))
        open_ = open_.join(F.broadcast(low), ["h", "h2"], "left").filter(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("low")))
    dropped = found.filter("kind = 0").select("doc_id", "text_hash", "pos").union(open_.select("doc_id", "text_hash", "pos")).withColumn("_g", F.xxhash64("doc_id", "text_hash"))
    return dropped.repartition("_g").sortWithinPartitions("_g", "doc_id", "text_hash", "pos").mapInArrow(_bitmaps, "doc_id long, text_hash long, keep binary, n_dropped int")


def kept_text(text: str | None, keep: bytes | None) -> str:
    """The lines that a bitmap keeps, joined by \\n."""
    if not keep:
        return text or ""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return "\n".join(x for i, x in enumerate((text or "").split("\n")) if i >= len(bits) or bits[i])


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs` as one struct `row`, with `keep` and `n_dropped` (null: nothing goes)."""
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    mark = F.xxhash64(F.coalesce(F.col("row")[text_col], F.lit("")))
    left = left.withColumn("_id", F.col("row")[id_col].cast("long")).withColumn("_mark", mark)
    right = bitmaps.select(F.col("doc_id").alias("_bid"), F.col("text_hash").alias("_bmark"), "keep", "n_dropped")
    out = left.join(right.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_bid")) & F.col("_mark").eqNullSafe(F.col("_bmark")), "left")
    return out.select("row", "keep", "n_dropped")


@T.tidy
def _shorten(batches: Iterator[pa.RecordBatch], at_text: int) -> Iterator[pa.RecordBatch]:
    """All columns but the last, which is the bitmap, texts being shortened to what it keeps."""
    for b in batches:
        text = b.column(at_text)
        _, size = T.bytes_of(text)
        for lo, hi in T.slices(size):
            some = [x.slice(lo, hi - lo) for x in b.columns[:-1]]
            keep = b.column(b.num_columns - 1).slice(lo, hi - lo).to_pylist()
            if any(k is not None for k in keep):
                some[at_text] = pa.array([t if k is None else kept_text(t, k) for t, k in zip(some[at_text].to_pylist(), keep)], text.type)
            yield pa.record_batch(some, b.schema.names[:-1])


def apply(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with its texts shortened to the lines kept; all columns and rows stay."""

    joined = with_bitmaps(docs, bitmaps, id_col, text_col)
    at = docs.columns.index(text_col)
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("keep").alias("_keep")).mapInArrow(lambda it: _shorten(it, at), docs.schema)


@T.tidy
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, keeps = b.column(1).to_pylist(), b.column(2).to_pylist()
        sha = [hashlib.sha256(kept_text(t, k).encode()).hexdigest() for t, k in zip(texts, keeps)]
        lines = [(t or "").count("\n") + 1 for t in texts]
        yield pa.record_batch([b.column(0), pa.array(lines, pa.int64()), b.column(3).fill_null(0), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 of the text that stays."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = with_bitmaps(slim, keep_bitmaps(slim, min_docs, min_chars))
    return joined.select("row.doc_id", "row.text", "keep", F.col("n_dropped").cast("long")).mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
