"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file is turned into a vocabulary and its merges, its bytes written as the
printable characters that byte-level models use. Texts are first cut at places
where the pattern always has a border; pieces of equal bytes are encoded once for as long as
a worker remembers them, and their ids put in place by array operations, so most of
the corpus is copied, not tokenised. `encode_offsets`
gives the library's own output with character offsets.

Decoding joins the bytes of the ids by the reversed table; a character split over
several tokens is whole again once its last byte is there, and `Decoder` holds back
the bytes of an unfinished one when ids come in pieces.

Defined results: a null text counts as empty and has no ids. Whole texts of any
length are encoded. Rows and other columns stay as they are.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in printable}
    others = (b for b in range(256) if b not in out)
    return out | {b: chr(256 + k) for k, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last merge that makes `token`, or none if merges of lower rank don't leave two parts."""
    limit = ranks[token]
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = [ranks.get(parts[i] + parts[i + 1], limit) for i in range(len(parts) - 1)]
        low = min(at)
        if low >= limit:
            return None
        i = at.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1 and so on, `size` of them, for each begin in turn."""
    before = np.cumsum(size, dtype=np.int64) - size
    out = np.repeat(begin - before, size)
    out += np.arange(len(out))
    return out


class Pool:
    """Strings by number, to be put together many at once."""

    def __init__(self, strings: list[bytes]) -> None:
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the strings of all ids, offsets in them of the places `at` in `ids`)."""
        n = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.bytes[gather(self.starts[ids], n)], total[at]


class Bpe:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        char = byte_characters()
        show = lambda b: "".join(char[x] for x in b)
        pairs = [m for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1 and (m := merge_of(t, ranks))]
        self.tokenizer = Tokenizer(models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=[(show(a), show(b)) for a, b in pairs], ignore_merges=True))
        self.model = self.tokenizer.model
        self.shown_bytes = {b: ord(c) for b, c in char.items()}
        self.forget()
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token_bytes[r] = t
        self.text_of = Pool(self.token_bytes)
        self.decimal_of = Pool([b"%d," % i for i in range(len(self.token_bytes))])

    def encode_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """(ids, character offsets of each id) by the library."""
        return [(e.ids, e.offsets) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, names: list[bytes], texts: list[str | None], shown: list[str | None]) -> None:
        """Encode new pieces: one run of letters goes to the merges at once, others through the split pattern as well."""
        ids = [[t.id for t in self.model.tokenize(x)] if x is not None else None for x in shown]
        some = [k for k, x in enumerate(ids) if x is None]
        for k, e in zip(some, self.tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)):
            ids[k] = e.ids
        sizes = [len(x) for x in ids]
        grown, n = self.filled + sum(sizes), len(self.known)
        if grown > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.filled], np.zeros(grown, np.int32)])
        if n + len(ids) > len(self.size):
            self.begin, self.size = (np.concatenate([x[:n], np.zeros(n + len(ids), np.int64)]) for x in (self.begin, self.size))
        self.flat[self.filled : grown] = [i for x in ids for i in x]
        self.size[n : n + len(ids)] = sizes
        self.begin[n : n + len(ids)] = self.filled + np.cumsum(sizes) - sizes
        self.known.update(zip(names, range(n, n + len(ids))))
        self.filled = grown

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # bytes of a piece: its number; emptied when full
        self.flat, self.filled = np.zeros(1 << 16, np.int32), 0  # ids of all pieces
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)  # by number: where a piece's ids begin, how many they are

    def encode_slice(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of a slice of texts: (row of each piece, where its ids begin in `flat`, how many they are)."""
        start, end, row, plain = pieces(data, at)
        if not len(start):
            return (row,) * 3
        if len(self.known) > MOST_KNOWN or self.filled > MOST_IDS:
            self.forget()
        _, first, which = np.unique(T.hashes(data, start, end), return_index=True, return_inverse=True)
        # pieces of one hash are one piece if their bytes agree; the others get numbers of their own
        odd = np.flatnonzero(~T.equal_spans(data, start, end, start[first][which], end[first][which]))
        raw = data.tobytes()
        if len(odd):
            number: dict[bytes, int] = {}
            for i in odd.tolist():
                k = number.setdefault(raw[start[i] : end[i]], len(first) + len(number))
                which[i] = k
            _, first = np.unique(which, return_index=True)
        begins, ends = start[first].tolist(), end[first].tolist()
        names = [raw[a:b] for a, b in zip(begins, ends)]
        get = self.known.get
        new = [k for k, x in enumerate(names) if get(x) is None]
        if new:
            seen = raw.decode("latin-1").translate(self.shown_bytes)
            simple = plain[first].tolist()
            self._learn([names[k] for k in new], [None if simple[k] else names[k].decode() for k in new], [seen[begins[k] : ends[k]] if simple[k] else None for k in new])
        place = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        return row, self.begin[place][which], self.size[place][which]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of the slice in order, offsets of the texts in them)."""
        row, begin, size = self.encode_slice(data, at)
        per_row = np.bincount(row, size, len(at) - 1).astype(np.int64)
        return self.flat[gather(begin, size)], np.concatenate([[0], np.cumsum(per_row)])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets of the texts in them)."""
        return self.text_of.join(ids, at)

    def decimals(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in decimal, a comma after each, offsets of the texts in them)."""
        return self.decimal_of.join(ids, at)


class Decoder:
    """Decode ids that come in pieces: text is given out once its characters are whole."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.held = bpe, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.held.decode(b"".join(self.bpe.token_bytes[i] for i in ids), last)


#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 18
#: Pieces that an encoder remembers before it starts afresh.
MOST_KNOWN = 250_000
#: Ids of such pieces before it does (long pieces have many).
MOST_IDS = 4_000_000


@lru_cache(2)
def load(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


_BEFORE, _AFTER = np.zeros(256, bool), np.zeros(256, bool)  # bytes that end or begin no white space
_BEFORE[0x21:0x7F] = _AFTER[0x21:0x7F] = True
_BEFORE[0x80:] = True
_BEFORE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
_AFTER[0xC3:] = True
_AFTER[[0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of pieces of texts, and whether a piece is one run of Latin letters, perhaps after a space.

    A text is cut before each space or line feed that stands alone between visible
    characters, and before an ASCII sign after a letter. No match of the pattern
    crosses these places, as none has a visible character before white space or a
    sign after a letter; characters that might be white space beyond ASCII (by their
    bytes) are taken for such.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    letter = _LETTER[data]
    # U+00C0 to U+00FF but for the two signs there: byte C3 and a second byte
    second = np.zeros(n, bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter |= second
    letter[:-1] |= second[1:]
    mark = (data == 32) | (data == 10)
    before = _BEFORE[data] | second
    mark[1:] &= before[:-1]
    mark[:-1] &= _AFTER[data[1:]]
    mark[0] = mark[-1] = False
    mark[1:] |= _MARK[data[1:]] & letter[:-1]
    mark[at[:-1][np.diff(at) > 0]] = True
    start = np.flatnonzero(mark)
    end = np.append(start[1:], n)
    other = np.concatenate([[0], np.cumsum(~letter)])
    n_other = other[end] - other[start]
    plain = (n_other == 0) | ((n_other == 1) & (data[start] == 32) & (end - start > 1))
    return start, end, np.searchsorted(at, start, "right") - 1, plain


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """`docs` with the ids of each text in an array column `to`."""

    @F.pandas_udf("array<int>")
    def ids(text):  # noqa: ANN001, ANN202
        import pandas as pd

        bpe, out = load(path, pattern), []
        data, at = T.bytes_of(pa.array(text, pa.string()))
        for lo, hi in T.slices(at):
            x, cut = bpe.encode(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            out += np.split(x, cut[1:-1])
        return pd.Series(out, dtype=object)

    return docs.withColumn(to, ids(docs[text_col]))


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """`docs` with the bytes that each array of ids stands for in a binary column `to`; null: no ids."""

    @F.pandas_udf("binary")
    def back(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        bpe = load(path, pattern)
        return pd.Series([b"".join([bpe.token_bytes[i] for i in x]) if x is not None else b"" for x in ids], dtype=object)

    return docs.withColumn(to, back(docs[ids_col]))


@T.tidy
def _report(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path, pattern)
    for b in batches:
        data_all, at_all = T.bytes_of(b.column(1))
        for lo, hi in T.slices(at_all, SLICE_BYTES):
            ids, at = bpe.encode(data_all[at_all[lo] : at_all[hi]], at_all[lo : hi + 1] - at_all[lo])
            shown, shown_at = bpe.decimals(ids, at)
            ids_sha = [hashlib.sha256(shown[i : max(i, j - 1)]).hexdigest() for i, j in zip(shown_at[:-1].tolist(), shown_at[1:].tolist())]
            del shown
            out, out_at = bpe.decode(ids, at)
            decoded_sha = [hashlib.sha256(out[i:j]).hexdigest() for i, j in zip(out_at[:-1].tolist(), out_at[1:].tolist())]
            n_tokens = np.diff(at)
            yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    load.cache_clear()  # a worker that waits keeps no vocabulary: reading it again takes half a second


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lambda it: _report(it, path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
