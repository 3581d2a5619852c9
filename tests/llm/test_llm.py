"""The ten operators and the pipeline: against brute force on small fixtures, and with nulls, empty and long texts, ties, repetitions, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 4000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, row string, keep string"
ROWS = [
    (0, "one two three four five six seven eight nine ten", "en", "a", 0, 0.0, "x", "r", "k"),
    (1, "one two three four five six seven eight nine ten", "en", "a", 0, 0.0, "x", "r", "k"),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "b", 0, None, "", "", ""),
    (4, " \t\n ", "en", "b", 0, None, "", "", ""),
    (5, LONG, "en", "a", 0, None, "", "", ""),
    (5, LONG, "en", "a", 0, None, "", "", ""),
    (None, "no name here", "en", "c", 0, None, "", "", ""),
    (7, "héllo wörld 日本 😀\nsame line\n", "fr", "c", 0, None, "", "", ""),
    *[(10 + k, f"same line\nown {k} words and more of them here", "en", None if k % 2 else "d", 0, None, "", "", "") for k in range(12)],
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, 0) for k in range(20)] + [(3, None, None), (None, 1, 0), (99, 1, 0), (10, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# Kernels


def test_words_and_hashes_agree_with_python():
    import pyarrow as pa

    from chronoloom.llm import _text as T

    texts = ["a bb  a", "", None, " bb\n日本 a ", "bb"]
    data, at = T.bytes_of(pa.array(texts))
    s, e, row = T.words(data, at)
    got = [(int(r), bytes(data[a:b]).decode()) for a, b, r in zip(s, e, row)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in words(t)]
    h = T.hashes(data, s, e)
    same = {}
    for (_, w), x in zip(got, h.tolist()):
        assert same.setdefault(w, x) == x
    assert len(set(same.values())) == len(same)


# 1 mixing


def test_mixing(spark, odd, none):
    from chronoloom.llm import mixing

    out = mixing.mix(odd).toPandas()
    assert len(out) == len(ROWS)
    again = mixing.mix(odd.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert out.sort_values(key).fillna(-1).reset_index(drop=True).equals(again.sort_values(key).fillna(-1).reset_index(drop=True))
    assert (out["taken"] <= 2 * out["size"]).all()
    assert abs(out["target"].groupby(out["source_size"]).first().sum()) > 0
    assert mixing.mix(none).count() == 0


def test_targets_share_the_excess():
    from chronoloom.llm.mixing import targets

    sizes = [1000, 10, 500]
    t = targets(sizes, [5, 2, 1])
    assert sum(t) == pytest.approx(1.5 * sum(sizes)) and all(x <= 2 * s for x, s in zip(t, sizes))
    assert targets([0, 0], [5, 2]) == [0, 0]


def test_mixing_comes_near_its_targets(spark, sf):
    from chronoloom.llm import mixing

    out = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).toPandas()
    assert (abs(out["t"] - out["target"]) <= 0.5).all()


def test_mixing_of_small_sources(spark):
    from chronoloom.llm import mixing

    sizes = [150_000, 7, 65, 30, 20, 100, 1, 0, 129]
    rows = [(100 * k + j, " ".join(["w"] * (n // 3 + (j < n % 3))), f"s{k}") for k, n in enumerate(sizes) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).toPandas()
    assert len(out) == len(sizes) and (abs(out["t"] - out["target"]) <= 0.5).all() and (out["over"] <= 0).all()
    goal = mixing.targets(sizes, [5, 2, 1] * 3)
    assert out.sort_values("source")["target"].tolist() == goal
    _, _, slots = mixing.plan(docs)
    counted = {r["s"]: r["words"] for r in slots.groupBy("s").agg(F.sum("words").alias("words")).collect()}
    assert all(abs(counted.get(k, 0) - g) <= 0.5 for k, g in enumerate(goal))


# 2 near-dedup


def brute_components(rows, percent=70, width=5):
    sets = {}
    for d, t in rows:
        w = words(fold(t))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def test_near_dedup_against_brute_force(spark):
    from chronoloom.llm import minhash

    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):
        base = rng.choice(vocabulary, int(rng.integers(8, 120))).tolist()
        for _ in range(int(rng.integers(1, 12))):
            t = list(base)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(len(t)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(t)))
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_dedup_edge_cases(odd, none):
    from chronoloom.llm import minhash

    rows = minhash.report(odd).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["component_id"] == 0 and not by[1]["kept"] and by[0]["kept"]
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0 and by[2]["kept"] and by[3]["kept"]
    nameless = [r for r in rows if r["doc_id"] is None]
    assert len(nameless) == 1 and nameless[0]["component_id"] is None and nameless[0]["kept"]
    assert minhash.report(none).count() == 0


def test_minhash_shuffles_no_texts_to_confirm_links(spark, monkeypatch):
    from chronoloom.llm import minhash

    plans, cut = [], minhash.cut

    def seen(df, tag):
        if tag == "sets":
            plans.append(df._jdf.queryExecution().executedPlan().toString().splitlines())
        return cut(df, tag)

    monkeypatch.setattr(minhash, "cut", seen)
    monkeypatch.setattr(minhash, "FILTER_BITS", 10)  # others pass as well, and are dropped
    own = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(30)]
    docs = spark.createDataFrame([*enumerate(own), (100, own[3] + " more"), (101, own[8] + " else")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["component_id"] for r in minhash.report(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {k: k for k in range(30)} | {100: 3, 101: 8}
    deep = lambda x: len(x) - len(x.lstrip(" :+-"))
    for lines in plans:
        at = next(k for k, x in enumerate(lines) if "MapInArrow" in x)
        below = lines[at + 1 :]
        below = below[: next((k for k, x in enumerate(below) if deep(x) <= deep(lines[at])), len(below))]
        assert below and not any("Exchange" in x for x in below)
    assert plans


def test_odd_sketch_estimates_similarity():
    from chronoloom.llm import _text as T
    from chronoloom.llm import minhash

    rng = np.random.default_rng(2)
    a = np.sort(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    b = np.sort(np.concatenate([a[:3600], rng.integers(0, 1 << 63, 400).astype(np.uint64)]))
    row = np.repeat([0, 1], 4000)
    _, mins, _ = minhash.signatures(row, T.mix(np.concatenate([a, b])))
    s = minhash.odd_sketch(mins)
    d = int(np.bitwise_count(s[0] ^ s[1]).sum())
    assert abs(float(minhash.sketch_similarity(d)) - 3600 / 4400) < 0.12
    assert d <= minhash.most_differing(0.7)


# 3 quality


def test_quality_learns_and_is_blind_to_labels(spark, sf):
    from chronoloom.llm import quality

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.report(docs, labels).toPandas().set_index("doc_id")
    truth = labels.toPandas().set_index("doc_id")["quality"]
    held = out[out["held_out"]].join(truth, how="inner")
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held.index)
    assert (held["predicted"] == held["quality"]).mean() >= 0.9
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    renamed = quality.report(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), labels).toPandas().set_index("doc_id")
    assert (renamed["score"] - out["score"]).abs().max() == 0


def test_quality_against_plain_python(spark, odd, labels):
    """Features, updates and scores written out feature by feature."""
    import math
    import re

    from chronoloom.llm import _text as T
    from chronoloom.llm import quality

    M = (1 << 64) - 1

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & M
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & M
        return h ^ h >> 31

    def word_hash(w):
        raw = np.frombuffer(w, np.uint8)
        return int(T.hashes(raw, np.array([0]), np.array([len(raw)]))[0])

    def features(text):
        raw = (text or "").encode()
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", raw)
        low = [word_hash(re.sub(rb"[A-Z]", lambda m: m.group().lower(), t)) for t in tokens]
        shapes = []
        for k, t in enumerate(tokens):
            sign = not re.match(rb"[0-9A-Za-z\x80-\xff]", t)
            upper, small = len(re.findall(rb"[A-Z]", t)), len(re.findall(rb"[a-z]", t))
            if sign:
                shapes.append(low[k])
            elif k and low[k] == low[k - 1]:
                shapes.append(6)
            elif re.fullmatch(rb"[0-9]+", t):
                shapes.append(1)
            elif upper and not small and len(t) > 1:
                shapes.append(2)
            elif re.match(rb"[A-Z]", t) and upper == 1:
                shapes.append(3)
            else:
                shapes.append(5 if upper else 4)
        out = {}
        for seq, salt, most in ((low, 1, 2), ([mix(s + 99 & M) for s in shapes], 7, 3)):
            for k in range(most):
                grams = []
                for i in range(len(seq) - k):
                    h = seq[i]
                    for j in range(1, k + 1):
                        h = mix((h * 0x9E3779B97F4A7C15 + seq[i + j]) & M)
                    grams.append(mix(h + salt + k & M) & ((1 << quality.BITS) - 1))
                for g in grams:
                    out[g] = out.get(g, 0) + 1 / len(grams)
        return out

    z, n = {}, {}

    def weight(j):
        if not z.get(j):
            return 0.0
        return -math.copysign(max(abs(z[j]) - quality.L1, 0), z[j]) / ((quality.BETA + math.sqrt(n[j])) / quality.ALPHA + quality.L2)

    docs = [(k, f"Word{k % 3} word{k % 3}, and {k} MORE things! {'again again' * (k % 2)} é") for k in range(40)]
    marks = [(k, k % 2) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marked = spark.createDataFrame(marks, "doc_id long, quality int")
    order = [r["doc_id"] for r in marked.orderBy(F.xxhash64("doc_id", F.lit(17))).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    for d in order:
        x = features(docs[d][1]) | {-1: 1.0}
        p = 1 / (1 + math.exp(-sum(weight(j) * v for j, v in x.items())))
        for j, v in x.items():
            w, g, old = weight(j), (p - marks[d][1]) * v, n.get(j, 0.0)
            z[j] = z.get(j, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / quality.ALPHA * w
            n[j] = old + g * g
    got = {r["doc_id"]: r["score"] for r in quality.report(frame, marked).collect()}
    for d, text in docs:
        want = 1 / (1 + math.exp(-sum(weight(j) * v for j, v in (features(text) | {-1: 1.0}).items())))
        assert got[d] == pytest.approx(want, abs=1e-5)


def test_quality_edge_cases(odd, none, labels):
    from chronoloom.llm import quality

    assert quality.report(odd, labels).count() == len(ROWS)
    assert quality.report(none, labels).count() == 0
    no_labels = quality.report(odd, labels.filter("false")).toPandas()
    assert (no_labels["score"] == 0.5).all()
    kept = quality.keep(odd, quality.train(odd, labels), 0.0)
    assert kept.columns == odd.columns and kept.count() == len(ROWS)


# 4 nearest neighbours


def test_search_against_brute_force(spark):
    from chronoloom.llm import ann

    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 24)) * rng.uniform(0.5, 2, (900, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0]), (None, [1.0] * 24), (20, x[20].tolist()), (1004, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    out = ann.search(df, "vec_id % 20 = 0", k=10).toPandas()
    s = x @ x.T
    hit = 0
    queries = range(0, 900, 20)
    for q in queries:
        s[q, q] = -np.inf
        mine = out[out["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.allclose(mine["score"], s[q, mine["vec_id"].to_numpy()], rtol=0, atol=1e-9)
        hit += len(set(mine["vec_id"]) & set(np.argsort(-s[q])[:10].tolist()))
    assert set(out["query_id"]) == set(queries) and hit / 10 / len(queries) >= 0.9


def test_search_with_few_vectors(spark):
    from chronoloom.llm import ann

    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few, "vec_id % 20 = 0").orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(few.filter("false"), "vec_id % 20 = 0").count() == 0


def test_search_beside_extreme_vectors(spark):
    from chronoloom.llm import ann

    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    schema = "vec_id long, embedding array<double>"
    plain = ann.search(spark.createDataFrame(rows, schema), "vec_id % 20 = 0", k=5).toPandas()
    far = [(3001, [1e160] + [0.0] * 15), (3003, [1e-200] * 16), (3005, [1.0, 2.0]), (3020, [3.0, 1.0]), (3041, [0.5, 0.5]), (7, x[9].tolist()), (40, x[8].tolist())]
    out = ann.search(spark.createDataFrame(rows + far, schema), "vec_id % 20 = 0", k=5)
    mine = out.toPandas()
    two = mine[mine["query_id"] == 3020]
    assert two["vec_id"].tolist() == [3005, 3041] and two["score"].tolist() == [5.0, 2.0]
    assert len(mine[mine["query_id"] == 40]) == 10
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hit = 0
    for q in range(0, 3000, 20):
        if q == 40:
            continue
        got = mine[mine["query_id"] == q].sort_values("rank")
        assert (3001 in got["vec_id"].tolist()) == (x[q, 0] > 0) and len(got) == 5
        hit += len(set(got["vec_id"]) & set(np.argsort(-s[q])[:5].tolist())) / (5 - (x[q, 0] > 0))
    assert hit / 149 >= 0.9 and len(plain) == 750


# 5 BPE


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as P
    import tiktoken

    from chronoloom.llm import bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_against_tiktoken(spark, odd, none, encoding):
    from chronoloom.llm import bpe

    path, pattern, enc = encoding
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.report(odd, path, pattern).collect()}
    want = set()
    for r in ROWS:
        ids = enc.encode_ordinary(r[1] or "")
        want.add((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == want
    assert bpe.report(none, path, pattern).count() == 0
    both = bpe.decode(bpe.encode(odd, path, pattern), path, pattern).select("text", "ids", "decoded").collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") and list(r["ids"]) == enc.encode_ordinary(r["text"] or "") for r in both)


def test_bpe_on_random_strings(encoding):
    import random

    import pyarrow as pa

    from chronoloom.llm import _text as T
    from chronoloom.llm import bpe

    path, pattern, enc = encoding
    rnd = random.Random(7)
    alphabet = list("ab 1.\n\t'-é 　 \r\u0085日😀\x1c\x00À×÷ß") + ["'ll", "'S", " don't", "  "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    b = bpe.load(path, pattern)
    data, at = T.bytes_of(pa.array(texts))
    ids, cut = b.encode(data, at)
    assert [ids[i:j].tolist() for i, j in zip(cut[:-1], cut[1:])] == [enc.encode_ordinary(t) for t in texts]
    raw, cut = b.decode(ids, cut)
    assert [raw[i:j].tobytes().decode() for i, j in zip(cut[:-1], cut[1:])] == texts


def test_bpe_worker_stays_small(encoding):
    """Two batches of words that hardly repeat: what is remembered and worked with at once stays under 80 MB (128 before)."""
    import tracemalloc

    import pyarrow as pa

    from chronoloom.llm import bpe

    path, pattern, enc = encoding
    bpe.load(path, pattern)
    texts = [" ".join(f"{'abcdefghij'[k % 10]}{np.base_repr(k * 7919 + i * 104729, 36).lower()}" for i in range(200)) for k in range(1200)]
    batches = [pa.record_batch([pa.array(range(600)), pa.array(texts[s : s + 600])], ["doc_id", "text"]) for s in (0, 600)]
    tracemalloc.start()
    try:
        out = [r for x in bpe._report(iter(batches), path, pattern) for r in x.to_pylist()]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [r["ids_sha256"] for r in out[::100]] == [hashlib.sha256(",".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest() for t in texts[::100]]
    assert most < 80e6
    assert bpe.load.cache_info().currsize == 0  # a worker that waits for its next task has no vocabulary


def test_no_python_workers_of_another_kind(spark, sf):
    """The table of sources reaches the plan without a Python RDD, whose workers would stay beside the others."""
    from chronoloom.llm import mixing

    rows = mixing.plan(spark.read.parquet(f"{sf}/documents.parquet"))[2]
    assert "ExistingRDD" not in rows._jdf.queryExecution().toString()


def test_bpe_offsets_and_split_characters(encoding):
    from chronoloom.llm import bpe

    path, pattern, _ = encoding
    b = bpe.load(path, pattern)
    text = "naïve 😀 日本"
    (ids, offsets), = b.encode_offsets([text])
    assert offsets[-1][1] == len(text)
    d = bpe.Decoder(b)
    parts = [d.feed([i]) for i in ids] + [d.feed([], last=True)]
    assert "".join(parts) == text and all("�" not in p for p in parts)


# 6 WARC


def test_warc_round_trip_and_lookup(spark):
    from chronoloom.llm import warc

    big = "<p>" + "x" * 200 + "é"
    rows = [(3, "http://a.example.com/x?b=1", big), (1, "https://A.example.com/x?b=1#f", big), (2, None, "small"), (4, "http://b.org", "small"), (5, "bad url\n[", None), (6, "http://b.org/", ""), (7, "http://a.example.com/x?b=1", big), (None, "http://c.org/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        revisit = html == big and page in (3, 7)
        assert got[page]["record_type"] == ("revisit" if revisit else "response") and got[page]["refers_to"] == (1 if revisit else None)
    folder, captures = warc.write(pages)
    files = warc.build_index(captures, folder, block_lines=2)
    index = warc.Index(folder, files)
    found = [r[1] for r in index.find(warc.url_key("http://a.example.com/x?b=1"))]
    assert sorted(found) == ["1", "3", "7"] and list(index.find("org,nowhere)/")) == []
    assert warc.url_key("https://www.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"
    one = spark.createDataFrame([("http://b.org/",)], "u string")
    assert {r["page_id"] for r in warc.lookup(one, "u", folder, files).collect()} == {4, 6}
    assert warc.round_trip(pages.filter("false")).count() == 0


def test_warc_records_follow_the_format(spark):
    import glob
    import gzip

    from chronoloom.llm import warc

    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(1, "http://a.org/", big), (2, "http://b.org/", big), (3, "http://c.org/", "")], "page_id long, url string, html string")
    folder, captures = warc.write(pages.coalesce(1))
    captures.collect()
    names = glob.glob(folder.removeprefix("file:") + "/*.warc.gz")
    raw = b"".join(gzip.open(n).read() for n in names)
    seen, ids, refers = [], [], []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        seen.append(fields["WARC-Type"])
        ids.append(fields["WARC-Record-ID"])
        refers += [fields["WARC-Refers-To"]] if "WARC-Refers-To" in fields else []
        if seen[-1] == "response":
            assert rest.startswith(b"HTTP/1.1 200 OK\r\n")
        raw = rest[size + 4 :]
    assert sorted(seen) == ["response", "response", "revisit", *["warcinfo"] * len(names)]
    assert len(set(ids)) == len(ids) and refers[0] in ids


def test_warc_keys_with_tabs_and_newlines(spark):
    from chronoloom.llm import warc

    urls = ["a\tb", "a b", "a%09b", "a\nb", "a!b", "a\rb", "a#b", "http://[\t"]
    pages = spark.createDataFrame([(k, u, f"page {k}") for k, u in enumerate(urls)], "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in warc.round_trip(pages).collect()) == list(range(len(urls)))
    folder, captures = warc.write(pages)
    one = spark.createDataFrame([("a b",)], "u string")
    assert [r["page_id"] for r in warc.lookup(one, "u", folder, warc.build_index(captures, folder)).collect()] == [1]


def test_warc_key_over_several_index_files(spark):
    from chronoloom.llm import warc

    pages = spark.createDataFrame([(k, "http://a.org" if k < 30 else "http://b.org", "") for k in range(31)], "page_id long, url string, html string")
    folder, captures = warc.write(pages)
    for _ in range(4):  # files have random names
        index = warc.Index(folder, warc.build_index(captures, folder))
        assert [r[1] for r in index.find("org,b)/")] == ["30"] and len(list(index.find("org,a)/"))) == 30


# 7 language model


def brute_forward(seq, chain, emit):
    a = chain.start * emit[seq[0]]
    total = 0.0
    for x in seq[1:]:
        total += np.log10(a.sum())
        a = (a / a.sum() @ chain.move) * emit[x]
    return total + np.log10(a.sum())


def test_forward_is_exact_and_training_raises_the_likelihood():
    from chronoloom.llm import hmm

    rng = np.random.default_rng(1)
    chain = hmm.Chain(100, 8)
    emit = rng.random((8, hmm.STATES))
    emit /= emit.sum(0)
    count = np.array([5, 1, 9, 3])
    seq = rng.integers(0, 8, 18)
    at = np.cumsum(count) - count
    want = [brute_forward(seq[s : s + n], chain, emit) for s, n in zip(at, count)]
    assert np.allclose(hmm.forward(seq, count, chain, emit), want)
    assert hmm.expected(seq, count, chain, emit)[3] == pytest.approx(sum(want), rel=1e-5)
    train, sizes = np.concatenate([np.tile([0, 1], 50), np.tile([6, 7], 50)]), np.array([100, 100])
    before = hmm.forward(train, sizes, chain, emit).sum()
    for _ in range(5):
        s, t, e, _ = hmm.expected(train, sizes, chain, emit)
        assert s.sum() == pytest.approx(2, rel=1e-3) and e.sum() == pytest.approx(200, rel=1e-3) and t.sum() == pytest.approx(198, rel=1e-3)
        chain.update(s, t, e.sum(0))
        emit = (e + 1e-3) / (e + 1e-3).sum(0)
    assert hmm.forward(train, sizes, chain, emit).sum() > before


def test_expected_counts_of_rare_words_and_long_texts():
    """Against plain double precision, with words too rare for single precision and steps between the scalings that nearly every path dies in."""
    from chronoloom.llm import hmm

    rng = np.random.default_rng(2)
    chain, S = hmm.Chain(10**9, 40), hmm.STATES
    chain.move = np.where(np.eye(S) > 0, 1 - 1e-6, 1e-6 / (S - 1))
    emit = np.full((40, S), 1e-7)
    emit[np.arange(40), rng.integers(0, S, 40)] = 1
    emit *= 10.0 ** -rng.integers(0, 60, 40)[:, None]
    count = np.array([700, 1, 2, 0, 5, 4, 43])
    seq = rng.integers(0, 40, count.sum())
    start, move, counts, likelihood = np.zeros(S), np.zeros((S, S)), np.zeros((40, S)), 0.0
    for x in np.split(seq, np.cumsum(count)[:-1]):
        a, z = [], []
        for k, w in enumerate(x):
            f = (chain.start if k == 0 else a[-1] @ chain.move) * emit[w]
            z.append(f.sum())
            a.append(f / f.sum())
        likelihood += np.log10(z).sum()
        b = np.ones(S)
        for k in range(len(x) - 1, -1, -1):
            counts[x[k]] += a[k] * b
            if k:
                move += np.outer(a[k - 1], emit[x[k]] * b / z[k]) * chain.move
                b = chain.move @ (emit[x[k]] * b / z[k])
            else:
                start += a[k] * b
    got = hmm.expected(seq, count, chain, emit)
    assert got[3] == pytest.approx(likelihood, rel=1e-5)
    for mine, want in zip(got, (start, move, counts)):
        assert np.allclose(mine, want, rtol=1e-3, atol=1e-3)


def test_language_model_against_a_plain_one(spark, sf):
    """The whole of it without chunks, buckets or packing: one array of words, double precision."""
    from chronoloom.llm import _text as T
    from chronoloom.llm import hmm

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120).collect()
    texts = {r["doc_id"]: [*words(fold(r["text"])), None] for r in rows}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 7 == 2}
    number = {}
    for d, w in texts.items():
        for x in w:
            number.setdefault(x, len(number))
    total = np.bincount([number[x] for d, w in texts.items() if d not in held for x in w], minlength=len(number))
    n, v = int(total.sum()), int((total > 0).sum())
    raws = [(x or "").encode() for x in number]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raws])])
    h = T.hashes(np.frombuffer(b"".join(raws), np.uint8), at[:-1], at[1:])
    h[list(number).index(None)] = hmm.END[0]
    r, S = hmm.first_shares(h), hmm.STATES
    start, move, mass = np.full(S, 1 / S), np.where(np.eye(S) > 0, 0.98, 0.02 / (S - 1)), np.full(S, n / S)
    before = -np.inf

    def emissions():
        return np.where(total[:, None] > 0, n / (n + v + 1) * total[:, None] * (r + hmm.SMOOTH / n) / (mass + hmm.SMOOTH), (v + 1) / (n + v + 1))

    while True:
        e, like = emissions(), 0.0
        c0, c1, c2 = np.zeros(S), np.zeros((S, S)), np.zeros((len(number), S))
        for d, w in texts.items():
            if d in held:
                continue
            x = [number[y] for y in w]
            a, z = [], []
            for k, y in enumerate(x):
                f = (start if k == 0 else a[-1] @ move) * e[y]
                z.append(f.sum())
                a.append(f / f.sum())
            like += np.log10(z).sum()
            b = np.ones(S)
            for k in range(len(x) - 1, -1, -1):
                c2[x[k]] += a[k] * b
                if k:
                    c1 += np.outer(a[k - 1], e[x[k]] * b / z[k]) * move
                    b = move @ (e[x[k]] * b / z[k])
            c0 += a[0] * b
        if like - before < hmm.TOLERANCE * abs(like):
            break
        before = like
        whole = c2.sum(1, keepdims=True)
        r = np.divide(c2, whole, out=np.zeros_like(c2), where=whole > 0)
        start, move, mass = (c0 + 1) / (c0 + 1).sum(), (c1 + 1) / (c1 + 1).sum(1, keepdims=True), c2.sum(0)
    e = emissions()
    chain = hmm.Chain(n, v)
    chain.start, chain.move = start, move
    out = {x["doc_id"]: x["score"] for x in hmm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for d, w in texts.items():
        assert out[d] == pytest.approx(brute_forward([number[x] for x in w], chain, e), rel=2e-3)


def test_language_model(spark, sf, odd, none):
    from chronoloom.llm import hmm

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = hmm.score(docs).toPandas().set_index("doc_id")
    rows = docs.select("doc_id", "text").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows}
    from collections import Counter

    c = Counter()
    for r in rows:
        if not held[r["doc_id"]]:
            c.update([*words(fold(r["text"])), None])
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = [*words(fold(r["text"])), None]
        x = out.loc[r["doc_id"]]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[t] > 0 for t in w), n)
        assert x["base_score"] == pytest.approx(sum(np.log10((c[t] + 1) / (n + v + 1)) for t in w), rel=1e-9)
    assert np.isfinite(out["score"]).all() and (out["score"] < 0).all()
    mine = out[out["held_out"]]
    assert mine["score"].sum() > mine["base_score"].sum()
    strange = hmm.score(odd)
    assert strange.count() == len(ROWS) and strange.filter("doc_id in (2, 3, 4) and n_tokens <> 1").count() == 0
    assert hmm.score(none).count() == 0


def test_squeeze():
    from chronoloom.llm.hmm import squeeze, squeeze_counts, squeeze_shares, unsqueeze, unsqueeze_counts, unsqueeze_shares

    for x in (np.arange(1000, dtype=np.uint32), np.zeros(0, np.uint16), np.array([2**63], np.uint64)):
        assert (unsqueeze(squeeze(x), x.dtype.type) == x).all()
    c = np.random.default_rng(0).gamma(0.1, 1e4, (50, 6))
    assert np.allclose(unsqueeze_counts(squeeze_counts(c)), c, rtol=1e-4)
    r = c / c.sum(1, keepdims=True)
    assert np.abs(unsqueeze_shares(squeeze_shares(r)) - r).max() < 1e-5


# 8 embedding near-dedup


def test_itq_plan_misses_as_planned():
    from chronoloom.llm import itq

    rng = np.random.default_rng(4)
    for n in (500, 10_000, 100_000):
        width, count = itq.plan(n, 256, 0.9)
        tables = itq.substrings(256, width, count)
        differ = rng.random((100_000, 256)) < np.arccos(0.9) / np.pi
        missed = np.ones(len(differ), bool)
        for t in tables:
            missed[missed] = differ[missed][:, t].any(axis=1)
        assert missed.mean() < 2.5e-4
    assert all(1 <= itq.plan(n, 4 * d, 0.9)[0] <= 4 * d for d in (1, 2, 3, 8) for n in (2, 1_000_000))


def test_itq_against_brute_force(spark):
    from chronoloom.llm import itq

    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, base[:20] + 0.1 * rng.standard_normal((20, 32)), base[:5] + 0.12 * rng.standard_normal((5, 32)), base[7:9], base[7:8]])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("inf")] * 32), (903, []), (None, base[0].tolist())]
    out = {r["vec_id"]: r for r in itq.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit(1))).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        root = [min([root[i], *[root[j] for j in np.flatnonzero(link[i])]]) for i in range(len(x))]
    for k in range(len(x)):
        assert (out[k]["n_links"], out[k]["component_id"], out[k]["kept"]) == (int(link[k].sum()), root[k], root[k] == k)
    for k in (900, 901, 902, 903):
        assert (out[k]["n_links"], out[k]["component_id"], out[k]["kept"]) == (0, k, True)
    assert out[None]["n_links"] == 0 and out[None]["kept"]
    assert itq.links(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_itq_of_extreme_vectors_and_two_lengths(spark):
    from chronoloom.llm import itq

    rng = np.random.default_rng(10)
    x = rng.standard_normal((90, 8))
    pairs = [[1e200] * 8, [1e200] * 7 + [1.01e200], [1e-200] * 8, [-1e-310] * 8, [1.0, 2.0], [1.1, 2.0], [1.0, -2.0]]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100 + k, v) for k, v in enumerate(pairs)]
    out = {r["vec_id"]: r for r in itq.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out[100]["n_links"] >= 2 and out[101]["component_id"] == out[100]["component_id"] == out[102]["component_id"]
    assert out[103]["component_id"] != out[100]["component_id"]
    assert (out[104]["n_links"], out[105]["component_id"], out[106]["n_links"]) == (1, 104, 0)


def test_itq_index_of_long_vectors_is_small_and_misses_as_planned():
    from chronoloom.llm import itq

    rng = np.random.default_rng(5)
    x = rng.standard_normal((5_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)  # at the threshold
    turns = itq.rotations(64)
    same = itq.strongest(x, turns) == itq.strongest(y, turns)
    for n, most in ((50_000, 60), (14_000_000, 200)):  # substrings of bits: 181 and 1,354
        _, tables = itq.index(n, 64, 256, 0.9)
        assert len(tables) <= most
        assert 1 - np.any([same[:, t].all(axis=1) for t in tables], axis=0).mean() < 7e-4


def test_itq_rounds_of_tables_and_crowded_buckets(spark, monkeypatch):
    from chronoloom.llm import itq

    monkeypatch.setattr(itq, "HOT_ROWS", 20)
    monkeypatch.setattr(itq, "ROUND_BYTES", 152 * 160 * 40)  # two rounds
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.standard_normal((60, 32)), rng.standard_normal(32) + 0.25 * rng.standard_normal((100, 32))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    out = {r["vec_id"]: r["n_links"] for r in itq.links(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert 1000 < link.sum() < 9900 and out == {k: int(link[k].sum()) for k in range(len(x))}


# 9 line dedup


def brute_lines(rows, least=10):
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    seen = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            seen.setdefault(fold(line.strip(strip)), set()).add((d, t))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (fold(x.strip(strip)) and len(seen[fold(x.strip(strip))]) >= least)]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


def test_line_dedup_against_brute_force(spark, odd, none):
    from chronoloom.llm import linededup

    got = [tuple(r) for r in linededup.report(odd).collect()]
    want = brute_lines([(r[0], r[1]) for r in ROWS])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert linededup.report(none).count() == 0


def test_line_dedup_when_a_run_crosses_partitions(spark):
    from chronoloom.llm import linededup

    rows = [(k, "hot\n" * 3 + f"own {k}\nhot" + ("\nrare" if k < 9 else "\nfull" if k < 20 else "")) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in linededup.report(df).collect()]
    assert sorted(got) == sorted(brute_lines(rows))
    first = linededup.keep_bitmaps(df, min_docs=1, keep_first=True)
    out = linededup.apply(df, first).collect()
    lines = [x for r in out for x in r["text"].split("\n") if x]
    assert sorted(lines) == sorted({"hot", "rare", "full", *[f"own {k}" for k in range(400)]})


def test_line_dedup_keeps_columns(odd):
    from chronoloom.llm import linededup

    out = linededup.apply(odd, linededup.keep_bitmaps(odd))
    assert out.columns == odd.columns and out.count() == len(ROWS)
    assert out.filter("contains(text, 'same line')").count() == 0


# 10 sharding


def test_sharding(spark, sf, odd, none):
    from chronoloom.llm import sharding

    out = sharding.shard(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    for k, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part))) and 0 <= k < 16
    moved = out[out["shard"] != out["grown_shard"]]
    assert (moved["grown_shard"] == 16).all() and len(moved)
    some = sharding.shard(spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 3 = 0")).toPandas().set_index("doc_id")["shard"]
    assert (out.set_index("doc_id").loc[some.index, "shard"] == some).all()
    strange = sharding.shard(odd).toPandas()
    assert len(strange) == len(ROWS)
    for r in ROWS:
        raw = (r[1] or "").encode()
        hit = strange[(strange["size"] == len(raw) + 1) & (strange["text_crc32"] == zlib.crc32(raw))]
        assert len(hit)
    assert sharding.shard(none).count() == 0


def test_sharding_against_plain_python(spark, odd):
    """The descent, draw by draw, and the slots, counted out."""
    import math

    from chronoloom.llm import sharding

    ids = list(range(-3, 300)) + [2**62]
    docs = spark.createDataFrame([(k, f"text {k % 7}") for k in ids] + [(None, None), (5, "text 5")], "doc_id long, text string")

    def all_nodes(m):
        return [m, *[x for c in m.children for x in all_nodes(c)]]

    children = {c.name for m in (sharding.tree(16, grown=1),) for c in all_nodes(m)}
    keys = spark.createDataFrame([(str(k), c) for k in [*ids, "null"] for c in children], "key string, child string")
    u = {(r["key"], r["child"]): ((r["h"] % 2**64 >> 11) + 0.5) * 2.0**-53 for r in keys.select("key", "child", F.xxhash64("key", "child").alias("h")).collect()}

    def descend(key, node):
        while node.children:
            node = min(node.children, key=lambda c: (-math.log(u[key, c.name]) / c.total, c.name))
        return node.shard

    rows = sharding.shard(docs).collect()
    assert len(rows) == len(ids) + 2
    slots = {}
    for r in rows:
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"], r["law"]) == (descend(key, sharding.tree(16)), descend(key, sharding.tree(16, grown=1)), "key")
        raw = b"" if r["doc_id"] is None else f"text {r['doc_id'] % 7}".encode()
        if not (r["doc_id"] == 5 and r["text_crc32"] == zlib.crc32(b"text 5")):
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_tree_moves_only_into_what_grows(spark):
    from chronoloom.llm.sharding import Node, assign

    def root(w):
        return Node("t", 0, tuple(Node(f"r{a}", 0, tuple(Node(f"r{a}/s{b}", w if (a, b) == (1, 2) else 1.0, (), 4 * a + b) for b in range(4))) for a in range(3)))

    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    both = assign(assign(ids, root(1.0)), root(3.0), to="after").toPandas()
    moved = both[both["shard"] != both["after"]]
    # rows move between regions only into the one that grew, within it only to the shard that grew or from outside
    assert (moved["after"] // 4 == 1).all()
    inside = moved[moved["shard"] // 4 == 1]
    assert (inside["after"] == 6).all()
    share = (both["after"] == 6).mean()
    assert abs(share - 3 / 14) < 0.02


# components


def test_components(spark):
    from chronoloom.llm._spark import components

    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


# pipeline


def test_pipeline_stage_by_stage(spark, odd, none, labels, tmp_path):
    import corpus_pipeline as P

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        here = docs
        for k, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, here, str(tmp_path))
            path = str(tmp_path / f"{name}-{docs is odd}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
            if k < len(P.STAGES) - 1:
                assert out.columns == docs.columns
            here = out
        assert docs is odd or here.count() == 0


def test_pipeline_against_brute_force(spark, sf, encoding):
    import corpus_pipeline as P

    from chronoloom.llm import quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(P.STAGES)
    good = stages["quality"](spark, docs, sf)
    scored = quality.report(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r[0] for r in good.select("doc_id").collect()} == {r["doc_id"] for r in scored.filter("predicted = 1").collect()}
    lines = stages["line_dedup"](spark, good, sf)
    want = {d: sha for d, _, _, sha in brute_lines([(r["doc_id"], r["text"]) for r in good.collect()])}
    rows = lines.collect()
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    one = stages["near_dedup"](spark, lines, sf)
    kept = {d for d, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in rows]).items() if d == c}
    assert {r[0] for r in one.select("doc_id").collect()} == kept
    mixed = stages["mixing"](spark, one, sf).collect()
    assert max(np.unique([r["doc_id"] for r in mixed], return_counts=True)[1]) <= 2
    total = sum(len(words(r["text"])) for r in one.collect())
    assert sum(len(words(r["text"])) for r in mixed) == pytest.approx(1.5 * total, rel=0.1)
    enc = encoding[2]
    out = P.run(spark, sf).collect()
    ids = [enc.encode_ordinary(r["text"]) for r in mixed]
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in out) == sorted((r["doc_id"], hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for r, i in zip(mixed, ids))


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_words_that_polynomials_confuse(spark, encoding, n):
    from chronoloom.llm import bpe, hmm, linededup, minhash

    one, two = thue_morse(n)
    docs = spark.createDataFrame([(k, (one, two)[k % 2]) for k in range(10)], "doc_id long, text string")
    path, pattern, enc = encoding
    for r in bpe.report(docs, path, pattern).collect():
        ids = enc.encode_ordinary((one, two)[r["doc_id"] % 2])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((one, two)[r["doc_id"] % 2].encode()).hexdigest()
    assert {r["n_dropped"] for r in linededup.report(docs, min_docs=10).collect()} == {0}
    assert {r["n_dropped"] for r in linededup.report(docs, min_docs=5).collect()} == {1}
    assert {(r["doc_id"], r["component_id"]) for r in minhash.report(docs).collect()} == {(k, k % 2) for k in range(10)}
    base = {r["doc_id"]: (r["train_tokens"], r["base_score"]) for r in hmm.score(docs, F.lit(False)).collect()}
    assert all(t == 20 and b == pytest.approx(np.log10(6 / 24) + np.log10(11 / 24)) for t, b in base.values())


def test_pieces_of_one_hash_stay_apart(encoding, monkeypatch):
    import pyarrow as pa

    from chronoloom.llm import _text as T
    from chronoloom.llm import bpe

    path, pattern, enc = encoding
    monkeypatch.setattr(T, "hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    texts = ["some words and some more words", "été 日本, words", ""]
    data, at = T.bytes_of(pa.array(texts))
    ids, cut = bpe.Bpe(path, pattern).encode(data, at)
    assert [ids[i:j].tolist() for i, j in zip(cut[:-1], cut[1:])] == [enc.encode_ordinary(t) for t in texts]


def test_line_that_fills_few_documents(spark, monkeypatch):
    from chronoloom.llm import linededup

    monkeypatch.setattr(linededup, "HELD_ROWS", 5)
    docs = spark.createDataFrame([(k, "again\n" * 3000 + f"own {k}") for k in range(4)] + [(9, "z\nagain")], "doc_id long, text string").coalesce(1)
    for least, lost in ((5, True), (6, False)):
        got = {r["doc_id"]: r["n_dropped"] for r in linededup.report(docs, min_docs=least).collect()}
        assert got == {k: (3000 if k < 9 else 1) * lost for k in (0, 1, 2, 3, 9)}
