"""Annotating documents: one Arrow pass a document makes all tags that need the text.

Tags are rows (doc_id, name, begin, end, seq, attrs). `seq` is the order of insertion
and, with begin and end, the order of tags: begin up, end down, nothing without extent
first. All that follows (links, comparison, evaluation) joins these rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import english as E
from ..functions import links as L
from ..functions import timex as X

TAGS = "doc_id long, name string, begin int, end int, seq int, attrs map<string,string>"
_TYPES = pa.schema([("doc_id", pa.int64()), ("name", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("seq", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string()))])

STAGES = ("DOCSTRUCTURE", "TOKENIZER", "TAGGER", "CHUNKER", "GUTIME", "EVITA", "SLINKET")


def annotate_text(text: str | None, dct=None, stages: tuple[str, ...] = STAGES) -> list[tuple[str, int | None, int | None, dict[str, str]]]:  # noqa: ANN001, C901
    """Tags of one text, in order of insertion."""
    text = text or ""
    tags: list[tuple[str, int | None, int | None, dict[str, str]]] = []
    elements = E.paragraphs(text)
    if "DOCSTRUCTURE" in stages:
        tags += [("docelement", b, e, {"id": f"d{k}", "type": "paragraph", "origin": "DOCSTRUCTURE"}) for k, (b, e) in enumerate(elements, 1)]
    n = dict.fromkeys("slct", 0) | {"e": 0, "k": 0}

    def number(kind: str) -> str:
        n[kind] += 1
        return f"{kind}{n[kind]}"

    for b, e in elements:
        part = text[b:e]
        tokens = E.tokenize(part) if "TOKENIZER" in stages else []
        if "TAGGER" in stages:
            E.tag(tokens)
        times = X.find(part, dct) if "GUTIME" in stages else []
        sentences: dict[int, list[E.Token]] = {}
        for t in tokens:
            sentences.setdefault(t.sentence, []).append(t)
        for s in sentences.values():
            tags.append(("s", b + s[0].begin, b + s[-1].end, {"id": number("s"), "origin": "PREPROCESSOR"}))
            for k, t in enumerate(s, n["l"] + 1):
                attrs = {"id": f"l{k}", "text": t.text, "origin": "PREPROCESSOR"}
                if t.pos:
                    attrs["pos"], attrs["lemma"] = t.pos, t.lemma
                tags.append(("lex", b + t.begin, b + t.end, attrs))
            n["l"] += len(s)
        for x in times:
            tags.append(("TIMEX3", b + x.begin, b + x.end, {"tid": number("t"), "type": x.type, "origin": "GUTIME"} | ({"value": x.value} if x.value is not None else {}) | x.attrs))
        if "CHUNKER" not in stages:
            continue
        for s in sentences.values():
            groups = E.chunks(s)
            # chunks that cross a time expression make way for one around it
            inside = [x for x in times if x.begin >= s[0].begin and x.end <= s[-1].end]
            cross = lambda g: any(not (s[g[1]].begin >= x.end or s[g[2] - 1].end <= x.begin) and not (s[g[1]].begin <= x.begin and s[g[2] - 1].end >= x.end) for x in inside)  # noqa: B023, E731
            groups = [g for g in groups if not cross(g)]
            covered = [(s[g[1]].begin, s[g[2] - 1].end) for g in groups]
            for x in inside:
                if not any(p <= x.begin and x.end <= q for p, q in covered):
                    where = [i for i, t in enumerate(s) if t.begin >= x.begin and t.end <= x.end]
                    if where:
                        groups.append(("ng", where[0], where[-1] + 1))
            groups.sort(key=lambda g: g[1])
            tags += [(g[0], b + s[g[1]].begin, b + s[g[2] - 1].end, {"id": number("c"), "origin": "PREPROCESSOR"}) for g in groups]
            if "EVITA" not in stages:
                continue
            timed = {i for i, t in enumerate(s) if any(x.begin <= t.begin and t.end <= x.end for x in inside)}
            found = E.events(s, groups, taken=timed)
            ids = {}
            for f in found:
                t = s[f["token"]]
                number("e")
                ids[f["token"]] = f"ei{n['e']}"
                attrs = {"eid": f"e{n['e']}", "eiid": f"ei{n['e']}", "class": f["class"], "tense": f["tense"], "aspect": f["aspect"], "pos": f["pos"], "form": t.text, "epos": f["pos"], "lemma": t.lemma, "origin": "EVITA"}
                tags.append(("EVENT", b + t.begin, b + t.end, attrs | ({"modality": f["modality"]} if f["modality"] != "NONE" else {}) | ({"polarity": "NEG"} if f["polarity"] == "NEG" else {})))
            if "SLINKET" in stages and len(found) > 1:
                nodes = _nodes(s, groups, {f["token"]: f for f in found})
                for kind, i, j, relation, pattern in L.links(nodes):
                    a, c = ids[nodes[i]["at"]], ids.get(nodes[j].get("at"))
                    if c and c != a:
                        target = "relatedToEventInstance" if kind == "ALINK" else "subordinatedEventInstance"
                        n["k"] += 1
                        tags.append((kind, None, None, {"lid": f"l{n['k']}", "eventInstanceID": a, target: c, "relType": relation, "syntax": pattern, "origin": "SLINKET"}))
    return tags


def _nodes(s: list[E.Token], groups: list[tuple[str, int, int]], found: dict[int, dict]) -> list[dict]:
    """A sentence as chunks and single tokens, with the features that patterns ask for."""
    out, k = [], 0
    starts = {g[1]: g for g in groups}
    while k < len(s):
        g = starts.get(k)
        e = g[2] if g else k + 1
        head = next((i for i in range(e - 1, k - 1, -1) if i in found), e - 1)
        t, f = s[head], found.get(head)
        row = {"node": g[0] if g else "lex", "text": t.text, "pos": t.pos, "lemma": t.lemma, "at": head}
        if g and g[0] == "vg" and s[k].pos == "TO":
            row["infinitive"] = True
        if f:
            row |= {"event": True, "tense": f["tense"], "aspect": f["aspect"], "class": f["class"], "epos": f["pos"]}
        out.append(row)
        k = e
    return out


def _columns(text: str | None, dct, stages: tuple[str, ...]) -> tuple[tuple, ...]:  # noqa: ANN001
    """The tags of one text by column: names, begins, ends, how many attributes each has, and all their keys and values."""
    tags = annotate_text(text, dct, stages)
    names, begins, ends, attrs = zip(*tags) if tags else ((),) * 4
    return names, begins, ends, tuple(map(len, attrs)), tuple(k for a in attrs for k in a), tuple(v for a in attrs for v in a.values())


#: Short texts come again often; the longest of these takes some kilobytes.
SHORT_TEXT = 120
_columns_short = lru_cache(1 << 11)(_columns)


def _tags(batches: Iterator[pa.RecordBatch], stages: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    def show() -> pa.RecordBatch:
        counts, keys, values = out[3:]
        attrs = pa.MapArray.from_arrays(pa.array(list(accumulate(counts, initial=0)), pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
        columns = [pa.array(ids, pa.int64()), *[pa.array(c, _TYPES.field(k).type) for c, k in zip(out, ("name", "begin", "end"))], pa.array(seqs, pa.int32()), attrs]
        return pa.RecordBatch.from_arrays(columns, schema=_TYPES)

    for b in batches:
        ids, seqs, out = [], [], ([], [], [], [], [], [])
        for doc_id, text, dct in zip(*[c.to_pylist() for c in b.columns]):
            made = (_columns_short if text and len(text) <= SHORT_TEXT else _columns)(text, dct, stages)
            n = len(made[0])
            ids += [doc_id] * n
            seqs += range(n)
            for c, more in zip(out, made):
                c += more
            if len(ids) > 20_000:
                yield show()
                ids, seqs, out = [], [], ([], [], [], [], [], [])
        if ids:
            yield show()


def partitions(df: DataFrame) -> int:
    """How many partitions keep all cores busy, even with rows of few bytes; repartitioned into so many, they aren't put together again."""
    s = df.sparkSession
    return max(2 * s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions")))


def spread(docs: DataFrame) -> DataFrame:
    """Documents in partitions enough for all cores: a small table lies in one or two files, which as many tasks would annotate alone."""
    if docs.isStreaming:
        return docs
    plan = docs._jdf.queryExecution().executedPlan()
    # behind a shuffle the number isn't known before it runs, and small results are put together
    if plan.nodeName() != "AdaptiveSparkPlan" and plan.execute().getNumPartitions() >= 2 * docs.sparkSession.sparkContext.defaultParallelism:
        return docs
    return docs.repartition(partitions(docs), "doc_id")


def annotate(docs: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Tags of documents (doc_id, text, dct date)."""
    return spread(docs.select("doc_id", "text", F.col("dct").cast("date"))).mapInArrow(lambda it: _tags(it, stages), TAGS)


def of(tags: DataFrame, name: str) -> DataFrame:
    """Tags of one name with their attributes still in a map."""
    return tags.filter(F.col("name") == name)


def events(tags: DataFrame) -> DataFrame:
    a = F.col("attrs")
    return of(tags, "EVENT").select("doc_id", "begin", "end", "seq", *[a[k].alias(v) for k, v in (("eiid", "eiid"), ("class", "class"), ("tense", "tense"), ("aspect", "aspect"), ("epos", "epos"), ("form", "form"), ("lemma", "lemma"))], F.coalesce(a["modality"], F.lit("NONE")).alias("modality"), F.coalesce(a["polarity"], F.lit("POS")).alias("polarity"))


def timexes(tags: DataFrame) -> DataFrame:
    a = F.col("attrs")
    return of(tags, "TIMEX3").select("doc_id", "begin", "end", "seq", a["tid"].alias("tid"), a["type"].alias("type"), a["value"].alias("value"))


def links(tags: DataFrame) -> DataFrame:
    """ALINK, SLINK and TLINK rows (doc_id, lid, kind, src, tgt, relation, origin, syntax)."""
    a = F.col("attrs")
    return tags.filter(F.col("name").isin("ALINK", "SLINK", "TLINK")).select(
        "doc_id", a["lid"].alias("lid"), F.col("name").alias("kind"), F.coalesce(a["eventInstanceID"], a["timeID"]).alias("src"),
        F.coalesce(a["relatedToEventInstance"], a["subordinatedEventInstance"], a["relatedToTime"]).alias("tgt"), a["relType"].alias("relation"), a["origin"].alias("origin"), a["syntax"].alias("syntax"), "seq",
    )
