"""From other annotation formats to the tag table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tags import within

TIMEML = ("EVENT", "TIMEX3", "SIGNAL", "ALINK", "SLINK", "TLINK", "MAKEINSTANCE")


def from_timebank(source: DataFrame) -> DataFrame:
    """TimeML source tags as own tags, each EVENT with the attributes of one of its instances (the first).

    Instances themselves are dropped, and so are link ends' instances that don't exist.
    """
    t = source.filter(F.col("name").isin(*TIMEML))
    instance = t.filter(F.col("name") == "MAKEINSTANCE").groupBy("doc_id", F.col("attrs")["eventID"].alias("eid")).agg(F.min_by("attrs", "seq").alias("more"))
    events = t.filter(F.col("name") == "EVENT").withColumn("eid", F.col("attrs")["eid"]).join(instance, ["doc_id", "eid"], "left")
    own = F.map_filter(F.coalesce("more", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys("attrs"), k) & (k != "eventID"))
    events = events.withColumn("attrs", F.map_concat("attrs", own)).select(*source.columns)
    return events.unionByName(t.filter(~F.col("name").isin("EVENT", "MAKEINSTANCE")))


def from_thyme(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events and times, links) from entities (doc_id, id, span, type, properties) and relations (doc_id, id, type, properties).

    Spans of several parts are left out; DOCTIME gives the creation time as time t0, and every event is linked to it
    as its DocTimeRel says.
    """
    e = entities.filter(~F.col("span").contains(";")).withColumn("begin", F.split("span", ",")[0].cast("int")).withColumn("end", F.split("span", ",")[1].cast("int"))
    tags = e.filter(F.col("type").isin("EVENT", "TIMEX3", "SECTIONTIME", "DOCTIME")).select("doc_id", F.when(F.col("type") == "EVENT", "EVENT").otherwise("TIMEX3").alias("name"), "begin", "end", F.col("id"), "properties")
    p = F.col("properties")
    links = relations.filter(F.col("type").isin("TLINK", "ALINK")).select("doc_id", F.col("type").alias("kind"), p["Source"].alias("src"), p["Target"].alias("tgt"), F.upper(p["Type"]).alias("relation"))
    known = tags.select("doc_id", "id")
    links = links.join(known.withColumnRenamed("id", "src"), ["doc_id", "src"], "left_semi").join(known.withColumnRenamed("id", "tgt"), ["doc_id", "tgt"], "left_semi")
    to_doc = e.filter((F.col("type") == "EVENT") & p["DocTimeRel"].isNotNull()).select("doc_id", F.lit("TLINK").alias("kind"), F.col("id").alias("src"), F.lit("t0").alias("tgt"), F.regexp_replace(F.upper(p["DocTimeRel"]), "/", "_").alias("relation"))
    return tags, links.unionByName(to_doc)


def from_knowtator(annotations: DataFrame, classes: DataFrame, slots: DataFrame) -> DataFrame:
    """Tags from annotation (doc_id, mention, begin, end), classMention (doc_id, mention, name, slot ids) and slotMention (doc_id, slot, key, value)."""
    values = classes.select("doc_id", "mention", F.explode_outer("slots").alias("slot")).join(slots, ["doc_id", "slot"], "left")
    values = values.filter("key is not null").groupBy("doc_id", "mention").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value")))).alias("attrs"))
    return annotations.join(classes.drop("slots"), ["doc_id", "mention"]).join(values, ["doc_id", "mention"], "left").select("doc_id", "name", "begin", "end", F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"))


def from_ecb(documents: DataFrame) -> DataFrame:
    """Documents of ECB files: the topic is the folder's name and becomes metadata (and a partition when written)."""
    parts = F.split("path", "/")
    return documents.withColumn("topic", F.element_at(parts, -2)).withColumn("file", F.element_at(parts, -1)).withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("topic"), F.col("topic"))))


def import_events(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """Known events laid over chunks: an event counts for the chunk that it ends with, if it covers at least the head.

    chunks: doc_id, begin, end, head_begin; events: doc_id, begin, end, class. Where several fit the last one counts.
    """
    found = within(chunks.select("doc_id", "begin", "end", "head_begin"), events.withColumnRenamed("class", "event_class"), ["event_class", "begin", "end"], ["begin", "end", "head_begin"])
    found = found.filter((F.col("end") == F.col("o_end")) & (F.col("begin") <= F.col("o_head_begin")))
    return found.groupBy("doc_id", F.col("o_begin").alias("begin"), F.col("o_end").alias("end")).agg(F.max_by("event_class", F.struct("begin", "end")).alias("class"))


def nominal_model(counts: DataFrame) -> DataFrame:
    """Smoothed probabilities that a noun is an event from labelled rows (lemma, feature, event 0 or 1), a row a (lemma, feature)."""
    return counts.groupBy("lemma", "feature").agg(F.count("*").alias("n"), ((F.sum("event") + 0.25) / (F.count("*") + 0.5)).alias("p"))


def classify_nominals(candidates: DataFrame, model: DataFrame, least: int = 2) -> DataFrame:
    """Naive Bayes over the features of each candidate (id, lemma, features array); null where the lemma was seen too rarely.

    The prior is the row of the feature `*`. A prior of (nearly) 0 or 1 decides alone.
    """
    prior = model.filter("feature = '*'").select("lemma", F.col("p").alias("prior"), F.col("n").alias("seen"))
    f = candidates.select("id", "lemma", F.explode_outer("features").alias("feature")).join(model.filter("feature <> '*'").select("lemma", "feature", "p"), ["lemma", "feature"], "left")
    odds = f.groupBy("id", "lemma").agg(F.sum(F.coalesce(F.log("p"), F.lit(0.0))).alias("yes"), F.sum(F.coalesce(F.log(1 - F.col("p")), F.lit(0.0))).alias("no"))
    out = odds.join(prior, "lemma", "left")
    score = (F.log("prior") + F.col("yes")) > (F.log(1 - F.col("prior")) + F.col("no"))
    return out.select("id", F.when(F.col("seen").isNull() | (F.col("seen") < least), None).when(F.col("prior") > 0.99, True).when(F.col("prior") < 0.01, False).otherwise(score).alias("event"))


# Annotation formats of their own


def _elements(content: str, name: str) -> list:
    from xml.etree import ElementTree

    return list(ElementTree.fromstring(content).iter(name))


def parse_thyme(content: str) -> list[dict]:
    """Entities and relations of a clinical annotation file, a row each: kind, id, type, span, properties."""
    rows = []
    for kind in ("entity", "relation"):
        for e in _elements(content, kind):
            props = {c.tag: (c.text or "").strip() for c in e.find("properties")} if e.find("properties") is not None else {}
            rows.append({"kind": kind, "id": (e.findtext("id") or "").strip(), "type": (e.findtext("type") or "").strip(), "span": (e.findtext("span") or "").strip(), "properties": props})
    return rows


def parse_knowtator(content: str) -> list[dict]:
    """Annotations of a Knowtator file, a row each: id, begin, end, class, attributes, relations (relation, id of the other)."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(content)
    strings = {e.get("id"): (e.find("mentionSlot").get("id"), e.find("stringSlotMentionValue").get("value")) for e in root.iter("stringSlotMention")}
    complexes = {e.get("id"): (e.find("mentionSlot").get("id"), e.find("complexSlotMentionValue").get("value")) for e in root.iter("complexSlotMention")}
    classes = {e.get("id"): (e.find("mentionClass").get("id"), [x.get("id") for x in e.iter("hasSlotMention")]) for e in root.iter("classMention")}
    rows = []
    for a in root.iter("annotation"):
        mention, span = a.find("mention").get("id"), a.find("span")
        name, slots = classes.get(mention, ("", []))
        rows.append({"id": mention, "begin": int(span.get("start")), "end": int(span.get("end")), "class": name, "attributes": dict(strings[x] for x in slots if x in strings), "relations": [complexes[x] for x in slots if x in complexes]})
    return rows


_TTK = "doc_id long, name string, begin int, end int, seq int, attrs map<string,string>"


def _converted(it: Iterator[pa.RecordBatch], convert) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    schema = pa.schema([("doc_id", pa.int64()), ("name", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("seq", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string()))])
    for b in it:
        rows = []
        for doc_id, text, content in zip(*[c.to_pylist() for c in b.columns]):
            rows += [{"doc_id": doc_id, "name": n, "begin": s, "end": e, "seq": k, "attrs": list(a.items())} for k, (n, s, e, a) in enumerate(convert(text or "", content or ""))]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def thyme_tags(text: str, content: str) -> list[tuple[str, int | None, int | None, dict]]:
    """TIMEX3, EVENT, TLINK and ALINK tags; the document's time gives every event a TLINK. Discontinuous spans are left out."""
    rows = parse_thyme(content)
    of = lambda *types: [r for t in types for r in rows if r["kind"] == "entity" and r["type"] == t]
    out, dct, times = [], None, set()
    for r in of("DOCTIME", "SECTIONTIME", "TIMEX3"):
        if r["span"].count(",") != 1 or ";" in r["span"]:
            continue
        b, e = map(int, r["span"].split(","))
        attrs = {"tid": r["id"]}
        if r["type"] != "TIMEX3":
            attrs["functionInDocument"] = r["type"]
        if r["type"] == "DOCTIME":
            dct = r["id"]
            parts = text[b:e].split("/")
            if len(parts) == 3 and all(p.isdigit() for p in parts):
                attrs["value"] = f"{int(parts[2]):04d}{int(parts[0]):02d}{int(parts[1]):02d}"
        times.add(r["id"])
        out.append(("TIMEX3", b, e, attrs))
    n = 0
    for r in of("EVENT"):
        if r["span"].count(",") != 1 or ";" in r["span"]:
            continue
        b, e = map(int, r["span"].split(","))
        out.append(("EVENT", b, e, {"eid": r["id"], "eiid": r["id"]}))
        if dct:
            n += 1
            out.append(("TLINK", None, None, {"lid": f"l{n}", "relType": r["properties"].get("DocTimeRel", ""), "eventInstanceID": r["id"], "relatedToTime": dct}))
    for kind in ("ALINK", "TLINK"):
        for r in rows:
            if r["kind"] == "relation" and r["type"] == kind:
                a, z = r["properties"].get("Source", ""), r["properties"].get("Target", "")
                out.append((kind, None, None, {"lid": f"r{r['id'].split('@')[0]}", "timeID" if a in times else "eventInstanceID": a, "relatedToTime" if z in times else "relatedToEventInstance": z, "relType": r["properties"].get("Type", r["properties"].get("RelType", ""))}))
    return out


def knowtator_tags(text: str, content: str) -> list[tuple[str, int | None, int | None, dict]]:
    """EVENT and TIMEX3 tags with their attributes, and a TLINK for each relation."""
    rows = parse_knowtator(content)
    name = {"Event": "EVENT", "Timex3": "TIMEX3"}
    key = lambda r: ("tid" if r["class"] == "Timex3" else "eiid", r["attributes"].get("tid" if r["class"] == "Timex3" else "eiid", r["id"]))
    by = {r["id"]: r for r in rows}
    out = []
    for r in rows:
        k, v = key(r)
        out.append((name.get(r["class"], r["class"]), r["begin"], r["end"], {k: v} | r["attributes"]))
        for relation, other in r["relations"]:
            if other in by:
                t, w = key(by[other])
                out.append(("TLINK", None, None, {"relType": relation, "timeID" if k == "tid" else "eventInstanceID": v, "relatedToTime" if t == "tid" else "relatedToEventInstance": w}))
    return out


def read_thyme(docs: DataFrame) -> DataFrame:
    """Tags of (doc_id, text, content), content being the annotation file."""
    return docs.select(F.col("doc_id").cast("long"), "text", "content").mapInArrow(lambda it: _converted(it, thyme_tags), _TTK)


def read_knowtator(docs: DataFrame) -> DataFrame:
    """Tags of (doc_id, text, content), content being the annotation file."""
    return docs.select(F.col("doc_id").cast("long"), "text", "content").mapInArrow(lambda it: _converted(it, knowtator_tags), _TTK)


def imported_share(events: DataFrame, source: DataFrame) -> DataFrame:
    """How many events of a source are found at their spans: doc_id, given, found, percent."""
    here = events.select("doc_id", "begin", "end").distinct().withColumn("_f", F.lit(1))
    s = source.select("doc_id", "begin", "end").distinct().join(here, ["doc_id", "begin", "end"], "left")
    return s.groupBy("doc_id").agg(F.count("*").alias("given"), F.count("_f").alias("found")).withColumn("percent", 100 * F.col("found") / F.col("given"))
