"""Reading documents: text, tagged XML, TTK, LIF, corpora with metadata; and guessing which is which.

Files are read by Spark as whole texts or binaries; each parser is a function over one
document, run in Arrow batches, and gives (text, metadata, source tags, own tags).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = "name string, begin int, end int, attrs map<string,string>"
DOCUMENT = f"file string, text string, metadata map<string,string>, source_tags array<struct<{TAG.replace(' string', ':string').replace(' int', ':int').replace(' map', ':map')}>>, own_tags array<struct<{TAG.replace(' string', ':string').replace(' int', ':int').replace(' map', ':map')}>>, comments map<int,string>, error string"


def guess(text: Column) -> Column:
    """ttk, lif, xml or text, from the first thousand characters."""
    head = F.substring(text, 1, 1000)
    first = F.lower(F.regexp_extract(head, r"<([A-Za-z_][^\s>/]*)[^>]*>", 1))
    return F.when(F.trim(head).startswith("{") & head.contains('"text"'), "lif").when(first == "ttk", "ttk").when(first != "", "xml").otherwise("text")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): the regular files of a folder, without dot files and backups."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.filter(~name.startswith(".") & ~name.endswith("~")).select(name.alias("file"), F.decode("content", "UTF-8").alias("content"))


class _Sax:
    """Text with the offsets of tags, by code points."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.at = 0
        self.tags: list[dict] = []
        self.stack: list[tuple[str, int, dict, int]] = []
        self.comments: dict[int, str] = {}
        self.instructions: list[tuple[int, str, str]] = []
        self.seen = 0

    def parse(self, content: str) -> None:
        p = expat.ParserCreate("UTF-8")
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler = self.open, self.close
        p.CharacterDataHandler = self.text
        p.CommentHandler = lambda c: self.comments.__setitem__(self.at, self.comments.get(self.at, "") + c)
        p.ProcessingInstructionHandler = lambda target, data: self.instructions.append((self.at, target, data))
        p.Parse(content.encode(), True)

    def text(self, s: str) -> None:
        self.parts.append(s)
        self.at += len(s)

    def open(self, name: str, attrs: dict) -> None:
        self.stack.append((name, self.at, attrs, self.seen))
        self.seen += 1

    def close(self, name: str) -> None:
        opened, begin, attrs, seq = self.stack.pop()
        if opened != name:
            raise ValueError(f"{name} closes {opened}")
        self.tags.append({"name": name, "begin": begin, "end": self.at, "attrs": rename(attrs), "seq": seq})


def rename(attrs: dict[str, str]) -> dict[str, str]:
    """Attributes named like offsets get a number."""
    out = {}
    for k, v in attrs.items():
        name = k
        if k in ("begin", "end"):
            n = 1
            while f"{k}_{n}" in attrs:
                n += 1
            name = f"{k}_{n}"
        out[name] = v
    return out


def parse_xml(content: str) -> dict:
    """Any XML: its text, and all its tags as source tags."""
    s = _Sax()
    s.parse(content)
    tags = sorted(s.tags, key=lambda t: t.pop("seq"))
    return {"text": "".join(s.parts), "metadata": {}, "source_tags": tags, "own_tags": [], "comments": s.comments}


def parse_text(content: str) -> dict:
    return {"text": content, "metadata": {}, "source_tags": [], "own_tags": [], "comments": {}}


def parse_ttk(content: str) -> dict:
    from xml.etree import ElementTree

    root = ElementTree.fromstring(content)
    number = lambda e, k: None if e.get(k) in (None, "", "-1", "None") else int(e.get(k))

    def part(name: str):  # noqa: ANN202
        return next((e for e in root if e.tag == name), [])

    def tags(elements) -> list[dict]:  # noqa: ANN001
        return [{"name": e.tag, "begin": number(e, "begin"), "end": number(e, "end"), "attrs": {k: v for k, v in e.attrib.items() if k not in ("begin", "end")}} for e in elements]

    # the tags made here are in the element after the source's own, whatever its name
    names = [e.tag for e in root]
    after = names.index("source_tags") + 1 if "source_tags" in names else len(names)
    own = root[after] if after < len(names) else []

    meta: dict[str, str] = {}
    for e in root.find("metadata") if root.find("metadata") is not None else []:
        if e.tag == "processing_steps":
            meta["processing_steps"] = json.dumps([s.attrib for s in e])
        else:
            meta[e.tag] = e.get("value") or (e.text or "")
    comments = {int(c.get("offset")): c.text or "" for c in root.iterfind("comments/comment")}
    return {"text": root.findtext("text") or "", "metadata": meta, "source_tags": tags(part("source_tags")), "own_tags": tags(own), "comments": comments}


def parse_lif(content: str) -> dict:
    """A LIF object, bare or in its container; its views' annotations become source tags."""
    o = json.loads(content)
    o = o.get("payload", o) if "discriminator" in o else o
    tags = []
    for view in o.get("views", []):
        for a in view.get("annotations", []):
            kind = str(a.get("@type", "")).rsplit("/", 1)[-1]
            attrs = {"id": a.get("id", ""), "view": view.get("id", "")} | {k: json.dumps(v) if isinstance(v, (dict, list)) else str(v) for k, v in (a.get("features") or {}).items()}
            tags.append({"name": kind, "begin": a.get("start"), "end": a.get("end"), "attrs": attrs})
    return {"text": (o.get("text") or {}).get("@value", ""), "metadata": {k: str(v) for k, v in (o.get("metadata") or {}).items()}, "source_tags": tags, "own_tags": [], "comments": {}}


#: Formats and their parsers; more may be added.
PARSERS = {"text": parse_text, "xml": parse_xml, "ttk": parse_ttk, "lif": parse_lif}


def _kind(content: str) -> str:
    head = content[:1000]
    if head.lstrip().startswith("{") and '"text"' in content:
        return "lif"
    m = re.search(r"<([A-Za-z_][^\s>/]*)[^>]*>", head)
    return "text" if not m else "ttk" if m[1].lower() == "ttk" else "xml"


def _parse(batches: Iterator[pa.RecordBatch], kind: str | None) -> Iterator[pa.RecordBatch]:
    tag = pa.struct([("name", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string()))])
    schema = pa.schema([("file", pa.string()), ("text", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("source_tags", pa.list_(tag)), ("own_tags", pa.list_(tag)), ("comments", pa.map_(pa.int32(), pa.string())), ("error", pa.string())])
    for b in batches:
        rows = []
        for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            content = content or ""
            try:
                d, error = PARSERS.get(kind or _kind(content), parse_xml)(content), None
            except Exception as e:  # noqa: BLE001  a broken document is a row with its error
                d, error = parse_text(content), f"{type(e).__name__}: {e}"
            show = lambda tags: [{**{k: t[k] for k in ("name", "begin", "end")}, "attrs": list(t["attrs"].items())} for t in tags]
            rows.append({"file": name, "text": d["text"], "metadata": list(d["metadata"].items()), "source_tags": show(d["source_tags"]), "own_tags": show(d["own_tags"]), "comments": list(d["comments"].items()), "error": error})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def parse(contents: DataFrame, kind: str | None = None) -> DataFrame:
    """Documents of (file, content) in a format, or in the one each seems to have."""
    return contents.select("file", "content").mapInArrow(lambda it: _parse(it, kind), DOCUMENT)


def stdin(spark: SparkSession, stream=None) -> DataFrame:  # noqa: ANN001
    """One document from a pipe, (file, content)."""
    import sys

    return spark.createDataFrame([("stdin", (stream or sys.stdin).read())], "file string, content string")


def processing_steps(own: Column, source: Column) -> Column:
    """The history of a document: the steps that its source brings, then its own."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(source, none), F.coalesce(own, none))


# Creation times


def date_tag_creation_time(tags: DataFrame) -> DataFrame:
    """The value of a document's first DATE tag: doc_id, dct."""
    t = tags.filter(F.col("name") == "DATE")
    return t.groupBy("doc_id").agg(F.min_by(F.col("attrs")["value"], "seq").alias("dct"))


def first_tag_text(text: Column, tags: Column, name: str) -> Column:
    """The text of the first source tag of a name, stripped; null without one."""
    t = F.try_element_at(F.filter(tags, lambda x: x["name"] == name), F.lit(1))
    return F.trim(F.substring(text, t["begin"] + 1, t["end"] - t["begin"]))


def timebank_dct(docno: Column, fileid: Column, date_time: Column, pubdate: Column) -> Column:
    """Creation time as YYYYMMDD from the identifiers of news texts; the order of the prefixes counts."""
    d = F.trim(docno)
    slash = lambda s: F.concat(F.regexp_extract(s, r"(\d{1,2})/(\d{1,2})/(\d{4})", 3), F.lpad(F.regexp_extract(s, r"(\d{1,2})/(\d{1,2})/(\d{4})", 1), 2, "0"), F.lpad(F.regexp_extract(s, r"(\d{1,2})/(\d{1,2})/(\d{4})", 2), 2, "0"))
    return (
        F.when(d.rlike("^(ABC|CNN|PRI|VOA)"), F.substring(d, 4, 8))
        .when(d.startswith("APW"), F.substring(d, 4, 8))
        .when(d.startswith("AP"), F.concat(F.lit("19"), F.substring(d, 3, 6)))
        .when(d.startswith("NYT"), F.substring(d, 4, 8))
        .when(d.startswith("SJMN"), F.concat(F.lit("19"), F.substring(F.trim(pubdate), 1, 6)))
        .when(d.startswith("WSJ"), F.concat(F.lit("19"), F.substring(d, 4, 6)))
        .when(d.startswith("ea") | d.startswith("ed"), F.concat(F.lit("19"), F.substring(d, 3, 6)))
        .when(d.startswith("wsj"), F.coalesce(F.nullif(slash(date_time), F.lit("")), F.concat(F.lit("19"), F.regexp_extract(fileid, r"(\d{6})", 1))))
    )


def creation_time(candidates: list[Column], today: Column) -> tuple[Column, Column]:
    """(the first creation time there is, whether candidates disagree); today's date without any."""
    seen = F.array_distinct(F.array_compact(F.array(*candidates)))
    return F.coalesce(*candidates, F.date_format(today, "yyyyMMdd")), F.size(seen) > 1


def timex_creation_time(tags: DataFrame) -> DataFrame:
    """Values of times that say they are the creation time: doc_id, dct."""
    return tags.filter((F.col("name") == "TIMEX3") & (F.col("attrs")["functionInDocument"] == "CREATION_TIME")).groupBy("doc_id").agg(F.min_by(F.col("attrs")["value"], "seq").alias("dct"))


def with_lookup(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Creation times from a table (filename, dct), by the name of the file; the table may be of any size."""
    return docs.join(table.select(F.col("filename").alias("file"), F.col("dct").alias("lookup_dct")), "file", "left")


def read_config(text: str) -> dict[str, str]:
    """`key = value` lines; # begins a comment."""
    pairs = (line.split("#")[0].split("=", 1) for line in text.splitlines())
    return {p[0].strip(): p[1].strip() for p in pairs if len(p) == 2}


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, n, begin, end): parts between blank lines; offsets are code points."""

    @F.udf("array<struct<begin:int,end:int>>", useArrow=True)
    def spans(text):  # noqa: ANN001, ANN202
        from ..functions.english import paragraphs as find

        return [{"begin": b, "end": e} for b, e in find(text or "")]

    return docs.select("doc_id", F.posexplode(spans("text")).alias("n", "p")).select("doc_id", (F.col("n") + 1).alias("n"), "p.begin", "p.end")
