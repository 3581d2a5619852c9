"""Writing documents: TTK, LIF, HTML, Knowtator XML, vectors and plain text; every writer makes a string column."""

from __future__ import annotations

import json
from collections.abc import Callable
from html import escape
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.annotate import partitions

VOCABULARY = "http://vocab.lappsgrid.org/"
LIF_TYPES = {"docelement": "Paragraph", "s": "Sentence", "lex": "Token", "ng": "NounChunk", "vg": "VerbChunk", "EVENT": "Event", "TIMEX3": "TimeExpression", "TLINK": "TemporalRelation"}


def quoted(s: Column) -> Column:
    """An attribute's value for XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def ttk_tag(name: Column, begin: Column, end: Column, attrs: Column) -> Column:
    """One tag: offsets if it has any, then its attributes by name; null ones are left out."""
    items = F.filter(F.array_sort(F.map_entries(attrs)), lambda x: x["value"].isNotNull())
    shown = F.array_join(F.transform(items, lambda x: F.concat(F.lit(" "), x["key"], F.lit('="'), quoted(x["value"]), F.lit('"'))), "")
    place = F.when(begin.isNotNull(), F.concat(F.lit(' begin="'), begin.cast("string"), F.lit('" end="'), end.cast("string"), F.lit('"'))).otherwise("")
    return F.concat(F.lit("  <"), name, place, shown, F.lit(" />"))


def ttk_body(tags: DataFrame) -> DataFrame:
    """(doc_id, body): a document's tags in order, a line each."""
    line = ttk_tag(F.col("name"), F.col("begin"), F.col("end"), F.col("attrs"))
    key = F.struct(F.coalesce("begin", F.lit(2_147_483_647)).alias("b"), (-F.coalesce("end", F.lit(0))).alias("e"), F.col("seq").alias("s"), line.alias("line"))
    return tags.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["line"]), "\n").alias("body"))


def _beside(docs: DataFrame, tags: DataFrame, gathered: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Documents with what is gathered of their tags: both are hashed alike into partitions that stay as many as they are,
    and never broadcast, as a table of tags is small only while it is compressed."""
    n = partitions(docs)
    return docs.repartition(n, "doc_id").join(gathered(tags.repartition(n, "doc_id")).hint("merge"), "doc_id", "left")


def ttk(docs: DataFrame, source_tags: DataFrame, tags: DataFrame, own: str = "own_tags") -> DataFrame:
    """(doc_id, ttk): docs has doc_id, text, dct, and perhaps comments (map<int,string>) and steps (XML)."""
    d = _beside(_beside(docs, source_tags, lambda t: ttk_body(t).withColumnRenamed("body", "source")), tags, ttk_body)
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    comments = F.lit("")
    if "comments" in docs.columns:
        comments = F.coalesce(F.concat(F.lit("<comments>\n"), F.array_join(F.transform(F.array_sort(F.map_entries("comments")), lambda x: F.concat(F.lit('  <comment offset="'), x["key"].cast("string"), F.lit('">'), quoted(x["value"]), F.lit("</comment>"))), "\n"), F.lit("\n</comments>\n")), F.lit(""))
    steps = F.coalesce(F.col("steps"), F.lit("")) if "steps" in docs.columns else F.lit("")
    return d.select("doc_id", F.concat(F.lit("<ttk>\n<text>"), text, F.lit("</text>\n"), comments, F.lit('<metadata>\n  <dct value="'), F.coalesce(F.col("dct").cast("string"), F.lit("")), F.lit('"/>\n'), steps, F.lit("</metadata>\n<source_tags>\n"), F.coalesce("source", F.lit("")), F.lit(f"\n</source_tags>\n<{own}>\n"), F.coalesce("body", F.lit("")), F.lit(f"\n</{own}>\n</ttk>\n")).alias("ttk"))


def processing_step(version: str, commit: str, timestamp: str, components: list[str]) -> str:
    return f"  <processing_steps>\n    <processing_step ttk_version={quoteattr(version)} git_commit={quoteattr(commit)} timestamp={quoteattr(timestamp)} components={quoteattr(','.join(components))}/>\n  </processing_steps>\n"


def new_view_id(used: list[str]) -> str:
    """The first of v1, v2, ... that no view has."""
    n = 1
    while f"v{n}" in used:
        n += 1
    return f"v{n}"


def lif(content: str | None, text: str, tags: list[dict]) -> str:
    """A LIF object with one more view for our tags, unless it has one; `content`: the object read, or none."""
    o = json.loads(content) if content else {"@context": VOCABULARY + "context-1.0.0.jsonld", "metadata": {}, "text": {"@value": text, "language": "en"}, "views": []}
    inner = o.get("payload", o) if "discriminator" in o else o
    views = inner.setdefault("views", [])
    if any("TTK" in json.dumps(v.get("metadata", {}).get("contains", {})) for v in views):
        return json.dumps(o, ensure_ascii=False)
    annotations = []
    for t in tags:
        if t["name"] in LIF_TYPES:
            a = {"id": t["attrs"].get("id") or t["attrs"].get("tid") or t["attrs"].get("eiid") or t["attrs"].get("lid"), "@type": VOCABULARY + LIF_TYPES[t["name"]], "features": t["attrs"]}
            if t["begin"] is not None:
                a |= {"start": t["begin"], "end": t["end"]}
            annotations.append(a)
    kinds = sorted({a["@type"] for a in annotations})
    views.append({"id": new_view_id([v.get("id") for v in views]), "metadata": {"contains": {k: {"producer": "TTK"} for k in kinds}}, "annotations": annotations})
    return json.dumps(o, ensure_ascii=False)


def _grouped(tags: DataFrame) -> DataFrame:
    return tags.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "begin", "end", F.map_entries("attrs").alias("attrs")))).alias("tags"))


def _written(docs: DataFrame, tags: DataFrame, f, to: str) -> DataFrame:  # noqa: ANN001
    @F.udf("string", useArrow=True)
    def write(text, rows):  # noqa: ANN001, ANN202
        plain = [{"name": r["name"], "begin": r["begin"], "end": r["end"], "attrs": {a["key"]: a["value"] for a in r["attrs"]}} for r in (rows if rows is not None else [])]
        return f(text or "", plain)

    return _beside(docs, tags, _grouped).select("doc_id", write("text", "tags").alias(to))


def lif_documents(docs: DataFrame, tags: DataFrame) -> DataFrame:
    return _written(docs, tags, lambda text, rows: lif(None, text, rows), "lif")


def html(text: str, tags: list[dict]) -> str:
    """Text with events and times marked, and a table of links."""
    marks: dict[int, list[str]] = {}
    ends: dict[int, list[str]] = {}
    for t in tags:
        if t["name"] in ("EVENT", "TIMEX3") and t["begin"] is not None:
            ident = t["attrs"].get("eiid") or t["attrs"].get("tid") or ""
            marks.setdefault(t["begin"], []).append(f'<span class="{t["name"].lower()}" title="{escape(str(t["attrs"].get("value") or t["attrs"].get("class") or ""))}"><sub>{escape(ident)}</sub>')
            ends.setdefault(t["end"], []).append("</span>")
    out = []
    for k, c in enumerate([*text, ""]):
        out += ends.get(k, []) + marks.get(k, []) + ([escape(c)] if c != "\n" else ["<br/>\n"])
    rows = [f"<tr><td>{escape(t['name'])}</td><td>{escape(' '.join(f'{k}={v}' for k, v in sorted(t['attrs'].items())))}</td></tr>" for t in tags if t["name"].endswith("LINK")]
    return f"<html><body><p>{''.join(out)}</p><table>{''.join(rows)}</table></body></html>"


def html_documents(docs: DataFrame, tags: DataFrame) -> DataFrame:
    return _written(docs, tags, html, "html")


def knowtator(text: str, tags: list[dict]) -> str:
    """Spans and classes of a document's tags as annotation XML."""
    out = ["<annotations>"]
    for n, t in enumerate(tags):
        if t["begin"] is None:
            continue
        slots = "".join(f'<stringSlotMention id="S{n}-{k}"><mentionSlot id={quoteattr(k)}/><stringSlotMentionValue value={quoteattr(str(v))}/></stringSlotMention>' for k, v in sorted(t["attrs"].items()))
        refs = "".join(f'<hasSlotMention id="S{n}-{k}"/>' for k in sorted(t["attrs"]))
        out.append(f'<annotation><mention id="M{n}"/><span start="{t["begin"]}" end="{t["end"]}"/><spannedText>{escape(text[t["begin"] : t["end"]])}</spannedText></annotation><classMention id="M{n}"><mentionClass id={quoteattr(t["name"])}/>{refs}</classMention>{slots}')
    return "\n".join([*out, "</annotations>"])


def knowtator_documents(docs: DataFrame, tags: DataFrame) -> DataFrame:
    return _written(docs, tags, knowtator, "xml")


# Tokenised text. `tokens`: doc_id, sentence, begin, end, text


def _by_sentence(tokens: DataFrame, shown: Column, between: str) -> DataFrame:
    one = tokens.groupBy("doc_id", "sentence").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", shown.alias("x")))), lambda t: t["x"]), between).alias("x"))
    return one


def _joined(sentences: DataFrame, line: Column, to: str) -> DataFrame:
    return sentences.withColumn("_l", line).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence", "_l"))), lambda s: s["_l"]), "").alias(to))


def sentence_lines(tokens: DataFrame) -> DataFrame:
    """(doc_id, lines): a sentence a line, each token followed by a space."""
    return _joined(_by_sentence(tokens, F.col("text"), " "), F.concat("x", F.lit(" \n")), "lines")


def vertical(tokens: DataFrame) -> DataFrame:
    """(doc_id, lines): <s> before each sentence, then a token a line."""
    return _joined(_by_sentence(tokens, F.col("text"), "\n"), F.concat(F.lit("<s>\n"), "x", F.lit("\n")), "lines")


def token_xml(tokens: DataFrame) -> DataFrame:
    """(doc_id, lines): s elements around lex elements with their offsets."""
    lex = F.concat(F.lit("  <lex begin='"), F.col("begin").cast("string"), F.lit("' end='"), F.col("end").cast("string"), F.lit("'>"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</lex>\n"))
    return _joined(_by_sentence(tokens, lex, ""), F.concat(F.lit("<s>\n"), "x", F.lit("</s>\n")), "lines")


def pairs(tokens: DataFrame) -> DataFrame:
    """Tokens as a tagger takes them, a row each in order: doc_id, n, text, begin, end; <s> without offsets opens each sentence."""
    from pyspark.sql import Window as W

    none = F.lit(None).cast("int")
    opening = tokens.select("doc_id", "sentence").distinct().select("doc_id", "sentence", F.lit("<s>").alias("text"), none.alias("begin"), none.alias("end"))
    both = opening.unionByName(tokens.select("doc_id", "sentence", "text", "begin", "end"))
    return both.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("sentence", F.col("begin").asc_nulls_first()))).select("doc_id", "n", "text", "begin", "end")


def sentence_dump(docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, n, sentence): the text of each sentence, white space made single spaces. docs: doc_id, text; sentences: doc_id, begin, end."""
    from pyspark.sql import Window as W

    s = sentences.select("doc_id", "begin", "end").withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("begin")))
    return s.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "n", F.regexp_replace(F.trim(F.substring(F.col("text"), F.col("begin") + 1, F.col("end") - F.col("begin"))), r"\s+", " ").alias("sentence"))


def source_text(docs: DataFrame) -> DataFrame:
    """(doc_id, value): what a document's text file holds."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write the only string column of a table, a row a line: vectors, dumps, logs."""
    lines.write.mode("errorifexists").text(path)
