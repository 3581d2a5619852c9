"""One query an operator over the driver's tables, and SQL that says the same independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import allen, calendar, dates
from ..operators import annotate, closure, convert, evaluate, navigate, tags, tlinks, vectors
from ..sources import readers, writers
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Tag table


@query(f"""WITH {X.EVENTS_SQL} SELECT doc_id, eiid, b AS "begin", 'e' || row_number() OVER (PARTITION BY doc_id ORDER BY b, e DESC, seq) AS eid FROM ev""")
def d01_d09_d10_numbered_in_tag_order(s, d):
    return tags.number(tags.find(X.events(s, d), "EVENT"), "e", "eid").select("doc_id", "eiid", "begin", "eid")


@query(f"""WITH {X.EVENTS_SQL}, el AS (SELECT DISTINCT doc_id, sentence * 100 AS ob, sentence * 100 + 99 AS oe FROM ev)
SELECT ev.doc_id, eiid, ob AS o_begin, oe AS o_end FROM ev JOIN el ON ev.doc_id = el.doc_id AND b >= ob AND e <= oe""")
def d02_p12_tags_within_elements(s, d):
    e = X.events(s, d)
    elements = e.select("doc_id", (F.col("sentence") * 100).alias("begin"), (F.col("sentence") * 100 + 99).alias("end")).distinct()
    return tags.within(elements, e, ["eiid"], ["begin", "end"])


@query(f"WITH {X.EVENTS_SQL} SELECT doc_id, eiid FROM ev WHERE b = 7")
def d03_tags_at_offset(s, d):
    return tags.find_at(X.events(s, d), 7).select("doc_id", "eiid")


@query(f"WITH {X.EVENTS_SQL} SELECT doc_id, arg_min(eiid, seq) AS eiid FROM ev GROUP BY doc_id")
def d04_first_tag(s, d):
    return tags.first_of(X.events(s, d), "EVENT").select("doc_id", "eiid")


@query(f"WITH {X.EVENTS_SQL} SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, 'EVENT' AS name FROM ev UNION ALL SELECT l_orderkey, 'TIMEX3' FROM lineitem) GROUP BY doc_id, name HAVING name <> 'EVENT'")
def d05_add_and_remove_tags(s, d):
    c = ["doc_id", "name", "begin", "end", "seq"]
    both = tags.add(X.events(s, d).select(*c), X.times(s, d).select(*c))
    return tags.remove(both, "EVENT").groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query(f"""WITH {X.EVENTS_SQL}, sp AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(o_orderkey % 997 AS INT) AS b, CAST(o_orderkey % 997 + 3 + o_orderkey % 3 AS INT) AS e FROM orders)
SELECT doc_id, k FROM sp WHERE EXISTS (SELECT 1 FROM ev WHERE ev.doc_id = sp.doc_id AND ev.b = sp.b AND ev.e = sp.e)""")
def d06_has_event_at_span(s, d):
    k = F.col("o_orderkey")
    spans = X.read(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("k"), (k % 997).cast("int").alias("begin"), (k % 997 + 3 + k % 3).cast("int").alias("end"))
    return tags.has_event(spans, X.events(s, d)).select("doc_id", "k")


@query(f"""WITH {X.EVENTS_SQL}, {X.SLINKS_SQL} SELECT sl.doc_id, lid, least(x.b, y.b) AS "begin", greatest(x.e, y.e) AS "end" FROM sl
JOIN ev x ON x.doc_id = sl.doc_id AND x.eiid = src JOIN ev y ON y.doc_id = sl.doc_id AND y.eiid = tgt WHERE least(x.b, y.b) >= 100 AND greatest(x.e, y.e) <= 800""")
def d08_links_within(s, d):
    ends = X.events(s, d).select("doc_id", F.col("eiid").alias("id"), "begin", "end")
    return tags.link_extents(X.slinks(s, d), ends, 100, 800).select("doc_id", "lid", "begin", "end")


@query("SELECT doc_id, substr(text, 6, 10) AS slice FROM documents")
def d13_text_slice(s, d):
    return X.read(s, d, "documents").select("doc_id", tags.text_of(F.col("text"), F.lit(5), F.lit(15)).alias("slice"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 't' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'ei' || o_orderkey ELSE 'l' || o_orderkey END AS id FROM orders")
def d14_identifier(s, d):
    k = F.col("o_orderkey")
    named = lambda p, m: F.when(k % 3 == m, F.concat(F.lit(p), k))
    return X.read(s, d, "orders").select(k.alias("k"), tags.identifier(named("t", 0), named("ei", 1), F.concat(F.lit("l"), k)).alias("id"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'begin_1,x' ELSE 'begin_1,begin_2,x' END AS names FROM orders")
def d15_reserved_attributes(s, d):
    k = F.col("o_orderkey")
    m = F.map_concat(F.create_map(F.lit("begin"), F.lit("1"), F.lit("x"), F.lit("2")), F.when(k % 2 == 1, F.create_map(F.lit("begin_1"), F.lit("3"))).otherwise(F.create_map().cast("map<string,string>")))
    return X.read(s, d, "orders").select(k.alias("k"), F.array_join(F.array_sort(F.map_keys(tags.rename_reserved(m))), ",").alias("names"))


_NESTED_SQL = f"""{X.EVENTS_SQL}, ns AS (
  SELECT doc_id, 'docelement' AS name, 0 AS b, 1100 AS e, 5 AS lv, -2 AS seq FROM ev GROUP BY doc_id
  UNION ALL SELECT DISTINCT doc_id, 's', sentence * 100, sentence * 100 + 110, 4, sentence - 1000 FROM ev
  UNION ALL SELECT doc_id, 'EVENT', b, e, 2, seq FROM ev), nn AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b, e DESC, lv DESC, seq) AS INT) AS node FROM ns)"""


def _nested(s, d):
    e = X.events(s, d).select("doc_id", "name", "begin", "end", "seq")
    el = e.select("doc_id").distinct().select("doc_id", F.lit("docelement").alias("name"), F.lit(0).alias("begin"), F.lit(1100).alias("end"), F.lit(-2).alias("seq"))
    n = X.events(s, d).select("doc_id", "sentence").distinct()
    st = n.select("doc_id", F.lit("s").alias("name"), (F.col("sentence") * 100).alias("begin"), (F.col("sentence") * 100 + 110).alias("end"), (F.col("sentence") - 1000).alias("seq"))
    return tags.tree(el.union(st).union(e))


@query(f"""WITH {_NESTED_SQL} SELECT c.doc_id, c.node, c.name, arg_min(p.node, (p.e - p.b, p.lv, p.node)) FILTER (WHERE p.b <= c.b AND p.e >= c.e) AS parent,
coalesce(bool_or(p.b < c.e AND p.e > c.b AND NOT (p.b <= c.b AND p.e >= c.e)), false) AS orphan
FROM nn c LEFT JOIN nn p ON p.doc_id = c.doc_id AND p.lv > c.lv AND p.node <> c.node AND p.b <= c.b AND p.e >= c.b GROUP BY c.doc_id, c.node, c.name""")
def r01_r02_r03_tree_parents(s, d):
    return _nested(s, d).select("doc_id", "node", "name", "parent", "orphan")


@query(f"""WITH {_NESTED_SQL}, pp AS (SELECT c.doc_id, c.node, arg_min(p.node, (p.e - p.b, p.lv, p.node)) FILTER (WHERE p.b <= c.b AND p.e >= c.e) AS parent
FROM nn c LEFT JOIN nn p ON p.doc_id = c.doc_id AND p.lv > c.lv AND p.node <> c.node AND p.b <= c.b AND p.e >= c.b GROUP BY c.doc_id, c.node)
SELECT doc_id, node, CAST(row_number() OVER w - 1 AS INT) AS position, lead(node) OVER w AS next FROM pp WINDOW w AS (PARTITION BY doc_id, parent ORDER BY node)""")
def r04_r09_positions_and_siblings(s, d):
    return tags.children(_nested(s, d)).select("doc_id", "node", "position", "next")


@query(f"""WITH {X.EVENTS_SQL} SELECT a.doc_id, a.eiid AS a, b.eiid AS b, a.b <= b.b AND a.e >= b.e AS includes FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.sentence = b.sentence AND a.eiid <> b.eiid WHERE NOT (a.e < b.b OR b.e < a.b)""")
def r05_includes_and_overlaps(s, d):
    e = X.events(s, d)
    a, b = (e.select("doc_id", "sentence", F.col("eiid").alias(n), F.col("begin").alias(f"{n}b"), F.col("end").alias(f"{n}e")) for n in "ab")
    j = a.join(b, ["doc_id", "sentence"]).filter("a <> b")
    c = [F.col(x) for x in ("ab", "ae", "bb", "be")]
    return j.filter(tags.overlaps(*c)).select("doc_id", "a", "b", tags.includes(*c).alias("includes"))


@query(f"""WITH {X.EVENTS_SQL} SELECT doc_id, eiid FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, b, e ORDER BY new, seq) AS k FROM (SELECT *, 0 AS new FROM ev UNION ALL SELECT doc_id, 'x' || seq, b, e + seq % 2, seq, sentence, tense, aspect, epos, 1 FROM ev)) WHERE k = 1""")
def r11_add_event_unless_there(s, d):
    e = X.events(s, d).select("doc_id", "name", "begin", "end", "seq", "eiid")
    more = e.withColumn("eiid", F.concat(F.lit("x"), "seq")).withColumn("end", (F.col("end") + F.col("seq") % 2).cast("int"))
    return tags.add_events(e, more).select("doc_id", "eiid")


# Walking trees

_TREE_SQL = X.LINES_SQL + ", tk AS (SELECT l_orderkey AS doc_id, CAST(n AS INT) AS n, n % 2 = 1 AND l_partkey % 3 = 0 AS event, l_returnflag || n AS text FROM li)"


def _nodes(s, d, attrs=True):
    return tags.tree(X.trees(s, d) if attrs else X.trees(s, d).drop("attrs"))


@query(f"WITH {_TREE_SQL} SELECT doc_id, n * 10 AS \"begin\", 's-ng' || CASE WHEN event THEN '-EVENT' ELSE '' END || '-lex' AS syntax FROM tk")
def r06_syntax_paths(s, d):
    return navigate.syntax(_nodes(s, d, False)).filter("name = 'lex'").select("doc_id", "begin", "syntax")


@query(f"WITH {_TREE_SQL} SELECT doc_id, CAST(count(*) AS BIGINT) AS leaves FROM tk GROUP BY doc_id")
def r06_leaves(s, d):
    return navigate.leaves(_nodes(s, d, False)).groupBy("doc_id").agg(F.count("*").alias("leaves"))


@query(f"WITH {_TREE_SQL} SELECT doc_id, (n - 1) // 2 * 20 + 10 AS \"begin\", 'e' || n AS eid FROM tk WHERE event")
def r07_embedded_events(s, d):
    t = _nodes(s, d)
    e = navigate.embedded(t, "EVENT").select("doc_id", "node", F.col("attrs")["eid"].alias("eid"))
    return t.join(e, ["doc_id", "node"]).select("doc_id", F.col("begin").cast("long").alias("begin"), "eid")


@query(f"WITH {_TREE_SQL} SELECT doc_id, (n - 1) // 4 AS sentence, string_agg('e' || n, ' ' ORDER BY n) AS events FROM tk WHERE event GROUP BY ALL")
def r08_event_lists(s, d):
    t = _nodes(s, d)
    e = navigate.event_list(t)
    top = t.select("doc_id", F.col("node").alias("top"), ((F.col("begin") / 10 - 1) / 4).cast("int").alias("sentence"))
    return e.join(top, ["doc_id", "top"]).select("doc_id", "sentence", F.array_join(F.transform("events", lambda x: x["eid"]), " ").alias("events"))


@query(f"""WITH {_TREE_SQL}, k AS (SELECT *, lead(event) OVER (PARTITION BY doc_id ORDER BY n) AS nx FROM tk)
SELECT doc_id, n * 10 AS "begin", CASE WHEN nx IS NULL THEN NULL WHEN n % 4 = 0 THEN 's' WHEN n % 2 = 0 THEN 'ng' WHEN nx THEN 'EVENT' ELSE 'lex' END AS name, CASE WHEN nx IS NOT NULL THEN (n + 1) * 10 END AS at FROM k""")
def r09_next_nodes(s, d):
    x = navigate.next_node(_nodes(s, d, False), ["name", "begin"]).filter("name = 'lex'")
    return x.select("doc_id", "begin", F.col("next_name").alias("name"), F.col("next_begin").alias("at"))


@query(f"WITH {_TREE_SQL} SELECT doc_id, (n - 1) // 4 AS sentence, string_agg(text, ' ' ORDER BY n) AS words FROM tk GROUP BY doc_id, (n - 1) // 4")
def r10_words(s, d):
    t = _nodes(s, d)
    top = t.select("doc_id", F.col("node").alias("top"), ((F.col("begin") / 10 - 1) / 4).cast("int").alias("sentence"))
    return navigate.words(t, "s").join(top, ["doc_id", "top"]).select("doc_id", "sentence", F.array_join("words", " ").alias("words"))


@query(f"WITH {_TREE_SQL} SELECT doc_id, CAST(count(*) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE event) AS BIGINT) AS marked FROM tk GROUP BY doc_id")
def r04_event_markers(s, d):
    return navigate.event_markers(_nodes(s, d)).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count("eid").alias("marked"))


_POS = "string_split('JJ JJR NN VBD VBZ VB IN TO RB MD', ' ')[CAST(o_orderkey % 10 + 1 AS INT)]"
_WORD = "string_split('walk was Has run be did say of', ' ')[CAST(o_orderkey % 8 + 1 AS INT)]"


@query(f"""SELECT o_orderkey AS k, CASE WHEN {_POS} IN ('JJ', 'JJR') THEN 'AdjectiveToken' ELSE 'Token' END AS class, {_POS} IN ('VBD', 'VBZ', 'VB') AND {_WORD} IN ('walk', 'run', 'say', 'of') AS main, {_POS} = 'IN' AS preposition FROM orders""")
def r13_r14_token_predicates(s, d):
    k = F.col("o_orderkey")
    pick = lambda ws, m: F.element_at(F.array(*map(F.lit, ws.split())), (k % m + 1).cast("int"))
    pos, word = pick("JJ JJR NN VBD VBZ VB IN TO RB MD", 10), pick("walk was Has run be did say of", 8)
    return X.read(s, d, "orders").select(k.alias("k"), navigate.token_class(pos).alias("class"), navigate.is_main_verb(word, pos).alias("main"), navigate.is_preposition(pos).alias("preposition"))


@query("""WITH x AS (SELECT l_orderkey AS k, list(CASE l_partkey % 4 WHEN 0 THEN ',' WHEN 1 THEN 'RB' WHEN 2 THEN 'RP' ELSE 'VB' END ORDER BY n) AS pos, list(CAST(n AS INT) ORDER BY n) AS items FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS n FROM lineitem) GROUP BY l_orderkey)
SELECT k, array_to_string(CASE WHEN list_contains(pos, ',') THEN list_concat(items[1 : list_position(pos, ',') - 1], items[len(pos) - list_position(list_reverse(pos), ',') + 2 :]) ELSE items END, ' ') AS left_over, NOT list_contains(pos, 'VB') AS adverbs FROM x""")
def r16_r17_sequences(s, d):
    p = F.col("l_partkey") % 4
    tag = F.when(p == 0, ",").when(p == 1, "RB").when(p == 2, "RP").otherwise("VB")
    x = X.lines(s, d).groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("n", tag.alias("pos")))).alias("x"))
    pos, items = F.transform("x", lambda r: r["pos"]), F.transform("x", lambda r: r["n"].cast("int"))
    return x.select("k", F.array_join(navigate.without_interjections(pos, items), " ").alias("left_over"), navigate.adverbs_only(pos).alias("adverbs"))


@query(f"WITH {X.EVENTS_SQL} SELECT doc_id, CAST(count(*) AS BIGINT) AS tags, CAST(max(r) AS INT) AS last FROM (SELECT doc_id, CASE WHEN o THEN seq ELSE m + row_number() OVER (PARTITION BY doc_id, o ORDER BY seq) END AS r FROM (SELECT doc_id, seq, true AS o, 0 AS m FROM ev UNION ALL SELECT doc_id, seq, false, max(seq) OVER (PARTITION BY doc_id) FROM ev WHERE seq % 2 = 0 OR true QUALIFY seq % 2 = 0)) GROUP BY doc_id")
def d07_import_tags(s, d):
    e = X.events(s, d).select("doc_id", "name", "begin", "end", "seq")
    return tags.import_tags(e, e.filter("seq % 2 = 0"), "EVENT").groupBy("doc_id").agg(F.count("*").alias("tags"), F.max("seq").alias("last"))


# Renderers


def _spaced(s, d):
    """Tokens of conversations split at spaces: doc_id, sentence, begin, end, text."""
    c = X.read(s, d, "conversations").filter("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sentence"), F.posexplode(F.split("text", " ")).alias("k", "text"))
    return c.filter("text <> ''").withColumn("begin", F.col("k")).withColumn("end", F.col("k") + F.length("text"))


_SPACED_SQL = "tk AS (SELECT conv_id AS doc_id, turn AS sentence, k, text FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM conversations WHERE text IS NOT NULL) WHERE text <> '')"


@query(f"""WITH {_SPACED_SQL}, l AS (SELECT doc_id, sentence, string_agg(text, ' ' ORDER BY k) AS x, string_agg(text, chr(10) ORDER BY k) AS y FROM tk GROUP BY ALL)
SELECT doc_id, md5(string_agg(x || ' ' || chr(10), '' ORDER BY sentence)) AS lines, md5(string_agg('<s>' || chr(10) || y || chr(10), '' ORDER BY sentence)) AS vertical FROM l GROUP BY doc_id""")
def p07_renderers(s, d):
    t = _spaced(s, d)
    return writers.sentence_lines(t).withColumn("lines", F.md5("lines")).join(writers.vertical(t).select("doc_id", F.md5("lines").alias("vertical")), "doc_id")


@query(f"""WITH {_SPACED_SQL}, b AS (SELECT doc_id, sentence, -1 AS k, '<s>' AS text FROM tk GROUP BY doc_id, sentence UNION ALL SELECT * FROM tk) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sentence, k) AS INT) AS n, text FROM b""")
def p07_pairs(s, d):
    return writers.pairs(_spaced(s, d)).select("doc_id", "n", "text")


@query("SELECT doc_id, coalesce(text, '') AS value FROM documents")
def s25_source_text(s, d):
    return writers.source_text(X.read(s, d, "documents"))


@query("SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS n, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS sentence FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''")
def s21_sentence_dump(s, d):
    c = X.read(s, d, "conversations").filter("text is not null and trim(text) <> ''")
    one = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    docs = one.select("doc_id", F.array_join(F.transform("x", lambda t: t["text"]), "").alias("text"), "x")
    ends = F.expr("transform(x, (t, i) -> aggregate(slice(x, 1, i + 1), 0, (a, y) -> a + length(y.text)))")
    sent = docs.select("doc_id", F.posexplode(F.arrays_zip(F.col("x"), ends.alias("end"))).alias("k", "z")).select("doc_id", (F.col("z.end") - F.length("z.x.text")).alias("begin"), F.col("z.end").alias("end"))
    return writers.sentence_dump(docs, sent)


# Other annotation formats


@query("SELECT o_orderkey AS doc_id, n AS name, b AS \"begin\", x AS rel FROM orders, (VALUES ('TIMEX3', 0, NULL), ('EVENT', 11, NULL), ('TLINK', NULL, 'BEFORE'), ('TLINK', NULL, 'CONTAINS')) AS v(n, b, x)")
def k02_thyme_reader(s, d):
    xml = "<data><annotations><entity><id>t1</id><span>0,10</span><type>DOCTIME</type><properties/></entity><entity><id>e1</id><span>11,17</span><type>EVENT</type><properties><DocTimeRel>BEFORE</DocTimeRel></properties></entity><entity><id>e2</id><span>18,20;22,24</span><type>EVENT</type><properties/></entity><relation><id>1@r</id><type>TLINK</type><properties><Source>t1</Source><Type>CONTAINS</Type><Target>e1</Target></properties></relation></annotations></data>"
    docs = X.read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" seized at noon")).alias("text"), F.lit(xml).alias("content"))
    return convert.read_thyme(docs).select("doc_id", "name", "begin", F.col("attrs")["relType"].alias("rel"))


@query("SELECT o_orderkey AS doc_id, n AS name, b AS \"begin\", x AS rel, y AS class FROM orders, (VALUES ('EVENT', 3, NULL, 'OCCURRENCE'), ('TLINK', NULL, 'AFTER', NULL), ('TIMEX3', 10, NULL, NULL)) AS v(n, b, x, y)")
def k03_knowtator_reader(s, d):
    xml = '<annotations><annotation><mention id="m1"/><span start="3" end="9"/></annotation><annotation><mention id="m2"/><span start="10" end="14"/></annotation><classMention id="m1"><mentionClass id="Event"/><hasSlotMention id="x1"/><hasSlotMention id="x2"/></classMention><classMention id="m2"><mentionClass id="Timex3"/></classMention><stringSlotMention id="x1"><mentionSlot id="class"/><stringSlotMentionValue value="OCCURRENCE"/></stringSlotMention><complexSlotMention id="x2"><mentionSlot id="AFTER"/><complexSlotMentionValue value="m2"/></complexSlotMention></annotations>'
    docs = X.read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("he walked 1998").alias("text"), F.lit(xml).alias("content"))
    return convert.read_knowtator(docs).select("doc_id", "name", "begin", F.col("attrs")["relType"].alias("rel"), F.col("attrs")["class"].alias("class"))


@query(f"WITH {X.EVENTS_SQL}, x AS (SELECT DISTINCT doc_id, b, e FROM ev), f AS (SELECT DISTINCT doc_id, b, e FROM ev WHERE seq % 3 > 0) SELECT x.doc_id, CAST(count(*) AS BIGINT) AS given, CAST(count(f.b) AS BIGINT) AS found, 100 * count(f.b) / count(*) AS percent FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.b = x.b AND f.e = x.e GROUP BY x.doc_id")
def e26_imported_share(s, d):
    e = X.events(s, d)
    return convert.imported_share(e.filter("seq % 3 > 0"), e)


@query("SELECT user_id, CAST(length(regexp_extract(x, '^v*(c|p)+')) AS INT) AS n, regexp_full_match(x, '[vc]*') AS whole FROM (SELECT user_id, string_agg(event_type[1:1], '' ORDER BY ts, event_id) AS x FROM events GROUP BY user_id)")
def a02_string_patterns(s, d):
    from ..functions import fsa

    one, two = fsa.compile_regex("v*(c|p)+"), fsa.compile_regex("[vc]*")
    x = X.read(s, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda r: F.left(r["event_type"], F.lit(1))), "").alias("x"))
    longest, whole = F.udf(lambda t: one.longest(t), "int", useArrow=True), F.udf(lambda t: two.accepts(t), "boolean", useArrow=True)
    return x.select("user_id", longest("x").alias("n"), whole("x").alias("whole"))


@query(f"WITH {X.LINES_SQL} SELECT l_orderkey AS doc_id, strftime(l_shipdate, '%Y%m%d') AS dct FROM li WHERE n = 1")
def s13_date_tag_creation_time(s, d):
    t = X.lines(s, d).select(F.col("l_orderkey").alias("doc_id"), F.lit("DATE").alias("name"), F.col("n").alias("seq"), F.create_map(F.lit("value"), F.date_format("l_shipdate", "yyyyMMdd")).alias("attrs"))
    return readers.date_tag_creation_time(t)


@query("SELECT o_orderkey AS k, array_to_string(CASE WHEN o_orderkey % 2 = 0 THEN ['s' || o_orderkey, 't1', 't2'] ELSE ['t1', 't2'] END, ' ') AS steps FROM orders")
def s16_processing_steps(s, d):
    k = F.col("o_orderkey")
    return X.read(s, d, "orders").select(k.alias("k"), F.array_join(readers.processing_steps(F.array(F.lit("t1"), F.lit("t2")), F.when(k % 2 == 0, F.array(F.concat(F.lit("s"), k)))), " ").alias("steps"))


# Sources and sinks


@query("""SELECT 'page' AS kind, page_id AS id, CASE WHEN regexp_matches(substr(html, 1, 1000), '<[A-Za-z_][^\\s>/]*[^>]*>') THEN 'xml' ELSE 'text' END AS format FROM pages
UNION ALL SELECT 'document', doc_id, CASE WHEN regexp_matches(substr(text, 1, 1000), '<[A-Za-z_][^\\s>/]*[^>]*>') THEN 'xml' ELSE 'text' END FROM documents""")
def s06_guess_source(s, d):
    p = X.read(s, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), readers.guess(F.col("html")).alias("format"))
    return p.union(X.read(s, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), readers.guess(F.col("text")).alias("format")))


def _conversation_xml(s, d):
    c = X.read(s, d, "conversations").filter("text is not null")
    esc = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    part = F.concat(F.lit('<u n="'), "turn", F.lit('">'), esc, F.lit("</u>"))
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("x")))), lambda x: x["x"]), "").alias("x"))
    return docs.select(F.col("conv_id").cast("string").alias("file"), F.concat(F.lit("<talk>"), "x", F.lit("</talk>")).alias("content"))


@query("""SELECT conv_id, CAST(turn AS VARCHAR) AS turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS "begin", CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS "end" FROM conversations WHERE text IS NOT NULL""")
def s02_s03_xml_source(s, d):
    t = readers.parse(_conversation_xml(s, d), "xml").select("file", F.explode("source_tags").alias("t")).filter("t.name = 'u'")
    return t.select(F.col("file").cast("long").alias("conv_id"), F.col("t.attrs")["n"].alias("turn"), "t.begin", "t.end")


@query("SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS n, CAST(length(text) AS INT) AS chars FROM conversations WHERE text IS NOT NULL")
def s17_paragraphs(s, d):
    c = X.read(s, d, "conversations").filter("text is not null")
    docs = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n \n").alias("text"))
    return readers.paragraphs(docs).select("doc_id", "n", (F.col("end") - F.col("begin")).alias("chars"))


@query("""SELECT o_orderkey AS doc_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m%d') END, CASE WHEN o_orderkey % 2 = 0 THEN '19980101' END, '20200101') AS dct,
o_orderkey % 6 = 0 AND strftime(o_orderdate, '%Y%m%d') <> '19980101' AS conflict FROM orders""")
def s10_creation_time(s, d):
    k = F.col("o_orderkey")
    dct, conflict = readers.creation_time([F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")), F.when(k % 2 == 0, F.lit("19980101"))], F.lit("2020-01-01").cast("date"))
    return X.read(s, d, "orders").select(k.alias("doc_id"), dct.alias("dct"), conflict.alias("conflict"))


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN '19' || strftime(o_orderdate, '%y%m%d') ELSE strftime(o_orderdate, '%Y%m%d') END AS dct FROM orders""")
def s12_timebank_creation_time(s, d):
    k, f = F.col("o_orderkey") % 4, lambda p: F.date_format("o_orderdate", p)
    docno = F.when(k == 0, F.concat(F.lit("ABC"), f("yyyyMMdd"), F.lit(".1830.0711"))).when(k == 1, F.concat(F.lit("APW"), f("yyyyMMdd"), F.lit(".0476"))).when(k == 2, F.concat(F.lit("AP"), f("yyMMdd"), F.lit("-0044"))).otherwise("wsj_0106")
    return X.read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), readers.timebank_dct(docno, F.lit(""), f("MM/dd/yyyy"), F.lit("")).alias("dct"))


@query(f"WITH {X.LINES_SQL} SELECT l_orderkey AS doc_id, min(strftime(l_shipdate, '%Y%m%d')) FILTER (WHERE n = 2) AS dct FROM li GROUP BY l_orderkey HAVING count(*) FILTER (WHERE n = 2) > 0")
def s11_timex_creation_time(s, d):
    n = F.col("n")
    t = X.lines(s, d).select(F.col("l_orderkey").alias("doc_id"), F.lit("TIMEX3").alias("name"), n.alias("seq"), F.create_map(F.lit("functionInDocument"), F.when(n == 2, "CREATION_TIME").otherwise("NONE"), F.lit("value"), F.date_format("l_shipdate", "yyyyMMdd")).alias("attrs"))
    return readers.timex_creation_time(t)


@query("SELECT o_orderkey || '.txt' AS file, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y%m%d') END AS dct FROM orders")
def s14_lookup_creation_time(s, d):
    o = X.read(s, d, "orders")
    docs = o.select(F.concat("o_orderkey", F.lit(".txt")).alias("file"))
    table = o.filter("o_orderkey % 2 = 0").select(F.concat("o_orderkey", F.lit(".txt")).alias("filename"), F.date_format("o_orderdate", "yyyyMMdd").alias("dct"))
    return readers.with_lookup(docs, table).select("file", F.col("lookup_dct").alias("dct"))


def _few(s, d, stages=("TOKENIZER", "GUTIME")):
    """Sentences of orders as documents with their tags; only the stages that a query looks at."""
    docs = X.sentences(s, d)
    return docs, annotate.annotate(docs, stages)


def _said(s, d, sentences: list[str], key: str = "o_orderkey", dct: bool = False):
    """A document an order, its text one of the sentences in turn."""
    o = X.read(s, d, "orders")
    text = F.element_at(F.array(*map(F.lit, sentences)), (F.col(key) % len(sentences) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"), F.col("o_orderdate").cast("date").alias("dct") if dct else F.lit(None).cast("date").alias("dct"))


@query(f"WITH {X.SENTENCES_SQL} SELECT doc_id, s1 AS text, 1 AS times FROM sn")
def s04_s20_ttk_round_trip(s, d):
    docs, t = _few(s, d)
    written = writers.ttk(docs, t.filter("false"), t)
    back = readers.parse(written.select(F.col("doc_id").cast("string").alias("file"), F.col("ttk").alias("content")), "ttk")
    return back.select(F.col("file").cast("long").alias("doc_id"), "text", F.size(F.filter("own_tags", lambda x: x["name"] == "TIMEX3")).alias("times"))


@query(f"WITH {X.SENTENCES_SQL} SELECT doc_id, s1 AS text, 1 AS times FROM sn")
def s05_s22_lif_round_trip(s, d):
    docs, t = _few(s, d)
    back = readers.parse(writers.lif_documents(docs, t).select(F.col("doc_id").cast("string").alias("file"), F.col("lif").alias("content")), "lif")
    return back.select(F.col("file").cast("long").alias("doc_id"), "text", F.size(F.filter("source_tags", lambda x: x["name"] == "TimeExpression")).alias("times"))


# Preprocessing, times, events over generated sentences


_WS = r"\t\n\v\f\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_PUNCT_SQL = r"""[.,!?''`";:\]\[(){}<>]"""
_SHORT_SQL = "('Mr.','Mrs.','Ms.','Dr.','Prof.','Rev.','Gen.','Sen.','Rep.','Gov.','Lt.','Col.','Sgt.','Capt.','St.','Jr.','Sr.','Inc.','Corp.','Co.','Ltd.','Bros.','Jan.','Feb.','Mar.','Apr.','Jun.','Jul.','Aug.','Sep.','Sept.','Oct.','Nov.','Dec.','Mon.','Tue.','Wed.','Thu.','Fri.','Sat.','Sun.','No.','vs.','etc.','e.g.','i.e.','a.m.','p.m.','approx.','dept.','est.')"
_LAST_SQL = "('Inc.','Corp.','Co.','Ltd.','Jr.','Sr.','etc.','a.m.','p.m.','Bros.')"
_FIRST_SQL = "('The','A','An','He','She','It','They','We','I','You','This','That','These','Those','But','And','In','On','At','When','If','For','As','His','Her','Their','Its','Mr.','Mrs.','Ms.','Dr.')"


@query(rf"""WITH par AS (SELECT doc_id, unnest(string_split_regex(text, '[{_WS}]*\n[{_WS}]*?\n[{_WS}]*')) AS p, generate_subscripts(string_split_regex(text, '[{_WS}]*\n[{_WS}]*?\n[{_WS}]*'), 1) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, n, unnest(regexp_extract_all(p, '[^{_WS}]+')) AS w, generate_subscripts(regexp_extract_all(p, '[^{_WS}]+'), 1) AS i FROM par),
o AS (SELECT *, length(regexp_extract(w, '^{_PUNCT_SQL}*')) AS o FROM w),
c AS (SELECT *, regexp_extract(w[o + 1 :], '{_PUNCT_SQL}*$') AS close FROM o),
k AS (SELECT *, w[o + 1 : length(w) - length(close)] AS core FROM c),
a AS (SELECT *, core <> '' AND close LIKE '.%' AND (core || '.' IN {_SHORT_SQL} OR regexp_full_match(core, '([A-Z]\.)*[A-Z]')) AS short FROM k),
b AS (SELECT doc_id, n, i, w, o, CASE WHEN short THEN core || '.' ELSE core END AS core, CASE WHEN short THEN close[2 :] ELSE close END AS close FROM a),
e AS (SELECT *, lead(core || close) OVER (PARTITION BY doc_id, n ORDER BY i) AS following FROM b),
f AS (SELECT *, following IS NOT NULL AND (regexp_matches(close, '[.?!]') OR (close = '' AND core IN {_LAST_SQL} AND following IN {_FIRST_SQL})) AS ends,
  CASE WHEN core = '' THEN 0 WHEN regexp_full_match(core, '(?i)[\p{{L}}\p{{N}}_]+(n''t|''(t|d|s|m|re|ll|ve))') THEN 2 ELSE 1 END AS cores FROM e),
g AS (SELECT doc_id, n, sum(o + cores + length(close)) AS tokens, 1 + count(*) FILTER (WHERE ends) AS sentences, sum(length(w)) AS chars FROM f GROUP BY doc_id, n)
SELECT doc_id, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(sentences) AS BIGINT) AS sentences, CAST(sum(chars) AS BIGINT) AS chars FROM g GROUP BY doc_id""")
def p01_p06_tokens_and_sentences(s, d):
    docs = X.read(s, d, "documents").select("doc_id", "text", F.lit(None).cast("date").alias("dct"))
    t = annotate.annotate(docs, ("TOKENIZER",))
    lex = F.col("name") == "lex"
    return t.groupBy("doc_id").agg(F.count_if(lex).alias("tokens"), F.count_if(F.col("name") == "s").alias("sentences"), F.sum(F.when(lex, F.col("end") - F.col("begin"))).cast("long").alias("chars"))


_TREE_TAGS = ["VVD", "VVZ", "VVG", "VVN", "VVP", "VV", "VHD", "VHZ", "VHG", "VBD", "VBZ", "SENT", "NP", "NPS", "IN/that", "PP", "PP$", "NN", "NNS", "JJ", "DT", "IN", "MD", "TO", "RB"]


@query("""WITH t AS (SELECT o_orderkey AS doc_id, string_split('VVD VVZ VVG VVN VVP VV VHD VHZ VHG VBD VBZ SENT NP NPS IN/that PP PP$ NN NNS JJ DT IN MD TO RB', ' ')[CAST(o_orderkey % 25 + 1 AS INT)] AS tag FROM orders)
SELECT doc_id, tag, CASE WHEN tag = 'SENT' THEN '.' WHEN tag = 'NP' THEN 'NNP' WHEN tag = 'NPS' THEN 'NNPS' WHEN tag = 'IN/that' THEN 'IN' WHEN tag = 'PP' THEN 'PRP' WHEN tag = 'PP$' THEN 'PRP$' WHEN tag[1:2] IN ('VV', 'VH') THEN 'VB' || tag[3:] ELSE tag END AS normal FROM t""")
def p11_normalize_tags(s, d):
    from ..functions.english import normalize_pos

    f = F.udf(normalize_pos, "string", useArrow=True)
    return _said(s, d, _TREE_TAGS).select("doc_id", F.col("text").alias("tag"), f("text").alias("normal"))


@query("""WITH o AS (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 14 AS k FROM orders)
SELECT doc_id, CASE k WHEN 4 THEN strftime(d, '%Y%m') WHEN 5 THEN CAST(year(d) AS VARCHAR) WHEN 6 THEN year(d) || 'SU' WHEN 7 THEN CAST(year(d) // 10 AS VARCHAR) WHEN 8 THEN CAST(year(d) AS VARCHAR) WHEN 9 THEN CAST(year(d) AS VARCHAR) WHEN 10 THEN year(d) || 'Q4' WHEN 12 THEN year(d) || '1225' WHEN 13 THEN CAST(year(d) AS VARCHAR) ELSE strftime(d, '%Y%m%d') END AS value,
CASE k WHEN 8 THEN 'MID' WHEN 9 THEN 'LATE' END AS mod FROM o""")
def n05_n22_absolute_dates(s, d):
    f = lambda p: F.date_format("o_orderdate", p)
    year = f("yyyy")
    forms = [f("'It came on' MMMM d, yyyy."), f("'It came on' d MMMM yyyy."), f("'It came on' MM/dd/yyyy."), f("'It came on' yyyy-MM-dd."), f("'It came in' MMMM yyyy."), f("'It came in' yyyy."), F.concat(F.lit("It came in the summer of "), year, F.lit(".")), F.concat(F.lit("It came in the "), F.left(year, F.lit(3)), F.lit("0s.")), F.concat(F.lit("It came in mid-"), year, F.lit(".")), F.concat(F.lit("It came in late "), year, F.lit(".")), F.concat(F.lit("It came in the fourth quarter of "), year, F.lit(".")), f("'It came on the' d'th of' MMMM, yyyy."), F.concat(F.lit("It came on Christmas "), year, F.lit(".")), F.concat(F.lit("It came in '"), F.substring(year, 3, 2), F.lit("."))]
    docs = X.read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.element_at(F.array(*forms), (F.col("o_orderkey") % 14 + 1).cast("int")).alias("text"), F.lit("1999-03-10").cast("date").alias("dct"))
    return annotate.of(annotate.annotate(docs, ("GUTIME",)), "TIMEX3").select("doc_id", F.col("attrs")["value"].alias("value"), F.col("attrs")["MOD"].alias("mod"))


@query(f"""WITH {X.SENTENCES_SQL} SELECT doc_id, position(strftime(d, '%B') IN s1) - 1 AS "begin", length(s1) - 1 AS "end", 'DATE' AS type, strftime(d, '%Y%m%d') AS value FROM sn""")
def n11_n22_absolute_dates(s, d):
    _, t = _few(s, d, ("GUTIME",))
    return annotate.timexes(t).select("doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "type", "value")


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN strftime(d - to_days(CAST(n AS INT)), '%Y%m%d') WHEN 1 THEN strftime(date_trunc('month', d) + to_months(1), '%Y%m') WHEN 2 THEN CAST(year(d) - 1 AS VARCHAR) WHEN 3 THEN strftime(d + to_days(1), '%Y%m%d') WHEN 4 THEN CAST(year(d) - n AS VARCHAR) ELSE strftime(d, '%Y%m%d') || 'TMO' END AS value
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 20 + 1 AS n FROM orders)""")
def n26_n29_relative_dates(s, d):
    o = X.read(s, d, "orders")
    n = F.element_at(F.array(*map(F.lit, X.NUMBERS)), (F.col("o_orderkey") % 20 + 1).cast("int"))
    kinds = [F.concat(F.lit("It shipped "), n, F.lit(" days ago.")), F.lit("It ships next month."), F.lit("It shipped last year."), F.lit("It ships tomorrow."), F.concat(F.lit("It shipped "), n, F.lit(" years ago.")), F.lit("It shipped this morning.")]
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.element_at(F.array(*kinds), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("text"), F.col("o_orderdate").cast("date").alias("dct"))
    return annotate.timexes(annotate.annotate(docs, ("GUTIME",))).select("doc_id", "value")


@query("""SELECT o_orderkey AS doc_id, 'DURATION' AS type, CASE o_orderkey % 3 WHEN 0 THEN 'P' || n || 'D' WHEN 1 THEN 'P' || 7 * n || 'D' ELSE 'P' || n || 'M' END AS value FROM (SELECT o_orderkey, o_orderkey % 20 + 1 AS n FROM orders)""")
def n03_n40_n41_durations(s, d):
    o = X.read(s, d, "orders")
    n = F.element_at(F.array(*map(F.lit, X.NUMBERS)), (F.col("o_orderkey") % 20 + 1).cast("int"))
    unit = F.element_at(F.array(*map(F.lit, ("days", "weeks", "months"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("It waited for "), n, F.lit(" "), unit, F.lit(".")).alias("text"), F.lit(None).cast("date").alias("dct"))
    return annotate.timexes(annotate.annotate(docs, ("GUTIME",))).select("doc_id", "type", "value")


_O = "(SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS d, isodow(CAST(o_orderdate AS DATE)) AS w FROM orders)"


def _times_of(s, d, sentences: list, n: int):
    """Times in sentences (columns or strings), the order's date being the document's: doc_id, type, value, mod, every."""
    forms = [x if not isinstance(x, str) else F.lit(x) for x in sentences]
    o = X.read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.element_at(F.array(*forms), (F.col("o_orderkey") % n + 1).cast("int")).alias("text"), F.col("o_orderdate").cast("date").alias("dct"))
    a = F.col("attrs")
    return annotate.of(annotate.annotate(o, ("GUTIME",)), "TIMEX3").select("doc_id", a["type"].alias("type"), a["value"].alias("value"), a["MOD"].alias("mod"), a["PERIODICITY"].alias("every"))


@query(f"""SELECT doc_id, strftime(CASE doc_id % 4 WHEN 0 THEN d - to_days(CAST((w + 5) % 7 + 1 AS INT)) WHEN 1 THEN d + to_days(CAST((11 - w) % 7 + 1 AS INT)) WHEN 2 THEN d - to_days(CAST((w + 1) % 7 + 1 AS INT)) ELSE d + to_days(CAST((7 - w) % 7 + 1 AS INT)) END, '%Y%m%d') AS value FROM {_O}""")
def n08_n23_n24_days_of_the_week(s, d):
    return _times_of(s, d, ["It came on Monday.", "It will come on Friday.", "It came last Friday.", "It comes next Monday."], 4).select("doc_id", "value")


@query(f"""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN strftime(d - 1, '%Y%m%d') WHEN 1 THEN strftime(d, '%Y%m%d') || 'TNI' WHEN 2 THEN strftime(d - 1, '%Y%m%d') || 'TNI' WHEN 3 THEN strftime(d - 2, '%Y%m%d') WHEN 4 THEN strftime(date_trunc('month', d) - to_months(1), '%Y%m') WHEN 5 THEN CAST(year(d) + 1 AS VARCHAR)
WHEN 6 THEN CASE WHEN isoyear(d) > year(d) THEN year(d) || 'W53' ELSE isoyear(d) || 'W' || lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0') END ELSE CAST(year(d) + 2 AS VARCHAR) END AS value FROM {_O}""")
def n09_n10_n12_n18_near_the_document(s, d):
    return _times_of(s, d, ["It came yesterday.", "It came tonight.", "It came last night.", "It came the day before yesterday.", "It came last month.", "It comes next year.", "It came this week.", "It comes the year after next."], 8).select("doc_id", "value")


@query("""WITH o AS (SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS INT) AS y FROM orders)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN y || '1225' WHEN 1 THEN y || '0101' WHEN 2 THEN y || '1031' WHEN 3 THEN y || '0704'
WHEN 4 THEN strftime(make_date(y, 11, 1) + to_days(CAST((11 - isodow(make_date(y, 11, 1))) % 7 + 21 AS INT)), '%Y%m%d') ELSE strftime(make_date(y, 9, 1) + to_days(CAST((8 - isodow(make_date(y, 9, 1))) % 7 AS INT)), '%Y%m%d') END AS value FROM o""")
def n14_holidays(s, d):
    y = F.concat(F.lit(" "), F.year("o_orderdate").cast("string"), F.lit("."))
    return _times_of(s, d, [F.concat(F.lit(f"It came on {h}"), y) for h in ("Christmas", "New Year's Day", "Halloween", "Independence Day", "Thanksgiving", "Labor Day")], 6).select("doc_id", "value")


@query("""SELECT o_orderkey AS doc_id, string_split('F1D F1W F1M F1Y F1M F1D F1W', ' ')[CAST(o_orderkey % 7 + 1 AS INT)] AS every FROM orders""")
def n17_n28_sets(s, d):
    return _times_of(s, d, ["It came every day.", "It came every week.", "It came each month.", "It came annually.", "It came monthly.", "It came daily.", "It came weekly."], 7).select("doc_id", "every")


@query(f"""SELECT doc_id, 'TIME' AS type, strftime(d, '%Y%m%d') || CASE doc_id % 6 WHEN 0 THEN 'T' || (doc_id % 11 + 13) || '00' WHEN 1 THEN 'T0' || (doc_id % 9 + 1) || '30' WHEN 2 THEN 'T1200' WHEN 3 THEN 'T2400' WHEN 4 THEN 'T1330' ELSE 'T1430' END AS value FROM {_O}""")
def n19_n29d_clock_times(s, d):
    k = F.col("o_orderkey")
    return _times_of(s, d, [F.concat(F.lit("It came at "), k % 11 + 1, F.lit(" pm.")), F.concat(F.lit("It came at "), k % 9 + 1, F.lit(":30 am.")), "It came at noon.", "It came at midnight.", "It came at 13:30.", "It came at 1430 hours."], 6).select("doc_id", "type", "value")


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey % 9 + 10 AS VARCHAR) WHEN 1 THEN 'FUTURE_REF' WHEN 2 THEN 'PAST_REF' WHEN 3 THEN 'PRESENT_REF' WHEN 4 THEN '199' ELSE 'PRESENT_REF' END AS value FROM orders""")
def n15_n16_n20_n27_references(s, d):
    century = F.concat(F.lit("It came in the "), F.col("o_orderkey") % 9 + 11, F.lit("th century."))
    return _times_of(s, d, [century, "It is the future.", "It was the past.", "It is now.", "It came in the nineties.", "It is currently here."], 6).select("doc_id", "value")


@query("""WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 9 + 2 AS n FROM orders)
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'P' || 7 * n || 'D' WHEN 1 THEN 'P' || n || 'Y' WHEN 2 THEN 'P' || n || 'D' WHEN 3 THEN 'PXM' WHEN 4 THEN 'P' || n || 'M' WHEN 5 THEN 'P10Y' WHEN 6 THEN 'P' || 7 * n || 'D' WHEN 7 THEN 'P' || n || 'Y' WHEN 8 THEN 'P' || 7 * n || 'D' ELSE 'P' || n || 'Y' END AS value,
CASE doc_id % 10 WHEN 0 THEN 'MORE_THAN' WHEN 1 THEN 'EQUAL_OR_MORE' WHEN 2 THEN 'EQUAL_OR_LESS' WHEN 8 THEN 'APPROX' END AS mod FROM o""")
def n03_n29e_duration_patterns(s, d):
    n = (F.col("o_orderkey") % 9 + 2).cast("string")
    say = lambda a, b: F.concat(F.lit("It took " + a), n, F.lit(b + "."))
    forms = [say("more than ", " weeks"), say("at least ", " years"), say("no more than ", " days"), "It took a few months.", say("the last ", " months"), "It took a decade.", say("another ", " weeks"), say("the first ", " years"), say("about ", " weeks"), say("a ", "-year loan")]
    return _times_of(s, d, forms, 10).select("doc_id", "value", "mod")


def _orders(s, d):
    return X.read(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"))


_D = "(SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)"


@query(f"SELECT k, strftime(d + to_days(CAST(k % 90 - 45 AS INT)), '%Y%m%d') AS day, strftime(date_trunc('month', d) + to_months(CAST(k % 30 - 15 AS INT)), '%Y%m') AS month, CAST(year(d) + k % 9 AS VARCHAR) AS year, CAST((year(d) + 10 * (k % 5)) // 10 AS VARCHAR) AS decade FROM {_D}")
def n31_offset_from_reference(s, d):
    k, x = F.col("k"), F.col("d")
    return _orders(s, d).select("k", calendar.offset(x, k % 90 - 45, "D").alias("day"), calendar.offset(x, k % 30 - 15, "M").alias("month"), calendar.offset(x, k % 9, "Y").alias("year"), calendar.offset(x, k % 5, "decade").alias("decade"))


@query(f"""SELECT k, CAST(day(last_day(d)) AS INT) AS length, day(last_day(make_date(year(d), 2, 1))) = 29 AS leap, CAST(dayofyear(d) AS INT) AS doy, CAST(dayofweek(d) AS INT) AS dow,
CASE WHEN isoyear(d) > year(d) THEN year(d) || 'W53' ELSE isoyear(d) || 'W' || lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0') END AS week FROM {_D}""")
def n32_n37_calendar(s, d):
    x = F.col("d")
    return _orders(s, d).select("k", calendar.month_length(F.year(x), F.month(x)).alias("length"), calendar.is_leap_year(F.year(x)).alias("leap"), calendar.day_of_year(x).alias("doy"), calendar.day_of_week(x).alias("dow"), calendar.week_value(x).alias("week"))


@query(f"SELECT k, CAST(date_trunc('week', d) + to_days(3) AS DATE) AS thursday FROM {_D}")
def n35_week_to_date(s, d):
    y, w = F.extract(F.lit("YEAROFWEEK"), F.col("d")), F.weekofyear("d")
    return _orders(s, d).select("k", calendar.week_thursday(y, w).alias("thursday"))


@query(f"""SELECT k, CASE WHEN n > 0 THEN arr[n] ELSE arr[len(arr)] END AS day FROM (SELECT k, CASE WHEN k % 5 = 4 THEN -1 ELSE k % 5 + 1 END AS n, list_filter(list_transform(range(0, day(last_day(d))), lambda i: CAST(date_trunc('month', d) + to_days(CAST(i AS INT)) AS DATE)), lambda x: dayofweek(x) = k % 7) AS arr FROM {_D})""")
def n38_nth_weekday(s, d):
    n = F.when(F.col("k") % 5 == 4, -1).otherwise(F.col("k") % 5 + 1)
    return _orders(s, d).select("k", calendar.nth_weekday(F.year("d"), F.month("d"), F.col("k") % 7, n).alias("day"))


@query("""WITH y AS (SELECT i AS y, i % 19 AS a, i // 100 AS b, i % 100 AS c FROM range(1700, 2200) r(i)),
h AS (SELECT *, (19 * a + b - b // 4 - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 AS h FROM y),
l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h),
m AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM l)
SELECT CAST(y AS INT) AS y, make_date(CAST(y AS INT), CAST((h + l - 7 * m + 114) // 31 AS INT), CAST((h + l - 7 * m + 114) % 31 + 1 AS INT)) AS easter FROM m""")
def n39_easter(s, d):
    return s.range(1700, 2200).select(F.col("id").cast("int").alias("y")).select("y", calendar.easter(F.col("y")).alias("easter"))


@query(f"SELECT k, strftime(d, '%Y%m%d') AS value FROM {_D}")
def n30_dates_in_many_formats(s, d):
    x, k = F.col("d"), F.col("k") % 3
    text = F.when(k == 0, F.date_format(x, "yyyy-MM-dd")).when(k == 1, F.date_format(x, "M/d/yyyy")).otherwise(F.date_format(x, "MM/dd/yy"))
    return _orders(s, d).select("k", calendar.to_value(text).alias("value"))


_VERBS = "walk bark visit claim report happen appear expect announce attack deliver travel".split()
#: Forms of a verb: text with {v}, {ed}, {ing}, and its tense, aspect, modality and polarity.
_FORMS = [
    ("He {ed}.", "PAST NONE NONE POS"), ("He is {ing}.", "PRESENT PROGRESSIVE NONE POS"), ("He has {ed}.", "PRESENT PERFECTIVE NONE POS"), ("He will {v}.", "FUTURE NONE NONE POS"),
    ("He had been {ing}.", "PAST PERFECTIVE_PROGRESSIVE NONE POS"), ("He could not {v}.", "NONE NONE could NEG"), ("He was going to {v}.", "PAST NONE NONE POS"), ("He does not {v}.", "PRESENT NONE NONE NEG"),
    ("He may {v}.", "NONE NONE may POS"), ("He would have {ed}.", "NONE PERFECTIVE would POS"), ("He did not {v}.", "PAST NONE NONE NEG"), ("He must not have {ed}.", "NONE PERFECTIVE must NEG"),
    ("He has to {v}.", "PRESENT NONE have_to POS"), ("He never {ed}.", "PAST NONE NONE NEG"), ("He will have {ed}.", "FUTURE PERFECTIVE NONE POS"), ("He was {ing}.", "PAST PROGRESSIVE NONE POS"),
    ("They might {v}.", "NONE NONE might POS"), ("They have not {ed}.", "PRESENT PERFECTIVE NONE NEG"), ("They should have been {ing}.", "NONE PERFECTIVE_PROGRESSIVE should POS"), ("They {v}.", "PRESENT NONE NONE POS"),
    ("He had {ed}.", "PAST PERFECTIVE NONE POS"), ("He cannot {v}.", "NONE NONE can NEG"), ("He is not going to {v}.", "FUTURE NONE NONE NEG"), ("They had to {v}.", "PAST NONE have_to POS"), ("He used to {v}.", "PAST NONE NONE POS"),
]


def _sayings() -> list[str]:
    return [f.format(v=v, ed=v + "ed", ing=v + "ing") for f, _ in _FORMS for v in _VERBS]


@query("""WITH f AS (SELECT string_split('PAST NONE NONE POS/PRESENT PROGRESSIVE NONE POS/PRESENT PERFECTIVE NONE POS/FUTURE NONE NONE POS/PAST PERFECTIVE_PROGRESSIVE NONE POS/NONE NONE could NEG/PAST NONE NONE POS/PRESENT NONE NONE NEG/NONE NONE may POS/NONE PERFECTIVE would POS/PAST NONE NONE NEG/NONE PERFECTIVE must NEG/PRESENT NONE have_to POS/PAST NONE NONE NEG/FUTURE PERFECTIVE NONE POS/PAST PROGRESSIVE NONE POS/NONE NONE might POS/PRESENT PERFECTIVE NONE NEG/NONE PERFECTIVE_PROGRESSIVE should POS/PRESENT NONE NONE POS/PAST PERFECTIVE NONE POS/NONE NONE can NEG/FUTURE NONE NONE NEG/PAST NONE have_to POS/PAST NONE NONE POS', '/') AS f),
x AS (SELECT o_orderkey AS doc_id, string_split(f[CAST(o_orderkey % 300 // 12 + 1 AS INT)], ' ') AS x FROM orders, f)
SELECT doc_id, x[1] AS tense, x[2] AS aspect, replace(x[3], '_', ' ') AS modality, x[4] AS polarity FROM x""")
def e06_e09_tense_aspect_polarity(s, d):
    t = annotate.annotate(_said(s, d, _sayings()), ("TOKENIZER", "TAGGER", "CHUNKER", "EVITA"))
    return annotate.events(t).select("doc_id", "tense", "aspect", "modality", "polarity")


_CLASSED = [("said", "REPORTING"), ("reported", "REPORTING"), ("announced", "REPORTING"), ("claimed", "REPORTING"), ("explained", "REPORTING"), ("saw", "PERCEPTION"), ("heard", "PERCEPTION"), ("watched", "PERCEPTION"), ("noticed", "PERCEPTION"), ("wanted", "I_STATE"), ("hoped", "I_STATE"), ("believed", "I_STATE"), ("knew", "I_STATE"), ("expected", "I_STATE"), ("tried", "I_ACTION"), ("refused", "I_ACTION"), ("offered", "I_ACTION"), ("decided", "I_ACTION"), ("avoided", "I_ACTION"), ("started", "ASPECTUAL"), ("finished", "ASPECTUAL"), ("continued", "ASPECTUAL"), ("stopped", "ASPECTUAL"), ("remained", "STATE"), ("existed", "STATE"), ("barked", "OCCURRENCE"), ("travelled", "OCCURRENCE"), ("ate", "OCCURRENCE")]


@query("""WITH v AS (SELECT string_split('REPORTING REPORTING REPORTING REPORTING REPORTING PERCEPTION PERCEPTION PERCEPTION PERCEPTION I_STATE I_STATE I_STATE I_STATE I_STATE I_ACTION I_ACTION I_ACTION I_ACTION I_ACTION ASPECTUAL ASPECTUAL ASPECTUAL ASPECTUAL STATE STATE OCCURRENCE OCCURRENCE OCCURRENCE', ' ') AS v)
SELECT o_orderkey AS doc_id, v[CAST(o_orderkey % 28 + 1 AS INT)] AS class FROM orders, v""")
def e10_verb_classes(s, d):
    return annotate.events(annotate.annotate(_said(s, d, [f"He {w} it." for w, _ in _CLASSED]), ("TOKENIZER", "TAGGER", "CHUNKER", "EVITA"))).select("doc_id", "class")


@query("SELECT lemma, feature, CAST(count(*) AS BIGINT) AS n, (sum(event) + 0.25) / (count(*) + 0.5) AS p FROM (SELECT event_type AS lemma, 'u' || user_id % 5 AS feature, CAST(value > 50 AS INT) AS event FROM events) GROUP BY lemma, feature")
def e22_nominal_training(s, d):
    rows = X.read(s, d, "events").select(F.col("event_type").alias("lemma"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("feature"), (F.col("value") > 50).cast("int").alias("event"))
    return convert.nominal_model(rows)


@query("""WITH r AS (SELECT event_type AS lemma, 'u' || user_id % 5 AS feature, CAST(value > 50 AS INT) AS event FROM events), m AS (
SELECT lemma, feature, count(*) AS n, (sum(event) + 0.25) / (count(*) + 0.5) AS p FROM (SELECT * FROM r UNION ALL SELECT lemma, '*', event FROM r) GROUP BY lemma, feature)
SELECT e.event_id AS id, CASE WHEN o.p > 0.99 THEN true WHEN o.p < 0.01 THEN false ELSE ln(o.p) + ln(f.p) > ln(1 - o.p) + ln(1 - f.p) END AS event
FROM events e JOIN m o ON o.lemma = e.event_type AND o.feature = '*' JOIN m f ON f.lemma = e.event_type AND f.feature = 'u' || e.user_id % 5""")
def e21_naive_bayes(s, d):
    ev = X.read(s, d, "events")
    f = F.concat(F.lit("u"), F.col("user_id") % 5)
    rows = ev.select(F.col("event_type").alias("lemma"), f.alias("feature"), (F.col("value") > 50).cast("int").alias("event"))
    model = convert.nominal_model(rows.union(rows.withColumn("feature", F.lit("*"))))
    return convert.classify_nominals(ev.select(F.col("event_id").alias("id"), F.col("event_type").alias("lemma"), F.array(f).alias("features")), model)


@query("SELECT DISTINCT w AS word, CASE WHEN w LIKE '%sses' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS stem FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE w <> ''")
def e25_strip_plural(s, d):
    w = F.col("word")
    words = X.read(s, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).filter("word <> ''").distinct()
    stem = F.when(w.endswith("sses"), F.left(w, F.length(w) - 2)).when(w.endswith("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1)).otherwise(w)
    return words.select("word", stem.alias("stem"))


_LETTER = {"view": "v", "click": "c", "purchase": "p", "signup": "s", "login": "l", "logout": "o", "search": "r", "cart": "t"}


@query("""SELECT user_id, CAST(length(regexp_extract(string_agg(CASE WHEN event_type IN ('purchase', 'click') THEN 'c' ELSE 'x' END, '' ORDER BY ts, event_id), '^(x*c+)')) AS INT) AS n FROM events GROUP BY user_id""")
def a05_longest_prefix(s, d):
    from ..functions import fsa

    auto = fsa.compile_pattern([{"kind": ("^", ["purchase", "click"])}, "*", {"kind": ["purchase", "click"]}, "+"])
    runs = X.read(s, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("run"))
    longest = F.udf(lambda run: auto.longest([{"kind": k} for k in run]), "int", useArrow=True)
    return runs.select("user_id", longest("run").alias("n"))


_LINKED = ["He wanted to walk.", "He said the dogs slept.", "He declined to walk.", "He began to walk.", "She hoped to win.", "They agreed to pay.", "He failed to appear.", "He refused to pay.", "She reported that the men left.", "They announced that he died.", "He stopped walking.", "He finished building.", "They continued to bark.", "He denied that she left.", "She saw the miners build.", "He welcomed the result.", "They asked the men to leave.", "He resumed walking.", "She tried to sleep.", "They blocked the trial."]


@query("""WITH x AS (SELECT string_split('MODAL EVIDENTIAL COUNTER_FACTIVE INITIATES MODAL MODAL COUNTER_FACTIVE COUNTER_FACTIVE EVIDENTIAL EVIDENTIAL TERMINATES CULMINATES CONTINUES NEG_EVIDENTIAL EVIDENTIAL FACTIVE MODAL REINITIATES MODAL COUNTER_FACTIVE', ' ') AS x)
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 20 IN (3, 10, 11, 12, 17) THEN 'ALINK' ELSE 'SLINK' END AS kind, x[CAST(o_orderkey % 20 + 1 AS INT)] AS relation, 'ei1' AS src, 'ei2' AS tgt FROM orders, x""")
def l02_l07_subordination_links(s, d):
    t = annotate.annotate(_said(s, d, _LINKED), ("TOKENIZER", "TAGGER", "CHUNKER", "EVITA", "SLINKET"))
    return annotate.links(t).select("doc_id", "kind", "relation", "src", "tgt")


# Temporal links

_RULES_SQL = """ru AS (SELECT * FROM (VALUES (1, 'PAST', NULL, 'PRESENT', NULL, NULL, 'BEFORE'), (2, 'PAST', NULL, 'FUTURE', NULL, NULL, 'BEFORE'), (3, 'PAST', NULL, 'PAST', NULL, NULL, 'AFTER'), (4, 'PRESENT', NULL, 'PRESENT', 'PERFECTIVE', NULL, 'AFTER'), (5, 'PRESENT', 'PERFECTIVE', 'FUTURE', NULL, NULL, 'BEFORE'), (6, 'PRESENT', NULL, 'PAST', NULL, NULL, 'AFTER'), (7, 'PRESENT', NULL, 'FUTURE', NULL, NULL, 'BEFORE'), (8, 'PRESENT', NULL, 'PRESENT', 'PROGRESSIVE', NULL, 'BEFORE'), (9, NULL, NULL, NULL, NULL, 'FACTIVE', 'AFTER'), (10, NULL, NULL, NULL, NULL, 'MODAL', 'BEFORE'), (11, NULL, NULL, NULL, 'PERFECTIVE', NULL, 'AFTER')) AS t("rule", t1, a1, t2, a2, lk, rel))"""


@query(f"""WITH {X.EVENTS_SQL}, {X.SLINKS_SQL}, {_RULES_SQL}
SELECT doc_id, lid, src, tgt, rel AS relation, 'RULE-' || "rule" AS syntax FROM (
SELECT sl.doc_id, lid, src, tgt, ru.rel, ru."rule", row_number() OVER (PARTITION BY sl.doc_id, lid ORDER BY ru."rule") AS k FROM sl
JOIN ev m ON m.doc_id = sl.doc_id AND m.eiid = src JOIN ev u ON u.doc_id = sl.doc_id AND u.eiid = tgt
JOIN ru ON (ru.t1 IS NULL OR ru.t1 = m.tense) AND (ru.a1 IS NULL OR ru.a1 = m.aspect) AND (ru.t2 IS NULL OR ru.t2 = u.tense) AND (ru.a2 IS NULL OR ru.a2 = u.aspect) AND (lk IS NULL OR lk = sl.relation)) WHERE k = 1""")
def t01_links_from_slinks(s, d):
    return tlinks.from_slinks(X.slinks(s, d), X.events(s, d)).select("doc_id", "lid", "src", "tgt", "relation", "syntax")


@query(f"""WITH {X.TIMES_SQL} SELECT a.doc_id, a.tid AS src, b.tid AS tgt,
CASE WHEN a.value = b.value THEN 'IDENTITY' WHEN starts_with(b.value, a.value) THEN 'INCLUDES' WHEN starts_with(a.value, b.value) THEN 'IS_INCLUDED' WHEN a.value < b.value THEN 'BEFORE' ELSE 'AFTER' END AS relation
FROM tx a JOIN tx b ON a.doc_id = b.doc_id AND a.seq < b.seq""")
def b01_b02_time_pairs(s, d):
    return tlinks.between_times(X.times(s, d))


@query(f"""WITH {X.NODES_SQL}, w AS (SELECT *, lead(node, 1) OVER p AS n1, lead(text, 1) OVER p AS t1, lead(node, 2) OVER p AS n2, lead(eiid, 2) OVER p AS e2, lead(node, 3) OVER p AS n3, lead(eiid, 3) OVER p AS e3 FROM nd WINDOW p AS (PARTITION BY doc_id, sentence ORDER BY pos))
SELECT doc_id, eiid AS src, e3 AS tgt, upper(t1) AS relation FROM w WHERE node = 'vg' AND eiid IS NOT NULL AND lower(t1) IN ('after', 'before', 'during') AND n2 = 'ng' AND e2 IS NULL AND n3 = 'vg' AND e3 IS NOT NULL""")
def b03_event_signal_event(s, d):
    return tlinks.event_signal_event(X.nodes(s, d))


@query(f"""WITH {X.EVENTS_SQL}, f AS (SELECT doc_id, sentence, arg_min(eiid, (b, eiid)) AS tgt FROM ev WHERE epos = 'VERB' GROUP BY doc_id, sentence)
SELECT y.doc_id, x.tgt AS src, y.tgt FROM f y JOIN f x ON x.doc_id = y.doc_id AND x.sentence = y.sentence - 1""")
def b04_main_events(s, d):
    return tlinks.main_events(X.events(s, d))


_SIGNALS_SQL = "CASE WHEN sig IN ('in', 'during', 'on', 'at', 'over', 'for', 'of') THEN 'IS_INCLUDED' WHEN sig = 'before' THEN 'BEFORE' WHEN sig = 'after' THEN 'AFTER' WHEN sig = 'when' THEN 'SIMULTANEOUS' WHEN sig IN ('since', 'from') THEN 'BEGUN_BY' WHEN sig = 'until' THEN 'ENDED_BY' END"


@query(f"""WITH {X.NODES_SQL}, w AS (SELECT *, lower(lag(text, 1) OVER p) AS sig, lag(eiid, 1) OVER p AS e1, lag(node, 1) OVER p AS n1, lag(eiid, 2) OVER p AS e2 FROM nd WINDOW p AS (PARTITION BY doc_id, sentence ORDER BY pos)), c AS (
SELECT doc_id, tid AS tgt, CASE WHEN eiid IS NOT NULL THEN 1 WHEN e2 IS NOT NULL AND {_SIGNALS_SQL} IS NOT NULL THEN 2 WHEN e1 IS NOT NULL AND n1 = 'vg' THEN 3 END AS k, eiid, e1, e2, {_SIGNALS_SQL} AS r, sig FROM w WHERE tid IS NOT NULL)
SELECT doc_id, tgt, CASE k WHEN 1 THEN eiid WHEN 2 THEN e2 ELSE e1 END AS src, CASE k WHEN 2 THEN r ELSE 'IS_INCLUDED' END AS relation, CASE k WHEN 1 THEN 'embedded' WHEN 2 THEN 'Type 2 (' || sig || ')' ELSE 'Type 1' END AS syntax FROM c WHERE k IS NOT NULL""")
def b05_b06_event_anchors(s, d):
    return tlinks.anchors(X.nodes(s, d))


@query(f"""WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%Y-%m') ELSE strftime(l_shipdate, '%Y') END AS a, CASE l_partkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE 'BC' || l_partkey END AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT doc_id, n, a, b, CASE WHEN starts_with(b, 'BC') THEN 'AFTER' WHEN a = b THEN 'IDENTITY' WHEN starts_with(b, a) THEN 'INCLUDES' WHEN starts_with(a, b) THEN 'IS_INCLUDED' WHEN a < b THEN 'BEFORE' ELSE 'AFTER' END AS relation FROM x""")
def c01_c06_compare_dates(s, d):
    j = X.read(s, d, "lineitem").join(X.read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n, p = F.col("l_linenumber") % 3, F.col("l_partkey") % 3
    f = F.date_format
    a = F.when(n == 0, f("l_shipdate", "yyyy-MM-dd")).when(n == 1, f("l_shipdate", "yyyy-MM")).otherwise(f("l_shipdate", "yyyy"))
    b = F.when(p == 0, f("o_orderdate", "yyyy-MM-dd")).when(p == 1, f("o_orderdate", "yyyy-MM")).otherwise(F.concat(F.lit("BC"), "l_partkey"))
    x = j.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), a.alias("a"), b.alias("b"))
    return x.withColumn("relation", dates.compare(F.col("a"), F.col("b")))


@query(f"""WITH x AS (SELECT k, d, isoyear(d) || '-W' || lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0') AS w, d + to_days(CAST(k % 41 - 20 AS INT)) AS m FROM {_D} WHERE isoyear(d) = year(d) AND year(d + to_days(CAST(k % 41 - 20 AS INT))) = year(d) AND isoyear(d + to_days(CAST(k % 41 - 20 AS INT))) = year(d))
SELECT k, CASE WHEN weekofyear(d) = weekofyear(m) THEN 'INCLUDES' WHEN weekofyear(d) < weekofyear(m) THEN 'BEFORE' ELSE 'AFTER' END AS relation FROM x""")
def c07_weeks_and_days(s, d):
    o = _orders(s, d).withColumn("m", F.date_add("d", (F.col("k") % 41 - 20).cast("int")))
    iso = lambda c: F.extract(F.lit("YEAROFWEEK"), F.col(c))
    o = o.filter((iso("d") == F.year("d")) & (F.year("m") == F.year("d")) & (iso("m") == F.year("d")))
    week = F.concat(F.year("d").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    return o.select("k", dates.compare(week, F.date_format("m", "yyyy-MM-dd")).alias("relation"))


# c07 leaves out the turn of the year; here all orders count. Like the reference, a week of another year than the day's is compared by year,
# unless it holds the first of January and the day is in that month: then it includes the day.
@query(f"""WITH x AS (SELECT k, d, d + to_days(CAST(k % 41 - 20 AS INT)) AS m FROM {_D})
SELECT k, CASE WHEN isoyear(d) <> year(m) AND month(m) = 1 AND yearweek(d) = yearweek(date_trunc('year', m)) THEN 'INCLUDES' WHEN isoyear(d) < year(m) THEN 'BEFORE' WHEN isoyear(d) > year(m) THEN 'AFTER'
WHEN yearweek(d) = yearweek(m) THEN 'INCLUDES' WHEN yearweek(d) < yearweek(m) THEN 'BEFORE' ELSE 'AFTER' END AS relation FROM x""")
def c08_weeks_and_days_at_any_time(s, d):
    o = _orders(s, d).withColumn("m", F.date_add("d", (F.col("k") % 41 - 20).cast("int")))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("d")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    x = o.select("k", week.alias("a"), F.date_format("m", "yyyy-MM-dd").alias("b"))
    return x.select("k", dates.compare(F.col("a"), F.col("b")).alias("relation"))


# Classifier

_ENTITIES_SQL = f"""{X.EVENTS_SQL}, en AS (SELECT doc_id, sentence, b, CASE WHEN seq % 3 = 0 THEN 't' || seq ELSE eiid END AS id, CASE WHEN seq % 3 = 0 THEN 'T' ELSE 'E' END AS kind, tense FROM ev)"""


def _entities(s, d):
    e = X.events(s, d)
    t = F.col("seq") % 3 == 0
    maps = F.when(t, F.create_map(F.lit("type"), F.lit("DATE"), F.lit("value"), F.lit("1998"))).otherwise(F.create_map(F.lit("tense"), F.col("tense"), F.lit("aspect"), F.col("aspect")))
    return e.select("doc_id", "sentence", "begin", F.when(t, F.concat(F.lit("t"), "seq")).otherwise(F.col("eiid")).alias("id"), F.when(t, "T").otherwise("E").alias("kind"), maps.alias("features"))


@query(f"""WITH {_ENTITIES_SQL}, p AS (SELECT *, lead(id) OVER w AS id2, lead(kind) OVER w AS kind2 FROM en WINDOW w AS (PARTITION BY doc_id, sentence ORDER BY b, id))
SELECT doc_id, CASE WHEN kind = 'T' THEN id2 ELSE id END AS e1, CASE WHEN kind = 'T' THEN id ELSE id2 END AS e2, CASE WHEN kind = kind2 THEN 'EE' ELSE 'ET' END AS pair FROM p WHERE id2 IS NOT NULL AND (kind = 'E' OR kind2 = 'E')""")
def v02_neighbouring_pairs(s, d):
    return vectors.neighbours(_entities(s, d)).select("doc_id", F.col("e1.id").alias("e1"), F.col("e2.id").alias("e2"), "pair")


@query(f"""WITH {X.EVENTS_SQL}, p AS (SELECT *, lead(eiid) OVER w AS e2, lead(tense) OVER w AS t2, lead(aspect) OVER w AS a2, lead(b) OVER w AS b2 FROM ev WINDOW w AS (PARTITION BY doc_id, sentence ORDER BY b, eiid))
SELECT '000001-' || eiid || '-' || e2 || ' e1-asp=' || aspect || ' e1-ten=' || tense || ' e2-asp=' || a2 || ' e2-ten=' || t2 || ' shAsp=' || CASE WHEN aspect = a2 THEN '0' ELSE aspect || '-' || a2 END || ' shTen=' || CASE WHEN tense = t2 THEN '0' ELSE tense || '-' || t2 END AS vector FROM p WHERE e2 IS NOT NULL""")
def v03_v06_vectors(s, d):
    e = X.events(s, d).select("doc_id", "sentence", "begin", F.col("eiid").alias("id"), F.lit("E").alias("kind"), F.create_map(F.lit("tense"), F.col("tense"), F.lit("aspect"), F.col("aspect")).alias("features"))
    p = vectors.features(vectors.neighbours(e).withColumn("signal", F.lit("NONE")))
    return p.select(vectors.as_text(F.lit(1), F.col("e1.id"), F.col("e2.id"), F.col("features")).alias("vector"))


@query(f"""WITH {X.EVENTS_SQL}, p AS (SELECT *, lead(eiid) OVER w AS e2, lead(b) OVER w AS b2 FROM ev WINDOW w AS (PARTITION BY doc_id, sentence ORDER BY b, eiid))
SELECT p.doc_id, p.eiid AS e1, p.e2, coalesce(arg_max(CASE t.seq % 2 WHEN 0 THEN 'in' WHEN 1 THEN 'on' END, (t.b, CASE WHEN t.seq % 2 = 0 THEN 'in' ELSE 'on' END)), 'NONE') AS signal
FROM p LEFT JOIN (SELECT doc_id, sentence, b + 1 AS b, seq FROM ev) t ON t.doc_id = p.doc_id AND t.sentence = p.sentence AND t.b > p.b AND t.b < p.b2 WHERE e2 IS NOT NULL GROUP BY p.doc_id, p.eiid, p.e2""")
def v05_v08_signal_between(s, d):
    ev = X.events(s, d)
    e = ev.select("doc_id", "sentence", "begin", F.col("eiid").alias("id"), F.lit("E").alias("kind"), F.create_map(F.lit("x"), F.lit("y")).alias("features"))
    words = ev.select("doc_id", "sentence", (F.col("begin") + 1).alias("begin"), F.when(F.col("seq") % 2 == 0, "in").otherwise("on").alias("text"), F.lit("IN").alias("pos"))
    return vectors.signal_between(vectors.neighbours(e), words).select("doc_id", F.col("e1.id").alias("e1"), F.col("e2.id").alias("e2"), "signal")


_INVERSE_SQL = "CASE relation WHEN 'BEFORE' THEN 'AFTER' WHEN 'INCLUDES' THEN 'IS_INCLUDED' WHEN 'ENDS' THEN 'ENDED_BY' END"


@query(f"""WITH {X.EVENTS_SQL}, p AS (SELECT doc_id, eiid AS e1, lead(eiid) OVER (PARTITION BY doc_id, sentence ORDER BY b, eiid) AS e2 FROM ev),
g AS (SELECT doc_id, eiid AS src, lead(eiid) OVER (PARTITION BY doc_id ORDER BY seq) AS tgt, CASE seq % 3 WHEN 0 THEN 'BEFORE' WHEN 1 THEN 'INCLUDES' ELSE 'ENDS' END AS relation FROM ev),
b AS (SELECT doc_id, src AS a, tgt AS b, relation AS label FROM g WHERE tgt IS NOT NULL UNION ALL SELECT doc_id, tgt, src, {_INVERSE_SQL} FROM g WHERE tgt IS NOT NULL)
SELECT p.doc_id, e1, e2, min(label) AS label FROM p JOIN b ON b.doc_id = p.doc_id AND b.a = e1 AND b.b = e2 GROUP BY p.doc_id, e1, e2""")
def v07_training_labels(s, d):
    e = X.events(s, d)
    ent = e.select("doc_id", "sentence", "begin", F.col("eiid").alias("id"), F.lit("E").alias("kind"), F.create_map(F.lit("x"), F.lit("y")).alias("features"))
    return vectors.label(vectors.neighbours(ent), _gold(s, d)).select("doc_id", F.col("e1.id").alias("e1"), F.col("e2.id").alias("e2"), "label")


def _gold(s, d):
    rel = F.when(F.col("seq") % 3 == 0, "BEFORE").when(F.col("seq") % 3 == 1, "INCLUDES").otherwise("ENDS")
    e = X.events(s, d)
    return e.select("doc_id", F.col("eiid").alias("src"), F.lead("eiid").over(W.partitionBy("doc_id").orderBy("seq")).alias("tgt"), rel.alias("relation")).filter("tgt is not null")


@query()
def v09_v12_link_classifier(s, d):
    e = X.events(s, d)
    maps = F.create_map(F.lit("tense"), F.col("tense"), F.lit("aspect"), F.col("aspect"), F.lit("string"), (F.col("seq") % 3).cast("string"))
    ent = e.select("doc_id", "sentence", "begin", F.col("eiid").alias("id"), F.lit("E").alias("kind"), maps.alias("features"))
    p = vectors.features(vectors.neighbours(ent).withColumn("signal", F.lit("NONE")))
    model = vectors.train(vectors.label(p, _gold(s, d)))
    return vectors.classify(p, model).select("doc_id", F.col("e1.id").alias("e1"), F.col("e2.id").alias("e2"), "relation", "score", "origin")


@query("""SELECT k, list_extract(l, 1).label AS top, list_extract(l, 1).score AS score FROM (SELECT k, list_sort([{'score': CAST(k % 7 AS DOUBLE), 'label': 'BEFORE'}, {'score': CAST(k % 5 AS DOUBLE), 'label': 'AFTER'}, {'score': CAST(k % 3 AS DOUBLE), 'label': 'INCLUDES'}], 'DESC') AS l FROM (SELECT o_orderkey AS k FROM orders))""")
def v11_parse_scores(s, d):
    k = F.col("o_orderkey")
    line = F.concat_ws(" ", F.concat(F.lit("x"), k), F.lit("BEFORE"), (k % 7).cast("double").cast("string"), F.lit("AFTER"), (k % 5).cast("double").cast("string"), F.lit("INCLUDES"), (k % 3).cast("double").cast("string"))
    top = F.element_at(vectors.parse_scores(line), 1)
    return X.read(s, d, "orders").select(k.alias("k"), top["label"].alias("top"), top["score"].alias("score"))


# Algebra and closure


def _rel_sql(a: str, b: str, c: str, e: str) -> str:
    return f"""CASE WHEN {b} < {c} THEN '<' WHEN {e} < {a} THEN '>' WHEN {b} = {c} THEN 'm' WHEN {e} = {a} THEN 'mi' WHEN {a} = {c} AND {b} = {e} THEN '=' WHEN {a} = {c} AND {b} < {e} THEN 's' WHEN {a} = {c} THEN 'si'
WHEN {b} = {e} AND {a} > {c} THEN 'f' WHEN {b} = {e} THEN 'fi' WHEN {a} > {c} AND {b} < {e} THEN 'd' WHEN {a} < {c} AND {b} > {e} THEN 'di' WHEN {a} < {c} THEN 'o' ELSE 'oi' END"""


@query(f"""WITH p AS (SELECT a.i AS s, b.i AS e FROM range(6) a(i) JOIN range(6) b(i) ON a.i < b.i)
SELECT {_rel_sql("x.s", "x.e", "y.s", "y.e")} AS r1, {_rel_sql("y.s", "y.e", "z.s", "z.e")} AS r2, array_to_string(list_sort(list(DISTINCT {_rel_sql("x.s", "x.e", "z.s", "z.e")})), ' ') AS r3 FROM p x, p y, p z GROUP BY 1, 2""")
def m04_m13_composition(s, d):
    r = s.createDataFrame([(x, y) for x in allen.BASIC for y in allen.BASIC], "r1 string, r2 string")
    return r.select("r1", "r2", allen.show_col(allen.compose_col(allen.mask_col(F.col("r1")), allen.mask_col(F.col("r2")))).alias("r3"))


@query(f"""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 30 AS b, CAST(l_shipdate AS DATE) AS c, CAST(l_shipdate AS DATE) + l_linenumber * 5 AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT k, n, {_rel_sql("a", "b", "c", "e")} AS relation, {_rel_sql("c", "e", "a", "b")} AS inverse FROM x""")
def m02_m06_relations_and_inverses(s, d):
    j = X.read(s, d, "lineitem").join(X.read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, c = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    r = allen.relation_col(a, F.date_add(a, 30), c, F.date_add(c, (F.col("l_linenumber") * 5).cast("int")))
    return j.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), r.alias("relation")).withColumn("inverse", allen.show_col(allen.inverse_col(allen.mask_col(F.col("relation")))))


_TIMEML = "BEFORE IBEFORE AFTER IAFTER INCLUDES DURING_INV IS_INCLUDED BEGINS BEGUN_BY ENDS ENDED_BY IDENTITY SIMULTANEOUS DURING".split()


@query("""SELECT o_orderkey AS k, string_split('BEFORE IBEFORE AFTER IAFTER INCLUDES DURING_INV IS_INCLUDED BEGINS BEGUN_BY ENDS ENDED_BY IDENTITY SIMULTANEOUS DURING', ' ')[CAST(o_orderkey % 14 + 1 AS INT)] AS t, string_split('< m > mi di di d s si f fi = = =', ' ')[CAST(o_orderkey % 14 + 1 AS INT)] AS a FROM orders""")
def m02_timeml_names(s, d):
    return _said(s, d, _TIMEML).select(F.col("doc_id").alias("k"), F.col("text").alias("t"), allen.map_col(allen.FROM_TIMEML, F.col("text")).alias("a"))


@query("SELECT k, array_to_string(list_sort(list_filter(['<', 'd', 'm', 'o', 's'], lambda r: list_contains(y, r))), ' ') AS both FROM (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN ['<', 'm'] WHEN 1 THEN ['d', 's', '='] ELSE ['oi'] END AS y FROM orders)")
def m05_m07_intersection(s, d):
    k = F.col("o_orderkey")
    y = F.when(k % 3 == 0, "< m").when(k % 3 == 1, "d s =").otherwise("oi")
    both = allen.mask_col(F.lit("< d m o s")).bitwiseAND(allen.mask_col(y))
    return X.read(s, d, "orders").select(k.alias("k"), allen.show_col(both).alias("both"))


_CHAIN_SQL = "o AS (SELECT o_custkey AS doc_id, 'ei' || o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"


def _chain(s, d):
    e = X.events(s, d)
    w = W.partitionBy("doc_id").orderBy("seq")
    return e.select("doc_id", F.col("eiid").alias("src"), F.lead("eiid").over(w).alias("tgt"), F.lit("<").alias("relations"), "seq", F.lit(0).alias("rank")).filter("tgt is not null")


@query(f"WITH {_CHAIN_SQL} SELECT a.doc_id, a.id AS src, b.id AS tgt, CASE WHEN a.n < b.n THEN '<' ELSE '>' END AS relations FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.n <> b.n")
def m08_m09_closure_of_chains(s, d):
    return closure.propagate(_chain(s, d)).select("doc_id", "src", "tgt", "relations")


@query(f"WITH {_CHAIN_SQL} SELECT a.doc_id, a.id AS src, b.id AS tgt, CASE WHEN a.n < b.n THEN 'BEFORE' ELSE 'AFTER' END AS relation FROM o a JOIN o b ON a.doc_id = b.doc_id AND abs(a.n - b.n) = 1")
def m10_m11_reduced_export(s, d):
    bad = _chain(s, d).select("doc_id", F.col("tgt").alias("src"), F.col("src").alias("tgt"), "relations", (F.col("seq") + 1_000_000).alias("seq"), F.lit(1).alias("rank"))
    return closure.to_timeml(closure.propagate(_chain(s, d).union(bad), "user")).select("doc_id", "src", "tgt", "relation")


@query(f"WITH {_CHAIN_SQL} SELECT a.doc_id, a.id AS src, b.id AS tgt, '<' AS relations FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.n = a.n + 2")
def m09_implied_by_join(s, d):
    links = _chain(s, d).withColumn("mask", allen.mask_col(F.col("relations")))
    return closure.implied(links).select("doc_id", "src", "tgt", allen.show_col(F.col("mask")).alias("relations"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1 + (o_orderkey % 10000) / 10000.0 ELSE 0.0 END::DOUBLE AS trust FROM orders""")
def m01_confidence(s, d):
    k = F.col("o_orderkey")
    origin = F.when(k % 4 == 0, F.concat(F.lit("S2T-RULE-"), k)).when(k % 4 == 1, F.concat(F.lit("BLINKER-Type "), k)).when(k % 4 == 2, F.format_string("CLASSIFIER-%.4f", (k % 10000) / 10000.0)).otherwise("OTHER")
    return X.read(s, d, "orders").select(k.alias("k"), closure.confidence(origin).alias("trust"))


@query(f"""WITH {_CHAIN_SQL} SELECT a.doc_id, '<html><body><table>' || string_agg('<tr><td>' || a.id || '</td><td>' || CASE WHEN a.n < b.n THEN '&lt;' ELSE '&gt;' END || '</td><td>' || b.id || '</td><td>' || CASE WHEN b.n = a.n + 1 THEN 'user' WHEN b.n = a.n - 1 THEN 'user-inverted' ELSE 'closure' END || '</td></tr>', '' ORDER BY a.id, b.id) || '</table></body></html>' AS html FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.n <> b.n GROUP BY a.doc_id""")
def m14_graph_pages(s, d):
    return evaluate.graph_html(closure.propagate(_chain(s, d)))


# Conversion and evaluation


@query(f"""WITH {X.LINES_SQL}, e AS (SELECT o_custkey AS doc_id, o_orderkey AS k, 'e' || o_orderkey AS eid FROM orders), i AS (SELECT o_custkey AS doc_id, 'e' || o_orderkey AS eid, arg_min('ei' || n, n) AS eiid, arg_min(l_returnflag, n) AS tense FROM orders JOIN li ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT e.doc_id, e.eid, eiid, tense FROM e LEFT JOIN i ON i.doc_id = e.doc_id AND i.eid = e.eid""")
def k01_timebank_instances(s, d):
    o, l = X.read(s, d, "orders"), X.lines(s, d)  # noqa: E741
    none = F.lit(None).cast("int")
    ev = o.select(F.col("o_custkey").alias("doc_id"), F.lit("EVENT").alias("name"), F.lit(0).alias("begin"), F.lit(1).alias("end"), F.lit(0).alias("seq"), F.create_map(F.lit("eid"), F.concat(F.lit("e"), "o_orderkey")).alias("attrs"))
    ins = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc_id"), F.lit("MAKEINSTANCE").alias("name"), none.alias("begin"), none.alias("end"), F.col("n").cast("int").alias("seq"), F.create_map(F.lit("eventID"), F.concat(F.lit("e"), "o_orderkey"), F.lit("eiid"), F.concat(F.lit("ei"), "n"), F.lit("tense"), F.col("l_returnflag")).alias("attrs"))
    a = F.col("attrs")
    return convert.from_timebank(ev.union(ins)).select("doc_id", a["eid"].alias("eid"), a["eiid"].alias("eiid"), a["tense"].alias("tense"))


def _two(s, d):
    g = X.events(s, d).select("doc_id", "begin", "end", "seq", "tense")
    return g, g.filter("seq % 4 <> 0").withColumn("end", (F.col("end") + (F.col("seq") % 5 == 0).cast("int")))


_TWO_SQL = f"""{X.EVENTS_SQL}, g AS (SELECT DISTINCT doc_id, b, e FROM ev), s AS (SELECT DISTINCT doc_id, b, e + CAST(seq % 5 = 0 AS INT) AS e FROM ev WHERE seq % 4 <> 0),
c AS (SELECT coalesce(g.doc_id, s.doc_id) AS doc_id, CAST(count(*) FILTER (WHERE g.b IS NOT NULL AND s.b IS NOT NULL) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE g.b IS NULL) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE s.b IS NULL) AS BIGINT) AS fn FROM g FULL JOIN s ON g.doc_id = s.doc_id AND g.b = s.b AND g.e = s.e GROUP BY 1)"""


@query(f"""WITH {_TWO_SQL} SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) WHEN tp + fp > 0 AND tp + fn > 0 THEN NULL END AS f FROM c""")
def x03_x06_precision_recall(s, d):
    return evaluate.scores(evaluate.entity_counts(*_two(s, d), ["doc_id"]))


@query(f"WITH {_TWO_SQL} SELECT doc_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY ROLLUP (doc_id)")
def x07_totals(s, d):
    return evaluate.totals(evaluate.entity_counts(*_two(s, d), ["doc_id"]), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def x01_common_files(s, d):
    docs = X.read(s, d, "documents")
    return docs.join(evaluate.common(docs, X.read(s, d, "labels"), "doc_id"), "doc_id").select("doc_id", "lang")


@query(f"""WITH {X.EVENTS_SQL} SELECT doc_id, CAST(count(*) AS BIGINT) AS overlap, CAST(count(*) FILTER (WHERE seq % 3 > 0) AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE seq % 3 = 0) AS BIGINT) AS incorrect, count(*) FILTER (WHERE seq % 3 > 0) / count(*) AS accuracy FROM ev WHERE seq % 2 = 0 GROUP BY doc_id""")
def x02_x05_link_accuracy(s, d):
    e = X.events(s, d).select("doc_id", F.col("seq").alias("b1"), F.col("end").alias("e1"), F.col("begin").alias("b2"), F.col("end").alias("e2"), "seq")
    gold = e.withColumn("relation", F.lit("BEFORE"))
    system = e.filter("seq % 2 = 0").withColumn("relation", F.when(F.col("seq") % 3 == 0, "AFTER").otherwise("BEFORE"))
    return evaluate.link_counts(gold, system, ["doc_id"])


@query("""SELECT k, CASE k % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'NO_MATCH_FP' ELSE 'NO_MATCH_FN' END AS status FROM (SELECT o_orderkey AS k FROM orders)""")
def x09_status(s, d):
    k = F.col("o_orderkey")
    v = lambda n, *no: F.when(~(k % 4).isin(*no), F.lit(n)) if no else F.lit(n)
    return X.read(s, d, "orders").select(k.alias("k"), evaluate.status(v(3, 2), v(9, 2), F.when(k % 4 != 3, F.when(k % 4 == 1, 5).otherwise(3)), F.when(k % 4 != 3, F.lit(9))).alias("status"))


@query()
def x10_x12_alignment(s, d):
    """Greedy alignment and its counts; tests hold it against a walk over both lists."""
    return evaluate.alignment_counts(evaluate.align(*_two(s, d)))


@query(f"""WITH {X.EVENTS_SQL}, n AS (SELECT doc_id, b, eiid, CASE WHEN seq % 5 = 0 THEN 'X' ELSE tense END AS tense FROM ev WHERE seq % 3 > 0)
SELECT ev.doc_id, ev.eiid AS name, ev.b AS "begin", CASE WHEN n.eiid IS NULL THEN 'OLD' WHEN n.tense <> ev.tense THEN 'DIFF' ELSE 'SAME' END AS state, CASE WHEN n.eiid IS NOT NULL THEN CASE WHEN n.tense <> ev.tense THEN 'tense' ELSE '' END END AS differ FROM ev LEFT JOIN n ON n.eiid = ev.eiid""")
def x11_x14_baseline(s, d):
    e = X.events(s, d).select("doc_id", F.col("eiid").alias("name"), "begin", "tense", "aspect", "seq")
    new = e.filter("seq % 3 > 0").withColumn("tense", F.when(F.col("seq") % 5 == 0, "X").otherwise(F.col("tense")))
    return evaluate.compare_baseline(e, new, ["tense", "aspect"])


@query("""SELECT 'c' || o_orderkey AS identifier, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '+' END AS "2015", CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '+' END AS "2020" FROM orders""")
def x13_trend(s, d):
    k = F.col("o_orderkey")
    runs = X.read(s, d, "orders").select(F.concat(F.lit("c"), k).alias("identifier"), F.explode(F.array(F.struct(F.lit("2015").alias("run"), F.when(k % 3 == 0, "-").otherwise("+").alias("result")), F.struct(F.lit("2020").alias("run"), F.when(k % 5 == 0, "-").otherwise("+").alias("result")))).alias("r"))
    return evaluate.trend(runs.select("identifier", "r.run", "r.result"))


@query("""SELECT 'c' || o_orderkey AS row, '<tr><td>c' || o_orderkey || '</td><td>' || CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '+' END || '</td><td>' || CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '+' END || '</td></tr>' AS html FROM orders""")
def x13_trend_rows(s, d):
    return evaluate.html_rows(x13_trend(s, d), ["identifier", "2015", "2020"])


@query("""WITH o AS (SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y') AS y FROM orders), l AS (
SELECT doc_id, 'ei2' AS src, 't1' AS tgt, 'IS_INCLUDED' AS relation FROM o UNION ALL SELECT doc_id, 'ei3', 'ei4', 'AFTER' FROM o UNION ALL SELECT doc_id, 'ei4', 'ei5', 'BEFORE' FROM o UNION ALL SELECT doc_id, 'ei5', 't2', 'BEFORE' FROM o
UNION ALL SELECT doc_id, 't1', 't2', CASE WHEN y < '1996' THEN 'BEFORE' WHEN y > '1996' THEN 'AFTER' ELSE 'IS_INCLUDED' END FROM o)
SELECT doc_id, src, tgt, relation, 'LINK_MERGER' AS origin FROM l UNION ALL
SELECT doc_id, tgt, src, CASE relation WHEN 'BEFORE' THEN 'AFTER' WHEN 'AFTER' THEN 'BEFORE' ELSE 'INCLUDES' END, 'LINK_MERGER' FROM l""")
def pipeline_over_sentences(s, d):
    """All stages but the classifier over two sentences an order: times, events, links from subordination and by rule, made consistent."""
    from .pipeline import Options, run

    docs = X.sentences(s, d).withColumn("text", F.concat("text", F.lit(" He said the buyer wanted to pay before 1996.")))
    t = run(docs, Options(pipeline="PREPROCESSOR,GUTIME,EVITA,SLINKET,S2T,BLINKER,LINK_MERGER"))
    return annotate.links(t).filter("kind = 'TLINK'").select("doc_id", "src", "tgt", "relation", "origin")


@query()
def classifier_over_sentences(s, d):
    """A model trained on the links of rules between neighbours, and links by it: the stage CLASSIFIER."""
    from .pipeline import Options, _cut, run

    docs = X.sentences(s, d).withColumn("text", F.concat("text", F.lit(" He said the buyer wanted to pay before 1996.")))
    t = _cut(run(docs, Options(pipeline="PREPROCESSOR,GUTIME,EVITA,SLINKET,S2T,BLINKER")))
    gold = annotate.links(t).filter("kind = 'TLINK'").select("doc_id", "src", "tgt", "relation")
    model = vectors.train(vectors.label(vectors.of_tags(t), gold))
    from .pipeline import classifier

    return annotate.links(classifier(t, Options(model=model))).filter("origin like 'CLASSIFIER%'").select("doc_id", "src", "tgt", "relation", "origin")
