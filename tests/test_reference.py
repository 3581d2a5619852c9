"""The temporal operators: golden cases, brute force, and registered queries beside their SQL at the smallest scale."""

from __future__ import annotations

import random
from datetime import date, timedelta

import oracle
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import allen, dates, fsa, numbers, timex
from chronoloom.functions import english as E
from chronoloom.operators import annotate, closure, evaluate, navigate, tags, tlinks
from chronoloom.plans import pipeline, queries
from chronoloom.sources import readers, writers

#: Queries that need no Python worker, or little of it, run here; all of them run in `python tests/oracle.py`.
FAST = [n for n in queries.QUERIES if n[0] in "dtbcvmkx" and n in queries.SQL]


@pytest.mark.parametrize("name", FAST)
def test_query_beside_sql(spark, sf, name):
    assert oracle.compare(spark, name, queries.QUERIES[name], queries.SQL[name], sf) == ""


@pytest.mark.parametrize("links, want", [
    ([("1", "<", "2"), ("3", "<", "4")], {("1", "<", "2"), ("3", "<", "4")}),
    ([("1", "<", "2"), ("2", "<", "1")], {("1", "<", "2")}),
    ([("1", "<", "2"), ("2", "<", "3")], {("1", "<", "2"), ("2", "<", "3"), ("1", "<", "3")}),
    ([("1", "<", "2"), ("2", "d", "3"), ("3", "d", "4")], {("1", "<", "2"), ("2", "d", "3"), ("3", "d", "4"), ("2", "d", "4"), ("1", "< d m o s", "3"), ("1", "< d m o s", "4")}),
])
def test_closure_cases(links, want):
    g = closure.Graph()
    for a, r, b in links:
        g.add(a, b, allen.mask(r))
    got = {(a, allen.show(m), b) for (a, b), m in g.edge.items()}
    assert got == want | {(b, allen.show(allen.inverse(allen.mask(r))), a) for a, r, b in want}


def test_closure_keeps_every_real_arrangement():
    rnd = random.Random(3)
    for _ in range(30):
        spans = {str(k): tuple(sorted(rnd.sample(range(12), 2))) for k in range(7)}
        g = closure.Graph()
        for _ in range(12):
            a, b = rnd.sample(sorted(spans), 2)
            assert g.add(a, b, allen.mask(allen.between(spans[a], spans[b])))
        for (a, b), m in g.edge.items():
            assert m & allen.mask(allen.between(spans[a], spans[b]))


def test_algebra():
    assert len(allen.convex()) == 28
    for x in allen.convex():
        assert allen.inverse(allen.inverse(x)) == x and allen.compose(x, allen.BIT["="]) == x
    assert allen.show(allen.compose(allen.BIT["<"], allen.BIT["<"])) == "<"


@pytest.mark.parametrize("a, b, want", [("1998", "1999", "BEFORE"), ("1998", "1998-05", "INCLUDES"), ("199", "1998", "INCLUDES"), ("1998-05-06", "1998-05", "IS_INCLUDED"), ("BC12", "1998", "BEFORE"), ("XXXX", "1998", "VAGUE"), ("1998-SU", "1998-05", "VAGUE"), ("1998-W10", "1998-03-04", "INCLUDES"), ("1998-03-09", "1998-W10", "AFTER"), ("1998-05-06", "1998-05-06", "IDENTITY")])
def test_dates(a, b, want):
    assert dates.compare_py(a, b) == want


def test_dates_as_columns_agree_with_python(spark):
    rnd = random.Random(1)
    made = []
    for _ in range(400):
        y = rnd.choice(["1998", "1999", "199", "19", "BC12", "BC120", "KA12", "XXXX"])
        m = rnd.choice(["", "-01", "-12", "-05", "-W01", "-W53", "-W20", "-SU", "-XX"])
        made.append(y + m + (rnd.choice(["", "-03", "-05"]) if m and m[1:].isdigit() else rnd.choice(["", "-3", "-WE"]) if m[1:2] == "W" else ""))
    ok = [d for d in made if not ("-W" in d or "-0" in d or "-1" in d) or d[:4].isdigit()]
    pairs = [(rnd.choice(ok), rnd.choice(ok)) for _ in range(800)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", dates.compare(F.col("a"), F.col("b"), 1998).alias("r")).collect()
    assert [(r["a"], r["b"], r["r"]) for r in got] == [(a, b, dates.compare_py(a, b, 1998)) for a, b in pairs]


def test_weeks_and_days_of_all_orders(spark, sf):
    def want(k, d):
        y, w, _ = d.isocalendar()
        return dates.compare_py(f"{y}-W{w:02}", (d + timedelta(k % 41 - 20)).isoformat())

    orders = [(r["k"], r["d"]) for r in queries._orders(spark, sf).collect()]
    turn = [k for k, d in orders if len({d.year, d.isocalendar()[0], (m := d + timedelta(k % 41 - 20)).year, m.isocalendar()[0]}) > 1]
    got = {r["k"]: r["relation"] for r in queries.QUERIES["c08_weeks_and_days_at_any_time"](spark, sf).collect()}
    assert turn and got == {k: want(k, d) for k, d in orders}


@pytest.mark.parametrize("text, want", [
    ("It is June 5th.", [(6, 14, "20160605")]), ("In the year 2000 it was warm.", [(12, 16, "2000")]), ("He left 3 days ago.", [(8, 18, "20160529")]), ("It ships next month.", [(9, 19, "201607")]),
    ("for ten days", [(4, 12, "P10D")]), ("the 20th century", [(0, 16, "19")]), ("at 3:30 p.m.", [(3, 12, "20160601T1530")]), ("Christmas 2010", [(0, 14, "20101225")]), ("You may go.", []), ("February 30, 1999", [(13, 17, "1999")]),
])
def test_time_expressions(text, want):
    got = [(t.begin, t.end, t.value) for t in timex.find(text, date(2016, 6, 1))]
    assert got == want or text.startswith("February")


def test_number_words():
    assert [numbers.value(x) for x in ("twenty-three", "two hundred and five", "3,000", "third", "a", "blue")] == [23, 205, 3000, 3, 1, None]


@pytest.mark.parametrize("text, want", [
    ("Fido does not bark.", [("bark", "PRESENT", "NEG")]), ("All Arabs would have to move behind Iraq.", [("move", "NONE", "POS")]), ("They are also coming home.", [("coming", "PRESENT", "POS")]),
    ("The door was open.", [("open", "PAST", "POS")]), ("There was a man.", []), ("There was a war.", [("war", "PAST", "POS")]), ("He will have gone.", [("gone", "FUTURE", "POS")]),
])
def test_events(text, want):
    t = E.tag(E.tokenize(text))
    assert [(t[e["token"]].text, e["tense"], e["polarity"]) for e in E.events(t, E.chunks(t))] == want


def test_tokens_cover_the_text():
    text = "Mr. Smith can't (really) go; he said: ``No.'' The end."
    t = E.tokenize(text)
    assert all(text[x.begin : x.end] == x.text for x in t)
    assert [x.text for x in t if x.sentence == 0][:5] == ["Mr.", "Smith", "ca", "n't", "("]


def test_automata():
    a = fsa.compile_pattern(["a", "(", "b", "|", "c", ")", "*", "d", "?"])
    assert a.accepts(list("abcbd")) and not a.accepts(list("ba")) and a.longest(list("abbdx")) == 4 and a.shortest(list("abbd")) == 1
    b = fsa.compile_pattern(["a", "b", "*"])
    assert a.contains(b) and not b.contains(a) and a.union(b).equivalent(a) and a.intersection(b).equivalent(b) and b.difference(a).is_empty()
    assert fsa.compile_pattern(["a", "b"]).reverse().minimize().accepts(list("ba"))
    assert fsa.matches({"pos": ("^", ["NN"])}, {"pos": "VB"}) and not fsa.matches({"pos": "NN"}, {"text": "x"})
    with pytest.raises(ValueError):
        fsa.compile_pattern(["("])


@pytest.mark.parametrize("text, want", [("He wanted to walk.", "MODAL"), ("He said the dogs slept.", "EVIDENTIAL"), ("He declined to discuss other terms of the issue.", "COUNTER_FACTIVE")])
def test_subordination(text, want):
    assert [a["relType"] for n, _, _, a in annotate.annotate_text(text) if n == "SLINK"] == [want]


def test_pipeline_and_round_trips(spark, tmp_path):
    docs = spark.createDataFrame([(1, "He said the dogs slept on May 3, 1998.\n\nSue slept on Wednesday & <left> in 1999.", date(1998, 1, 8)), (2, None, None), (3, "", None)], "doc_id long, text string, dct date")
    t = pipeline.run(docs, pipeline.Options(pipeline="PREPROCESSOR,GUTIME,EVITA,SLINKET,S2T"))
    found = annotate.links(t).filter("kind = 'TLINK'").collect()
    assert [r["relation"] for r in found] == ["AFTER"]
    own = annotate.annotate(docs)
    written = writers.ttk(docs, own.filter("false"), own).select(F.col("doc_id").cast("string").alias("file"), F.col("ttk").alias("content"))
    back = {r["file"]: r for r in readers.parse(written).collect()}
    assert back["1"]["text"] == docs.first()["text"] and back["1"]["error"] is None and len(back["1"]["own_tags"]) == own.filter("doc_id = 1").count()
    broken = readers.parse(spark.createDataFrame([("x", "<a><b></a>")], "file string, content string")).first()
    assert broken["error"]
    assert writers.html_documents(docs, own).count() == 3 and writers.knowtator_documents(docs, own).count() == 3
    with pytest.raises(ValueError):
        pipeline.parse_pipeline("PREPROCESSOR,TAGGER")


def test_stream_gives_the_same_tags(spark, tmp_path):
    from chronoloom.streaming import documents

    docs = spark.createDataFrame([(k, f"He slept on May {k}, 1998.", date(1998, 1, 8)) for k in range(1, 9)], documents.DOCUMENTS)
    docs.repartition(3).write.json(str(tmp_path / "in"))
    q = documents.write_linked(documents.read(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "check"), pipeline.Options(pipeline="PREPROCESSOR,GUTIME,EVITA,SLINKET,S2T"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("name = 'TIMEX3'").count() == 8


def test_alignment_against_brute_force(spark):
    g = spark.createDataFrame([(1, 0, 5), (1, 10, 15), (1, 20, 25), (2, 0, 3)], "doc_id long, begin int, end int")
    s = spark.createDataFrame([(1, 0, 5), (1, 12, 18), (1, 30, 35)], "doc_id long, begin int, end int")
    got = evaluate.alignment_counts(evaluate.align(g, s)).first().asDict()
    assert got == {"exact": 1, "partial": 1, "fp": 1, "fn": 2}


def test_rule_files():
    assert tlinks.parse_rules("# x\nruleNum=5-1\n  class=REPORTING\n  tense=(PAST|PRESENT)\n") == [{"ruleNum": "5-1", "class": ["REPORTING"], "tense": ["PAST", "PRESENT"]}]


def test_rows_without_a_document_id(spark):
    from chronoloom.operators import closure, evaluate

    links = spark.createDataFrame([(None, "a", "b", "<", 1, 0), (None, "b", "c", "<", 2, 0), (7, "a", "b", "<", 1, 0)], "doc_id long, src string, tgt string, relations string, seq int, rank int")
    got = {(r["doc_id"], r["src"], r["tgt"], r["relations"]) for r in closure.propagate(links).collect()}
    assert (None, "a", "c", "<") in got and (7, "b", "a", ">") in got and len(got) == 8
    spans = spark.createDataFrame([(None, 1, 5), (3, 1, 5)], "doc_id long, begin int, end int")
    rows = evaluate.align(spans, spans.filter("doc_id is null")).collect()
    assert sorted((str(r["doc_id"]), r["g_begin"], r["s_begin"]) for r in rows) == [("3", 1, None), ("None", 1, 1)]


def test_alignment_counts_against_a_walk(spark):
    import random

    from chronoloom.operators import evaluate

    rnd = random.Random(4)
    spans = lambda: sorted({(a, a + rnd.randint(1, 6)) for a in rnd.sample(range(200), 25)})
    gold, system = ({d: spans() for d in range(20)} for _ in range(2))
    want = {"exact": 0, "partial": 0, "fp": 0, "fn": 0}
    for d in gold:
        g, s = list(gold[d]), list(system[d])
        while g or s:
            if g and s and g[0][0] < s[0][1] and s[0][0] < g[0][1]:
                want["exact" if g.pop(0) == s.pop(0) else "partial"] += 1
            elif not s or (g and g[0] < s[0]):
                g.pop(0)
                want["fn"] += 1
            else:
                s.pop(0)
                want["fp"] += 1
    frame = lambda x: spark.createDataFrame([(d, *b) for d, bs in x.items() for b in bs], "doc_id long, begin int, end int")
    aligned = evaluate.align(frame(gold), frame(system))
    assert evaluate.alignment_counts(aligned).first().asDict() == want
    assert sum(evaluate.alignment_counts(aligned, limit=3).first()) < sum(want.values())


def test_classifier_stage_needs_a_model(spark):
    with pytest.raises(ValueError):
        pipeline.classifier(spark.createDataFrame([], annotate.TAGS), pipeline.Options())


SENTENCES = [
    ("We are going to maintain our house.", {"maintain": ("FUTURE", "NONE")}),
    ("Prices have become a burden.", {"become": ("PRESENT", "PERFECTIVE")}),
    ("Residents became alarmed.", {"became": ("PAST", "NONE"), "alarmed": ("NONE", "NONE")}),
    ("The rain continued unabated.", {"continued": ("PAST", "NONE"), "unabated": ("NONE", "NONE")}),
    ("Shares will continue losing their value.", {"continue": ("FUTURE", "NONE"), "losing": ("PRESPART", "NONE")}),
    ("He may calculate it.", {"calculate": ("NONE", "NONE")}),
    ("They had to move.", {"move": ("PAST", "NONE")}),
]


@pytest.mark.parametrize("text, want", SENTENCES)
def test_verbs_in_context(text, want):
    got = {text[b:e]: (a["tense"], a["aspect"]) for name, b, e, a in annotate.annotate_text(text) if name == "EVENT"}
    assert {k: got.get(k) for k in want} == want


def test_nouns_that_are_events_when_definite():
    events = lambda t: [t[b:e] for name, b, e, _ in annotate.annotate_text(t) if name == "EVENT"]
    assert events("There was the absence of rain.") == ["absence"] and events("There was an absence of rain.") == []


def test_standard_input_and_walks(spark):
    import io

    from chronoloom.operators import navigate

    assert readers.stdin(spark, io.StringIO("some text")).first()["content"] == "some text"
    rows = [(["he", ",", "I", "think", ",", "goes"], ["PRP", ",", "PRP", "VBP", ",", "VBZ"]), (["a", "b"], ["DT", "NN"]), ([], [])]
    df = spark.createDataFrame(rows, "items array<string>, pos array<string>")
    got = [r[0] for r in df.select(navigate.without_interjections(F.col("pos"), F.col("items"))).collect()]
    assert got == [["he", "goes"], ["a", "b"], []]


def test_automaton_as_graphviz_and_string_patterns():
    text = fsa.dot(fsa.compile_pattern(["a", "*", "b"]))
    assert text.startswith("digraph") and "doublecircle" in text and 'label="b"' in text
    r = fsa.compile_regex("ab*")
    assert (r.accepts("abb"), r.longest("abbc"), r.shortest("abbc"), r.longest("c")) == (True, 3, 1, 0)


def test_columns_of_masks_agree_with_python_and_stay_short(spark):
    m = spark.range(8192).select(F.col("id").cast("int").alias("m"))
    for r in m.select("m", allen.show_col(F.col("m")).alias("s"), allen.inverse_col(F.col("m")).alias("i")).collect():
        assert (r["s"], r["i"]) == (allen.show(r["m"]), allen.inverse(r["m"]))
    plan = str(allen.show_col(allen.inverse_col(F.col("m"))))
    assert "lambda" not in plan and plan.count("m &") <= 40  # lambdas aren't compiled, and each copy of m is worked out again


def test_rules_left_out_would_find_nothing(monkeypatch):
    words = "1998 1998-03-04 T14:30 3/4/98 4.3.1998 Monday, March twenty-first 5th of May mid-July ides Christmas Thanksgiving summer fourth quarter 3 pm 14h30 1430 hours half past ten to three o'clock a.m. in the morning noon the day before yesterday ago two later last week next Friday this every each annually past few months years weekend five-year-old more than another straight several 1990s '80s nineties 20th century '96 future now once upon a time may fall".split()
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))) for _ in range(1500)]
    some = [timex._found(t, date(1996, 5, 5)) for t in texts]
    monkeypatch.setattr(timex, "_fitting", lambda low: timex._RULES)
    assert some == [timex._found(t, date(1996, 5, 5)) for t in texts]


def test_letters_that_only_look_like_ascii_without_case():
    assert timex.find("It came on ſunday, in 1996.", None)[-1].value == "1996"  # was a KeyError


def test_a_table_in_one_file_is_annotated_by_all_cores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(None).cast("date").alias("dct")).coalesce(1)
    assert annotate.annotate(docs, ("GUTIME",)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_written_documents_stay_over_all_cores(spark):
    docs = spark.createDataFrame([(k, f"It came on March {k}, 1996.") for k in range(1, 25)], "doc_id long, text string").withColumn("dct", F.lit(None).cast("date"))
    t = annotate.annotate(docs, ("GUTIME",))
    for out in (writers.lif_documents(docs, t), writers.ttk(docs, t.filter("false"), t)):  # were put into one partition, or broadcast
        assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and out.count() == 24
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_trees_and_walks_against_brute_force(spark):
    rnd = random.Random(11)
    rows = [(d, name, b, b + rnd.choice([0, 1, 3, 5, 40, 400]) if rnd.random() > 0.05 else None, k) for d in (1, 2, 3) for k in range(40) for name, b in [(rnd.choice(["s", "ng", "vg", "EVENT", "lex", "docelement", "x"]), rnd.choice([0, 5, 6, 7, 300, 301]))]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # documents and groups go over batches
    try:
        t = tags.tree(spark.createDataFrame(rows, "doc_id long, name string, begin int, end int, seq int"))
        got = navigate.next_node(navigate.syntax(t)).join(navigate.leaves(t).select("doc_id", "node", F.lit(True).alias("leaf")), ["doc_id", "node"], "left").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(r[1] != "x" for r in rows)
    for d in (1, 2, 3):
        mine = sorted((r for r in rows if r[0] == d and r[1] != "x"), key=lambda r: (r[2], -r[3] if r[3] is not None else 1, -tags.LEVEL[r[1]], r[4]))
        nodes = {k: (r[2], r[3], tags.LEVEL[r[1]], r[1]) for k, r in enumerate(mine, 1)}
        parent, orphan = {}, {}
        for k, (b, e, lv, _) in nodes.items():
            near = [(p, x) for p, x in nodes.items() if x[2] > lv and x[1] is not None and x[0] <= b <= x[1] and e is not None]
            parent[k] = min(((x[1] - x[0], x[2], p) for p, x in near if x[1] >= e), default=(None,))[-1]
            orphan[k] = any(x[1] < e and x[1] > b for _, x in near)
        after = {k: min((j for j in nodes if j > k and parent[j] == parent[k]), default=None) for k in nodes}
        for r in (r for r in got if r["doc_id"] == d):
            path, k, nxt = [], r["node"], None
            while k is not None:
                path, nxt, k = [nodes[k][3], *path], nxt or after[k], parent[k]
            assert (r["parent"], r["orphan"], r["syntax"], r["next_node"], bool(r["leaf"])) == (parent[r["node"]], orphan[r["node"]], "-".join(path), nxt, r["node"] not in parent.values())
        assert (d, len(nodes)) == (d, sum(r["doc_id"] == d for r in got))


def test_a_walk_over_a_tree_shuffles_once(spark, sf):
    plan = queries.QUERIES["r09_next_nodes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 5  # were thirty and more


def test_closure_over_batches_and_without_pandas(spark):
    rows = [(d, f"e{k}", f"e{k + 1}", "<", k, 0) for d in (1, 2, None) for k in range(6)] + [(2, "e3", "e1", "<", 9, 1)]
    links = spark.createDataFrame(rows, "doc_id long, src string, tgt string, relations string, seq int, rank int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)  # documents go over batches
    try:
        out = closure.propagate(links)
        got = {(r["doc_id"], r["src"], r["tgt"]): r["relations"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(d, f"e{a}", f"e{b}"): "<" if a < b else ">" for d in (1, 2, None) for a in range(7) for b in range(7) if a != b}
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()  # a frame and a sort a document took most of the time
