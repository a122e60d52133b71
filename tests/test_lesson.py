import json

import pytest
from pyspark.sql import functions as F

from coursegrain.functions import cards as C
from coursegrain.functions import graph as G
from coursegrain.functions import lesson as L
from coursegrain.operators import relational as R
from coursegrain.sources.files import card_lines, read_graphs, read_text, replayed
from coursegrain.streaming.corpus import keep_corpus


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("f,text,want", [
    (L.cleaned, " a\0b \r\n\r\n\n\nc\t d ", "a b \n\nc d"), (L.cleaned, None, None), (L.without_specks, "ab\n~\n\n.-\nc", "ab\n\nc"),
    (L.lesson_fact, " - 1. A  fact\nhere", "A fact here"), (L.normal_form, "The C-3 pump ﬁts!", "the c 3 pump fits"), (G.entity_key, "Republic Act 8044", "legal:act:8044"), (G.entity_key, "RA  8044", "legal:act:8044"),
    (G.entity_key, " Big  Pump", "big pump"), (G.entity_key, "1425", "legal:unknown:1425"), (L.module_label, "007", "7"), (L.module_label, "x/1", "x_1"), (C.stem, "studies", "study"), (C.stem, "glass", "glass"), (C.stem, "valves", "valv"), (C.stem, "safety", "safe"),
    (G.relation, "was Created_By", "created_by"), (G.relation, "runs", None), (C.canonical_option, " C ++ is", "c++ is"), (C.canonical_option, "A – B.", "a-b"), (C.canonical_option, "x = y;", "x=y;"), (C.canonical_option, "the pump;", "the pump"),
])
def test_text_functions(spark, f, text, want):
    assert one(spark, text, f) == want


FACTS = [
    ("- 3) The  pump moves\u00a0water.", None, "content", None), ("◦ A pump moves water.", "", "content", None), (None, None, None, "missing"), ("[Unreadable Text]", None, None, "missing"), ("Pump.", None, None, "short"), ("The Pump!", "- the pump", None, "topic"), ("水 は冷たい。", None, None, None),
    ("See DOI : 10.1/x now", None, None, "address"), ("Why is it cold?", None, None, "question"), ("Module 3: Pumps", None, None, "section_path"), ("Section - basics of pumps", None, None, "section_path"), ("Learning objectives of today", None, None, "objective"),
    ("Students will be able to pump.", None, None, "objective"), ("The first slide shows a pump.", None, None, "presentation"), ("This lesson covers pumps.", None, None, "presentation"), ("The lesson coverslip is thin.", None, None, None), ("Heat is a key topic discussed in class.", None, None, "presence_only"),
    ("Pumps, as mentioned in this chapter, move water.", None, None, "provenance"), ("The quote by Cicero says that pumps work.", None, None, "quote_meta"), ("Quote from says it all", None, None, "quote_meta"), ("The title of Module 3 is Pumps.", None, None, "label"),
    ("Module 3 is titled Pumps.", None, None, "label"), ("Module 3 | title | Pumps", None, None, "section_path"), ("The module is titled Pumps.", None, None, "label"), ("Content of this slide mentions pumps.", None, None, "label"), ("A software module exposes a public interface.", None, None, None),
    ("A document title identifies a work.", None, None, None), ("A pump moves water.", None, " Heading", "structural"), ("the pump moves water.", None, "Content", "not_self_contained"), ("the pump moves water.", None, "definition", None), ("It moves water.", None, "content", "not_self_contained"),
    ("IT moves water.", None, "content", None), ("The pump moves water to", None, "content", "not_self_contained"), ("Pumps move.", None, "content", None), ("Pumps 12.", None, "content", "not_self_contained"), ("Pumps Valves Pipes", None, "content", "not_self_contained"), ("Pumps: valves and pipes", None, "content", None),
    ("Pressure increases with depth below", None, "content", None), ("Éste es el éxito", None, "content", "not_self_contained"), ("Old pumps often move cold water along long pipes", None, "content", None), ("Old Pumps Often Move Cold Water Along Pipes", None, "content", None), ("OLD PUMPS OFTEN MOVE COLD WATER ALONG PIPES", None, "content", "not_self_contained"),
]


def test_lesson_fact_reasons(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(FACTS)], "k int, s string, topic string, kind string, want string").withColumn("s", L.lesson_fact(F.col("s")))
    got = df.select("k", "s", "want", L.no_fact_reason(F.col("s"), F.col("topic"), F.col("kind")).alias("reason")).orderBy("k").collect()
    assert [(r.s, r.reason) for r in got] == [(r.s, r.want) for r in got]
    assert [r.s for r in got[:2]] == ["The pump moves water.", "A pump moves water."]


def test_durations(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 61.4, 3600.0)], "s double").select(L.duration(F.col("s")).alias("x"))
    assert [r.x for r in df.collect()] == ["0s", "1m 01s", "1h 00m 00s"]


def test_components_of_a_long_path_and_hot_star(spark):
    edges = [(f"p{k:03}", f"p{k + 1:03}") for k in range(60)] + [("hub", f"leaf{k}") for k in range(300)] + [("solo", "solo"), (None, "x")]
    got = {r.node: r.component for r in R.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"p{k:03}"] for k in range(61)} == {"p000"} and {got[f"leaf{k}"] for k in range(300)} == {"hub"} and got["solo"] == "solo"
    assert R.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_windows_and_budgets(spark):
    df = spark.createDataFrame([(1, list("abcdefg")), (2, []), (3, None)], "k long, t array<string>")
    assert [(r.k, r.first, r.last, r.chunk) for r in R.windows(df, ["k"], F.col("t"), 4, 1).orderBy("k", "first").collect()] == [(1, 0, 4, "a b c d"), (1, 3, 7, "d e f g")]
    s = spark.createDataFrame([("c", k, "x" * 9) for k in range(5)] + [("d", 1, "y" * 99)], "g string, o long, s string")
    assert sorted((r.g, r.o) for r in R.recent_within_budget(s, ["g"], "s", "o", 50, 30).collect()) == [("c", 2), ("c", 3), ("c", 4), ("d", 1)]


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("﻿x\ny", encoding="utf-8")
    assert read_text(spark, str(tmp_path / "t")).first().text == "x\ny"
    (tmp_path / "g").mkdir()
    (tmp_path / "g/good.json").write_text(json.dumps({"nodes": [], "edges": [], "facts": []}))
    (tmp_path / "g/bad.json").write_text("{nope")
    (tmp_path / "g/part.json").write_text(json.dumps({"nodes": []}))
    assert sorted(str(r.error) for r in read_graphs(spark, str(tmp_path / "g")).collect()) == ["None", "edges missing", "not a JSON object"]
    req = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "request_key string, attempt int")
    rec = spark.createDataFrame([("a", 1, '```json\n{"x": 1}\n```'), ("b", 1, "sorry {")], "request_key string, attempt int, raw string")
    assert {r.request_key: r.body for r in replayed(req, rec).collect()} == {"a": '{"x": 1}', "b": None, "c": None}


def test_card_file(spark):
    cols = "card_id long, course_code string, module_number string, cluster string, card_pos int, card_type string, question string, correct_option string, wrong_option_1 string, wrong_option_2 string, wrong_option_3 string, is_true int, expalanation string, hint string, difficulty int"
    df = spark.createDataFrame([(k, "C", "1", f"u{k:02}", 1, "true-false", 'say "x", y', None, None, None, None, 1, "e", "h", 2) for k in range(5)], cols)
    lines = [r.line for r in card_lines(df, 3).orderBy("line_no").collect()]
    assert [x[:8] for x in lines] == ["Module 1", "Type,Que"] + ["true-fal"] * 3 + ["", "Module 1", "Type,Que"] + ["true-fal"] * 2
    assert lines[0] == "Module 1.1" and lines[2].startswith('true-false,"say ""x"", y",,,,,1,e,h,2,u00,C,1')


def test_corpus_stream(spark, tmp_path):
    src, corpus = str(tmp_path / "in"), str(tmp_path / "corpus")
    schema = "course_code string, question string, card_id long"
    for rows in ([("C", "What is it?", 1), ("C", "what is  it", 2)], [("C", "What is it", 3), ("D", "What is it", 4), ("C", "New?", 5), ("C", None, 6)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        keep_corpus(spark.readStream.schema(schema).parquet(src), corpus, str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.course_code, r.stem, r.card_id) for r in spark.read.parquet(corpus).collect()) == [("C", "new", 5), ("C", "what is it", 1), ("D", "what is it", 4)]
