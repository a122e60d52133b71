from datetime import datetime

from coursegrain.llm.survivor import merged_records, precedence, survivor_slides, survivors, transitions, classified

SCHEMA = "course_code string, module_number string, fact_id string, fact_row long, statement string, slides array<int>, kind string, topic string, method string, extracted_at timestamp, text string, cls int"


def at(day):
    return datetime(2025, 1, day)


def row(n, statement, *, fact_id="f1", method="text", day=1, slides=(1,), course="C", kind=None, topic=None):
    return (course, "1", fact_id, n, statement, None if slides is None else list(slides), kind, topic, method, None if day is None else at(day), "clash", 7)


def test_rules_of_choice(spark):
    rows = [
        row(1, "the ocr one is much longer than all others", method="ocr", slides=(3, -1, 0)),
        row(2, "the short text", fact_id=" F1 ", slides=(None, 5, 5)),
        row(3, "the  longer \n text here", day=2, slides=None),
        row(4, "the longer text here", day=4, slides=()),
        row(5, "the longer text here", day=4),
        row(6, "n/a", day=9),
        row(7, None, day=9),
        row(8, "alone in its group", fact_id="f2"),
        row(9, "[Unreadable Text]", fact_id="f3"),
        row(10, "n/a", fact_id="f3"),
        row(11, "no key at all", fact_id=None),
        row(12, "no key at all", fact_id=None),
        row(13, "same thing twice", fact_id="f4", slides=(0,)),
        row(13, "same thing twice", fact_id="f4", slides=None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.fact_key, r.fact_row) for r in survivors(df).collect()) == [("f1", 4), ("f4", 13)]
    assert sorted((r.fact_key, r.fact_row, r.slide) for r in survivor_slides(df).collect()) == [("f1", 4, 1), ("f1", 4, 3), ("f1", 4, 5)]
    merged = {r.fact_key: r for r in merged_records(df).collect()}
    assert merged["f1"].n_slides == 3 and merged["f4"].n_slides == 0 and merged["f1"].statement == "the longer text here"
    assert survivor_slides(df.limit(0)).count() == 0 and merged_records(df.limit(0)).count() == 0


def test_currency_places_rows_without_time(spark):
    # everywhere capitals come first and a plain statement after them, so an untimed plain row is later than timed capitals
    rows = []
    for k in range(4):
        rows += [row(10 * k, "ALL THE LETTERS ARE LARGE.", fact_id=f"g{k}", day=3), row(10 * k + 1, "all the letters are small.", fact_id=f"g{k}", day=5)]
    rows += [row(100, "ALL THE LETTERS ARE LARGE.", fact_id="x", day=20), row(101, "all the letters are small.", fact_id="x", day=None)]
    df = spark.createDataFrame(rows, SCHEMA)
    learned = [(r.before, r.after, r.n) for r in transitions(classified(df)).collect()]
    assert learned == [(3, 5, 4)]
    assert {r.fact_key: r.fact_row for r in survivors(df).collect()}["x"] == 101


def test_precedence_never_has_a_cycle():
    before, level = precedence([(0, 1, 9), (1, 2, 8), (2, 0, 3), (0, 2, 1), (3, 4, 2), (4, 3, 2)])
    assert before[2] == {0, 1} and level == {0: 0, 1: 1, 2: 2, 3: 0, 4: 0}
    assert precedence([]) == ({}, {})


def test_kind_and_topic_of_rows_without_time(spark, monkeypatch):
    from coursegrain.llm import survivor

    # drafts become content everywhere; capitals are written before small letters
    rows = []
    for k in range(4):
        rows += [row(10 * k, "ALL THE LETTERS ARE LARGE.", fact_id=f"g{k}", day=3, kind="draft", topic="old"), row(10 * k + 1, "all the letters are small.", fact_id=f"g{k}", day=5, kind="content", topic="new")]
    rows += [row(100, "ALL THE LETTERS ARE LARGE.", fact_id="x", day=20, kind="draft", topic="old"), row(101, "all the letters are small.", fact_id="x", day=None, kind=" Content ", topic="new")]
    rows += [row(110, "all the letters are small.", fact_id="y", day=20, kind="content", topic="new"), row(111, "ALL THE LETTERS ARE LARGE.", fact_id="y", day=None, kind="draft", topic="old")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.fact_key: (r.kind, r.topic) for r in merged_records(df).collect()}
    assert got["x"] == ("Content", "new") and got["y"] == ("content", "new")
    ten = df.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).selectExpr("concat(course_code, copy) AS course_code", "module_number", "fact_id", "fact_row * 10 + copy AS fact_row", "statement", "slides", "kind", "topic", "method", "extracted_at", "text", "cls")
    assert {(r.fact_key, r.kind, r.topic) for r in merged_records(ten).where("fact_key = 'x'").collect()} == {("x", "Content", "new")}
    monkeypatch.setattr(survivor, "precedence", lambda counted: ({}, {}))  # nothing learned: the row without a time says nothing about it
    got = {r.fact_key: (r.kind, r.topic, r.fact_row) for r in merged_records(df).collect()}
    assert got["x"] == ("draft", "old", 100)


def test_repeated_rows_make_one_record(spark):
    df = spark.createDataFrame([row(13, "same thing twice"), row(13, "same thing twice")], SCHEMA)
    assert merged_records(df).count() == 1
