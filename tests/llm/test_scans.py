import pytest
from pyspark.sql import functions as F

from coursegrain.llm.scans import PAGE_NUMBER, _lines, misread_words, noisy_lines, page_lines, repaired, slide_lines


@pytest.mark.parametrize("line,yes", [("12", True), ("p. l2", True), ("Page 3 of 8", True), ("- 4 -", True), ("[44]", True), ("17 / 24", True), ("xiv", True), ("p. ll", True), ("mild", False), ("12 volts", False), ("page", False), ("", False), ("sol", False)])
def test_page_numbers(spark, line, yes):
    assert spark.createDataFrame([(line,)], "l string").select(F.col("l").rlike(PAGE_NUMBER).alias("y")).first().y is yes


def tables(spark):
    body = lambda k: f"{'One two three four five six'.split()[k]} muscle moves the water and the valve\nopens the pipe of the muscle because the water is cold."
    pages = [(k, "C", "1", k, f"Notes on the Pump\n{body(k)}\n{k}") for k in range(1, 6)]
    pages += [
        (10, "C", "1", 10, "N0tes on tbe Pump\nThe rnuscle moves the wa-\nter again.\n\nAnd thc pipe\np. l0"),
        (11, "C", "1", 11, None), (12, "C", "1", 12, ""), (13, "C", "1", 13, "  \n"), (14, None, None, None, "The valve\r\n7\r\nopens."), (15, "D", "1", 1, "Notes on the Pump\nThe pipe"),
        (16, "C", "1", 16, "a" * 100_000), (1, "C", "1", 1, f"Notes on the Pump\n{body(1)}\n1"),
    ]
    slides = [(1, "C", "1", 7, ["Notes on the Pump", "the pipe -> valve", None, "cen-", "tre"]), (2, "C", "1", 8, None), (3, "C", "1", 9, [])]
    p = spark.createDataFrame(pages, "page_id long, course_code string, module_number string, number int, text string")
    s = spark.createDataFrame(slides, "slide_id long, course_code string, module_number string, number int, visual_text array<string>")
    return p.withColumn("noise", F.lit("clash")), s.withColumn("line", F.lit(1))


def test_lines_and_repair(spark):
    p, s = tables(spark)
    got = sorted(map(tuple, noisy_lines(page_lines(p), slide_lines(s)).collect()))
    want = [("extracted_pages", k, 1, "header") for k in range(1, 6)] + [("extracted_pages", k, 4, "page_number") for k in range(1, 6)]
    want += [("extracted_pages", 10, 1, "header"), ("extracted_pages", 10, 2, "hyphen"), ("extracted_pages", 10, 2, "misread"), ("extracted_pages", 10, 5, "misread"), ("extracted_pages", 10, 6, "page_number")]
    want += [("slides", 1, 1, "header"), ("slides", 1, 4, "hyphen")]
    assert got == sorted(want)
    text = {(r.item_table, r.item_id): r.text for r in repaired(page_lines(p), slide_lines(s)).collect()}
    assert text["extracted_pages", 10] == "The muscle moves the water again.\nAnd the pipe"
    assert text["slides", 1] == "the pipe -> valve\ncentre" and text["extracted_pages", 13] == ""
    assert noisy_lines(page_lines(p.limit(0)), slide_lines(s.limit(0))).count() == 0


def test_two_changes(spark):
    df = spark.createDataFrame([(1, "C", "1", 1, "\n".join(["collected"] * 20 + ["collcctcd", "co1lected"]))], "page_id long, course_code string, module_number string, number int, text string")
    assert {(r.word, r.variant) for r in misread_words(_lines(page_lines(df))).collect()} == {("collcctcd", "collected"), ("co1lected", "collected")}


def test_compounds_keep_their_hyphen(spark):
    inside = "\n".join(["Ang guro ay nag-aayos ng mesa, at nag-aayos siya muli.", "The water was well-known, and the coopera-tion too.", "The cooperation of the cooperation."])
    pages = [(1, "C", "1", 1, inside), (2, "C", "1", 2, "Siya ay nag-\naayos ng mesa."), (3, "C", "1", 3, "Bukas ang Nag\u00ad\naayos na"), (4, "C", "1", 4, "the coopera-\ntion of wa-\nter"), (5, "C", "1", 5, "It is very-well-\nknown here")]
    p = spark.createDataFrame(pages, "page_id long, course_code string, module_number string, number int, text string")
    s = spark.createDataFrame([], "slide_id long, course_code string, module_number string, number int, visual_text array<string>")
    text = {r.item_id: r.text for r in repaired(page_lines(p), slide_lines(s)).collect()}
    assert [text[k] for k in (2, 3, 4, 5)] == ["Siya ay nag-aayos ng mesa.", "Bukas ang Nag-aayos na", "the cooperation of water", "It is very-well-known here"]


def test_breaks_need_evidence(spark):
    pages = [(1, "C", "1", 1, "It was pre-\nand post-tested."), (2, "C", "1", 2, "salt and water\nof the coopera-\ntion"), (3, "C", "1", 3, "the cooperation"), (4, "C", "1", 4, "a zorb-\nlit mirror")]
    p = spark.createDataFrame(pages, "page_id long, course_code string, module_number string, number int, text string")
    s = spark.createDataFrame([], "slide_id long, course_code string, module_number string, number int, visual_text array<string>")
    for k in (1, 10):  # ten times the rows under other ids speak as one
        more = p.crossJoin(spark.range(k).withColumnRenamed("id", "i")).select((F.col("page_id") * 100 + F.col("i")).alias("page_id"), "course_code", F.col("i").cast("string").alias("module_number"), "number", "text")
        got = {(r.item_id // 100, r.line_no) for r in noisy_lines(page_lines(more), slide_lines(s)).where("noise = 'hyphen'").collect()}
        assert got == {(2, 2), (4, 1)}
    text = {r.item_id: r.text for r in repaired(page_lines(p), slide_lines(s)).collect()}
    assert text[1] == "It was pre- and post-tested." and text[4] == "a zorblit mirror"


def test_long_headers(spark):
    long = "Notes on the Pump and all of its Parts " * 5
    pages = [(k, "C", "1", k, f"{long}\nword number {k} of the text") for k in range(3)]
    p = spark.createDataFrame(pages, "page_id long, course_code string, module_number string, number int, text string")
    s = spark.createDataFrame([], "slide_id long, course_code string, module_number string, number int, visual_text array<string>")
    assert {(r.item_id, r.line_no) for r in noisy_lines(page_lines(p), slide_lines(s)).where("noise = 'header'").collect()} == {(0, 1), (1, 1), (2, 1)}
