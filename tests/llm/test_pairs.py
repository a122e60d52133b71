import random

import pytest
from pyspark.sql import functions as F

from coursegrain.llm.pairs import SuffixAutomaton, copies, defects, other_language, plainly_broken, refuses, says_nothing


def test_suffix_automaton_against_plain_search():
    r = random.Random(1)
    for _ in range(60):
        q, a = [r.choice("abc") for _ in range(r.randint(1, 25))], [r.choice("abcd") for _ in range(r.randint(1, 25))]
        text = " ".join(q)
        has = lambda i, j: f" {' '.join(a[i:j])} " in f" {text} "
        want = {k for i in range(len(a)) for j in range(i + 2, len(a) + 1) if has(i, j) for k in range(i, j)}
        longest = max([j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if has(i, j)], default=0)
        assert SuffixAutomaton(q).coverage(a, 2) == (len(want), longest)


@pytest.mark.parametrize("text,yes", [
    ("I cannot answer this question.", True), ("Note - As an assistant I am not able to.", True), ("Paumanhin, hindi ko masasagot ito.", True), ("お答えできません。", True),
    ("The pump cannot answer two calls at once.", False), ("Sorry results follow when the pump stops.", False), ("", False),
])
def test_refusals(text, yes):
    assert refuses(text) is yes


def test_single_judgements():
    assert all(says_nothing(x) for x in (None, "", "\xa0", "—", "[]", "N/A", "(no answer)", "Not  Specified")) and not any(says_nothing(x) for x in ("0", "No", "C", "pH", "無"))
    assert all(plainly_broken(x) for x in ("It is…", "It is [...]", "It is (", "The code,", "It (was a", "Si va..")) and not any(plainly_broken(x) for x in ("It is.", "C++", "Na-", "It (is) so", "(It is so."))
    assert copies("Which lens does the long tube use?", "Answer: WHICH lens does the  long tube use") and not copies("Which lens does the long tube use?", "Which lens does the — that is settled by the wide one, since it must.")
    assert other_language("What does the lens do when it is cold?", "El espejo y los cristales") and not other_language("What does the lens do?", "Tusmi Gesga") and not other_language("¿Qué hace el espejo?", "El espejo se enfría")


def test_rows(spark):
    cols = "card_id long, card_type string, question string, correct_option string, wrong_option_1 string, wrong_option_2 string, wrong_option_3 string, expalanation string, hint string, defect string"
    good = "The pump moves the water because the valve opens the pipe and the pump keeps cold water."
    row = lambda i, kind, q, opt, exp: (i, kind, q, opt, None, None, None, exp, "the hint", "clash")
    rows = [row(k, "multiple-choice", f"What does the pump number {k} move when the valve opens?", "the water", good) for k in range(100, 140)] + [
        row(1, "true-false", "The pump moves the water only when it is cold.", "", good),
        row(2, "true-false", "The pump moves the water only when it is cold.", None, "The pump moves the water only when it is cold"),
        row(3, "identification", "What does the pump move?", None, None),
        row(4, "identification", "What does the pump move?", "the water", "The pump moves the wat"),
        row(5, "identification", "What does the pump move?", "the water", "The pump moves the"),
        row(6, "identification", "What does the pump move?", "el agua", "I must decline to write this explanation."),
        row(7, None, None, "the water", "The wall holds the roof. " * 4000),
        row(8, "identification", "What does the pump move?", "the water", "The pump moves the water"),
        row(3, "identification", "What does the pump move?", None, None),
    ]
    df = spark.createDataFrame(rows, cols)
    assert sorted(map(tuple, defects(df).collect())) == [(2, "copied"), (3, "empty"), (4, "truncated"), (5, "truncated"), (6, "other_language"), (6, "refusal")]
    assert defects(df.limit(0)).count() == 0


def test_cut_words_do_not_vouch_for_each_other(spark):
    cols = "card_id long, card_type string, question string, correct_option string, wrong_option_1 string, wrong_option_2 string, wrong_option_3 string, expalanation string, hint string"
    ask = lambda i, opt, wrong: (i, "multiple-choice", f"Which part number {i} turns the wheel?", opt, wrong, None, None, "The wheel turns.", None)
    rows = [ask(i, f"the {i} wheel of the pum", "the valve of the pump") for i in range(12)] + [ask(20 + i, f"the {i} stem of the pump", "the wheel") for i in range(6)]
    rows += [ask(40 + i, f"the pipe {i} of the colo", "the wheel") for i in range(5)] + [ask(50, "the wheel", "the colo of the wheel")]
    for times in (1, 10):  # the same shares at ten times the rows
        df = spark.createDataFrame([(r[0] + 1000 * k, *r[1:]) for k in range(times) for r in rows], cols)
        assert {r.card_id % 1000 for r in defects(df).collect()} == {*range(12), *range(40, 45)}
        assert defects(df).count() == 17 * times


def test_answers_do_not_depend_on_the_number_of_rows(spark):
    rows = [(k, "identification", f"What does part {k} of the pump hold in the tank?", "", None, None, None, f"Part {k} holds the water of the tank.", "Think of the tank.") for k in range(8)]
    rows += [
        (20, "multiple-choice", "What moves the pump?", "the shaft that turns the wheel of the resev", "the belt", "the wheel", "the tank", "The shaft turns the wheel.", None),
        (21, "multiple-choice", "What moves the tank?", "a shaft that belongs to the", "the belt", "the wheel", "the tank", "The shaft turns the wheel.", None),
    ]
    schema = "card_id long, card_type string, question string, correct_option string, wrong_option_1 string, wrong_option_2 string, wrong_option_3 string, expalanation string, hint string"
    df = spark.createDataFrame(rows, schema)
    seen = []
    for times in (1, 3, 40):
        many = df.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).withColumn("card_id", F.col("card_id") * 100 + F.col("copy")).drop("copy")
        seen.append({(r.card_id // 100, r.defect) for r in defects(many).where("defect = 'truncated'").collect()})
    assert seen[0] == seen[1] == seen[2] == {(20, "truncated"), (21, "truncated")}
