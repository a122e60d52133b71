"""Rules of cards on small fixtures."""

import itertools

import pytest
from pyspark.sql import functions as F

from coursegrain.functions import cards as C
from coursegrain.plans import cards as P


def one(spark, f, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"v{k} string" for k in range(len(values))))
    return row.select(f(*[F.col(f"v{k}") for k in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize("text,trigger", [
    ("As stated in the provided facts, water is wet.", "As stated in the provided facts"), ("Water is wet according to the lesson.", "according to the lesson"), ("Fact f12 says so.", "Fact f12"), ("The module's title is long.", "The module's title"),
    ("A document class sets the page.", None), ("The factory states its price.", None), ("", None),
])
def test_provenance(spark, text, trigger):
    assert one(spark, C.provenance_trigger, text) == trigger


@pytest.mark.parametrize("text,answer,yes", [
    ("What does the pump move?", "the pump", True), ("Which language is C++ based on?", "C", False), ("Use .NET here", "NET", False), ("See version 1.2.", "1.2", True), ("It is Na+ here", "Na", False), ("anything", "", False), ("a (b) c", "(b)", False), ("a, (b)", "(b)", True), ("q|w", "q", False),
])
def test_answers_in_texts(spark, text, answer, yes):
    assert one(spark, lambda t, a: C.holds_answer(C.canonical_option(t), C.canonical_option(a)), text, answer) is yes


def words(spark, text):
    return one(spark, lambda c: F.array_join(C.content_words(C.question_words(c)), " "), text)


def test_question_words(spark):
    assert words(spark, "Which pumps WON\u2019T move the studies?") == "pump will move the study"
    assert one(spark, lambda c: F.array_join(C.negation_markers(C.question_words(c)), " "), "It isn't the least, can't be") == "cannot least not"


QUESTIONS = [
    (1, "a", "identification", "What does the long pump move in winter?"), (2, "a", "identification", "What does the long old pump move in winter?"), (3, "a", "identification", "What does the long pump not move in winter?"), (4, "a", "true-false", "What does the long old pump move in winter"),
    (5, "a", "identification", "what does the long pump move in WINTER"), (6, "b", "identification", "What does the long pump move in winter?"), (7, "a", "identification", "Pump?"), (8, "a", "identification", "Pump now?"), (9, "a", "identification", None),
]


def test_near_questions_against_all_pairs(spark, tmp_path):
    df = spark.createDataFrame([(i, m, m, m, t, q) for i, m, t, q in QUESTIONS], "card_id long, course_code string, module_number string, cluster string, card_type string, question string")
    df.write.parquet(str(tmp_path / "cards.parquet"))
    got = {(r.id_a, r.id_b, r.kind) for r in P.val_m2_near_questions(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, "near"), (1, 3, "polarity"), (2, 3, "polarity")}
    got = {(r.id_a, r.id_b, r.kind) for r in P.val_m3_cluster_duplicates(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, "near"), (1, 3, "polarity"), (2, 3, "polarity")}
    forms = {r.card_id: r for r in P.str21_question_forms(spark, str(tmp_path)).collect()}

    def near(a, b):
        x, y = forms[a].content.split(), forms[b].content.split()
        if len(x) > len(y):
            x, y = y, x
        return forms[a].markers == forms[b].markers and (x == y or (len(x) >= 4 and len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))))

    assert [(a, b) for a, b in itertools.combinations((1, 2, 3, 7, 8), 2) if near(a, b)] == [(1, 2)]
    assert {(r.class_id, r.n_cards, r.n_types) for r in P.val_m2_equal_questions(spark, str(tmp_path)).collect()} == {(1, 2, 1), (2, 2, 2)}
