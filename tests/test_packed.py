import pytest
from pyspark.sql import functions as F

from coursegrain.operators.packed import packed_values, unpack

CASES = [
    (None, None),
    ("", []),
    ("  ", []),
    ("7", ["7"]),
    ("1;2", ["1", "2"]),
    ("1;;2;", ["1", "2"]),
    ("33, and 34, and 37;", ["33", "34", "37"]),
    ("f45, 46, \"reader's valley\";", ["f45", "46", "reader's valley"]),
    ('"the ""reagent"" box"', ['the "reagent" box']),
    ("['questionnaire/conveyor 5', '6']", ["questionnaire/conveyor 5", "6"]),
    ("«slide 61 | resistor»", ["slide 61 | resistor"]),
    ("“49”·47", ["49", "47"]),
    ('"";5', ["5"]),
    ('"and" and x', ["and", "x"]),
    ('5;"never closed; 6', ["5", "never closed; 6"]),
    ("22\t25、26；A-1", ["22", "25", "26", "A-1"]),
    ("f36#2;20.3;ch_79-a", ["f36#2", "20.3", "ch_79-a"]),
    ("(12;13)", ["12", "13"]),
]


@pytest.mark.parametrize("text,values", CASES)
def test_unpack(spark, text, values):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(unpack(F.col("v")).alias("x")).first()["x"] == values


def test_positions_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a;b", "x", 9), (1, "a;b", None, 9), (2, "z" * 200_000 + ";y", "q", 9)], "k long, f string, item string, pos int")
    rows = packed_values(df, "k", ["f", "item"], least=2).collect()
    assert sorted((r.k, r.field, r.pos, r["item"][:3]) for r in rows) == [(1, "f", 1, "a"), (1, "f", 1, "a"), (1, "f", 2, "b"), (1, "f", 2, "b"), (2, "f", 1, "zzz"), (2, "f", 2, "y")]
    assert packed_values(df.limit(0), "k", ["f"]).count() == 0
