from pyspark.sql import functions as F

from coursegrain.llm.canonical import canonical_values, reference_forms, unmatched_report

REFERENCE = [("created_by", "created by", ["made by"]), ("is_a", "is a", ["kind of", None, ""]), ("part_of", "part of", None), ("contains_x", "holds within it", ["made by"]), (None, "nothing", [])]


def forms(spark, rows=REFERENCE):
    return reference_forms(spark.createDataFrame(rows, "relation_code string, label string, also_written array<string>"), "relation_code", [F.array("label", "relation_code"), F.coalesce("also_written", F.array().cast("array<string>"))])


WRITTEN = {
    "created by": "created_by", " Created By. ": "created_by", "createdBy": "created_by", "CREATED_BY": "created_by", "crated by": "created_by", "craeted by": "created_by",
    "created by created by": "created_by", "was created by the": "created_by", "is part of the": "part_of", "prt of": "part_of", "is a": "is_a", "isA": "is_a", "kind  of": "is_a",
    "na": "unmatched", "sponsor": "unmatched", "--": "unmatched", "12": "unmatched", "z" * 100_000: "unmatched", "made by": "contains_x",
}


def test_written_forms(spark):
    rows = [(i, w, "x", i) for i, w in enumerate(WRITTEN)] + [(900, None, "x", 1), (901, "   ", "x", 1), (0, "created by", "x", 1)]
    df = spark.createDataFrame(rows, "triple_id long, relation string, plain string, code int")
    got = sorted((r.triple_id, r.relation_code) for r in canonical_values(df, "triple_id", "relation", forms(spark), "relation_code").collect())
    assert got == sorted([(i, c) for i, (w, c) in enumerate(WRITTEN.items())] + [(0, "created_by")])
    assert {r["value"] for r in unmatched_report(df, "relation", forms(spark)).collect()} == {"na", "sponsor", "", "12", "z" * 100_000}


def test_empty_tables_and_own_words(spark):
    df = spark.createDataFrame([(i, "brings about") for i in range(40)] + [(100 + i, "sings about") for i in range(9)] + [(200, "bings abot")], "triple_id long, relation string")
    ref = forms(spark, [("causes", "brings about", [])])
    got = {r.triple_id: r.relation_code for r in canonical_values(df, "triple_id", "relation", ref, "relation_code").collect()}
    assert got[0] == "causes" and got[100] == "unmatched" and got[200] == "causes"
    assert canonical_values(df.limit(0), "triple_id", "relation", ref, "relation_code").count() == 0
    assert {r.relation_code for r in canonical_values(df, "triple_id", "relation", ref.limit(0), "relation_code").collect()} == {"unmatched"}


def test_answers_do_not_depend_on_the_number_of_rows(spark):
    written = {"brings about": "causes", "brings aobut": "causes", "sings about": "unmatched", "bings abot": "causes", "crebted bx": "created_by", "tocreated by": "created_by", "prodduses": "produces"}
    ref = forms(spark, [("causes", "brings about", []), ("created_by", "created by", []), ("produces", "produces", [])])
    names = list(written)
    for times in (1, 10, 100):
        rows = [(k * 1000 + j, w) for k, w in enumerate(names) for j in range(times if k % 2 else 1)]
        df = spark.createDataFrame(rows, "triple_id long, relation string")
        got = {(names[r.triple_id // 1000], r.relation_code) for r in canonical_values(df, "triple_id", "relation", ref, "relation_code").collect()}
        assert got == set(written.items())
