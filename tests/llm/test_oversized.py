from hypothesis import given, settings
from hypothesis import strategies as st

from coursegrain.llm.oversized import bisect_text, oversized_pieces


def check(text, limit, overlap):
    pieces = bisect_text(text, limit, overlap)
    assert "".join(text[c:b] for _, c, b in pieces) == text
    assert all(b - a <= limit for a, _, b in pieces)
    assert all(c - a == min(c, overlap) for a, c, _ in pieces[1:]) and pieces[0][0] == pieces[0][1] == 0
    assert all(b > c for _, c, b in pieces) or not text
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n。é́", max_size=400), st.integers(2, 60), st.integers(0, 59))
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, min(overlap, limit - 1))


def test_natural_boundaries():
    para = ("x" * 40 + ". ") * 10
    text = para + "\n\n" + para
    assert [text[c:b] for _, c, b in check(text, 500, 20)] == [para + "\n\n", para]
    assert len(check("y" * 5_000_000, 1200, 120)) > 4000
    assert check("ab_" * 500, 100, 10)[0][2] % 3 == 0


def test_rows(spark):
    schema = "item_table string, item_id long, item_pos long, text string, start string, piece_no string"
    rows = [("t", 1, 0, None, "a", "b"), ("t", 2, 0, "", "a", "b"), ("t", 3, 0, "q" * 1200, "a", "b"), ("t", 4, 0, "q " * 601, None, None), ("t", 4, 0, "q " * 601, None, None), (None, None, None, "😀" * 1201, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = oversized_pieces(df).collect()
    assert sorted((r.item_id or 0, r.piece_no) for r in got) == [(0, 1), (0, 2), (4, 1), (4, 1), (4, 2), (4, 2)]
    assert all(len(r.text) <= 1200 for r in got)
    assert oversized_pieces(df.limit(0)).count() == 0
