from coursegrain.llm.oversized import oversized_pieces, rejoined


def test_texts_come_back_from_their_pieces(spark):
    texts = ["word and word, " * 200, "a" * 5000, "é\n\n" * 900, "short", None, "Ein Satz. " * 130]
    df = spark.createDataFrame([("t", k, 0, x) for k, x in enumerate(texts)] + [("t", 0, 0, texts[0])], "item_table string, item_id long, item_pos long, text string")
    import hashlib

    pieces = oversized_pieces(df)
    got = {r.item_id: (r.n_chars, r.digest, r.kept) for r in rejoined(pieces).collect()}
    assert got == {k: (len(x), hashlib.md5(x.encode()).hexdigest(), True) for k, x in enumerate(texts) if x and len(x) > 1200}
    assert {r.kept for r in rejoined(pieces, overlap=100).collect()} == {False}
    assert rejoined(oversized_pieces(df.limit(0))).count() == 0
