import random

import numpy as np

from coursegrain.llm import leakage
from coursegrain.llm.leakage import FMIndex, Phrases, leaked_pairs, leaked_spans


def test_index_against_plain_search():
    r = np.random.default_rng(5)
    for size, n in ((3, 400), (9, 3000), (2, 200)):
        s = r.integers(0, size, n)
        s[-1] = 0
        s[n // 2 : n // 2 + 50] = s[:50]
        f = FMIndex(s.astype(np.int64), size)
        phrases = np.array([s[k : k + 4] for k in range(0, n - 4, 7) if 0 not in s[k : k + 4]] + [[1, 1, 1, 1]], np.int64)
        low, high = f.ranges(phrases)
        for p, a, b in zip(phrases, low, high):
            assert sorted(f.locate(np.arange(a, b))) == [k for k in range(n - 3) if (s[k : k + 4] == p).all()]


def test_long_documents_are_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_WORDS", 64)
    r = random.Random(2)
    words = [r.choice("abcdefgh") for _ in range(900)]
    p = Phrases([(1, words[100:140]), (2, words[500:513])])
    shard = [(0, k, run) for k, run in p.runs(words)]
    want = {(0, i, k) for i, w in ((1, words[100:140]), (2, words[500:513])) for j in range(len(w) - 12) for k in range(888) if words[k : k + 13] == w[j : j + 13]}
    assert set(p.hits(shard)) == want


W = [f"w{k}" for k in range(40)]


def test_rows(spark):
    docs = spark.createDataFrame(
        [(1, "x, " + "; ".join(W[:13]).upper() + " y", 0), (2, " ".join(W[:12]), 0), (3, None, 0), (4, "", 0), (5, " ".join(W[20:34] + ["z"] + W[5:20]), 0), (1, " ".join(W[:13]), 0)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([(10, " ".join(W[:20])), (11, " ".join(W[:13])), (12, " ".join(W[15:40])), (13, None), (14, ""), (None, " ".join(W))], "item_id long, text string")
    assert sorted(map(tuple, leaked_pairs(docs, items).collect())) == [(1, 10), (1, 11), (5, 10), (5, 12)]
    assert sorted(map(tuple, leaked_spans(docs, items).where("doc_id = 5").collect())) == [(5, 10, 15, 30), (5, 12, 0, 14)]
    assert leaked_pairs(docs.limit(0), items).count() == 0 and leaked_pairs(docs, items.limit(0)).count() == 0
