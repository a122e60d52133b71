import random

import numpy as np
import pytest

from coursegrain.llm import near


def brute(rows, least=near.MIN_WORDS, t=near.SIMILARITY):
    sets = {(tab, i): set("".join(c if c.isalnum() else " " for c in x.lower()).split()) for tab, i, x in rows if x}
    sets = {k: v for k, v in sets.items() if len(v) >= least}
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for n, a in enumerate(keys) for b in keys[n + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def run(spark, rows):
    recs = None
    for name in ("x", "y"):
        df = spark.createDataFrame([(i, s, "clash", 0) for t, i, s in rows if t == name], "key long, body string, id string, tab int")
        part = near.records(df, name, "key", "body")
        recs = part if recs is None else recs.unionByName(part)
    return recs, [tuple(r) for r in near.near_pairs(recs, ["x", "y"]).collect()]


@pytest.mark.parametrize("seed,vocabulary,size", [(1, 12, 9), (2, 300, 14), (3, 40, 70)])
def test_against_brute_force(spark, seed, vocabulary, size):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    texts = [[r.choice(words) for _ in range(r.randint(5, size))] for _ in range(60)]
    for _ in range(120):
        t = list(r.choice(texts))
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(t))
            t[k : k + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 2)
            t = t or ["w0"]
        r.shuffle(t)
        texts.append(t)
    rows = [(r.choice("xy"), k, " ".join(t)) for k, t in enumerate(texts)]
    _, got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    text = "One two, THREE four five six"
    rows = [("x", k, text) for k in range(9)] + [("x", 20, None), ("x", 21, ""), ("x", 22, "one two three four five"), ("x", 23, "one two three four five"), ("y", 1, text), ("x", 30, text + " seven")]
    rows += [("x", 40 + k, " ".join(f"v{n}" for n in range(k, 5000))) for k in range(3)] + [("x", 0, text)]
    recs, got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    groups = {(r.tab, r.id): (r.class_id, r.links) for r in near.near_groups(recs, ["x", "y"]).collect()}
    assert groups["x", 8] == (0, 1) and groups["x", 30] == (30, 1) and groups["y", 1] == (1, 0) and groups["x", 41] == (41, 2)
    assert near.near_pairs(recs.limit(0), ["x", "y"]).count() == 0


def test_thresholds_reach_the_sum_at_least_cost():
    r = np.random.default_rng(4)
    exact, loose, need = r.random((40, 4)), r.random((40, 4)) * 3, r.integers(1, 8, 40)
    loose[:, 0] = np.inf
    t = near.thresholds(exact, loose, need)
    import itertools

    for k in range(40):
        price = lambda p: sum((0, exact[k, i], loose[k, i])[x] for i, x in enumerate(p))
        least = min(price(p) for p in itertools.product((0, 1, 2), repeat=4) if sum(p) >= need[k])
        assert sum(t[k] + 1) >= need[k] and price(t[k] + 1) == pytest.approx(least)


def test_plans_do_not_depend_on_the_batch():
    r = np.random.default_rng(9)
    sizes = r.integers(6, 60, 80)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    h = r.integers(0, 400, offsets[-1]) * 7919
    shares = near.Shares({int(w): int(c) for w, c in zip(*np.unique(h, return_counts=True))}, 80, set(np.unique(h)[:5].tolist()))
    whole = near.key_rows(np.arange(80), np.zeros(80, np.int64), offsets, h, shares)
    parts = [near.key_rows(np.arange(a, b), np.zeros(b - a, np.int64), offsets[a : b + 1] - offsets[a], h[offsets[a] : offsets[b]], shares) for a, b in ((0, 1), (1, 33), (33, 80))]
    rows = lambda d: sorted(zip(*(x.tolist() for x in d.values())))
    assert rows(whole) == sorted(x for p in parts for x in rows(p))


def test_two_large_near_classes(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 100)
    text, n = "one two three four five six seven eight", 1500
    df = spark.range(2 * n).selectExpr("id AS key", f"IF(id < {n}, '{text}', '{text} nine') AS body")
    pairs = near.near_pairs(near.records(df, "x", "key", "body"), ["x"])
    assert pairs.count() == pairs.distinct().count() == n * (2 * n - 1)


def test_frequent_keys_are_avoided_and_met_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "HEAVY_SHARE", 0.02)
    monkeypatch.setattr(near, "KEY_BLOCK", 7)
    monkeypatch.setattr(near, "HELD_KEYS", 500)  # counts are compacted many times
    r = random.Random(5)
    frame = "the pump of the unit carries code and holds valve number near pipe".split()
    rows = [("x", k, " ".join(frame + [f"a{r.randrange(12)}", f"b{r.randrange(12)}", f"c{r.randrange(40)}"])) for k in range(300)]
    rows += [("y", k, " ".join(frame[: r.randint(6, 11)])) for k in range(60)]
    recs, got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    reps = near.stored(near.classes(recs))
    shares = near.learn(reps)
    heavy = near.heavy_keys(reps, ["x", "y"], shares)
    assert heavy and min(heavy.values()) >= 2
