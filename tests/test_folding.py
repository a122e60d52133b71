"""The fold of reworded facts against a plain fold that compares every fact with all that are kept."""

import difflib
import random
import re

from coursegrain.functions import lesson as L
from coursegrain.operators.folding import _distinct_facts, duplicate_facts, folded_facts


def form(s):
    return " ".join(re.findall("[a-z0-9]+", s.lower()))


def content(s):
    return [w for w in form(s).split() if w not in L.BRIDGE_WORDS]


def subject(s):
    m = re.search(rf"\b(?:{L.PREDICATE})\b", form(s))
    return {w for w in form(s)[: m.start()].split() if w not in L.BRIDGE_WORDS} if m else set()


def listing(s):
    return len(re.findall("[,;]", s)) >= 2 or len(re.findall(r"(?:^|\s)[0-9]+[.)]\s", s)) >= 3


def same(a, b):
    if form(a) == form(b):
        return True
    ca, cb = content(a), content(b)
    sa, sb = set(ca), set(cb)
    if not sa or not sb or sa & set(L.FACT_NEGATIONS) != sb & set(L.FACT_NEGATIONS):
        return False
    both = sa & sb
    overlap, jaccard, least = len(both) / min(len(sa), len(sb)), len(both) / len(sa | sb), min(len(ca), len(cb))
    ratio = difflib.SequenceMatcher(None, form(a), form(b)).ratio()
    pa, pb = subject(a), subject(b)
    alike = pa and pb and (pa <= pb or pb <= pa) and abs(len(pa) - len(pb)) <= 1
    return (
        (listing(a) and listing(b) and least >= 10 and overlap >= 0.8 and jaccard >= 0.62 and ratio >= 0.62) or bool(alike and least >= 5 and overlap >= 0.65 and len(both - (pa | pb)) >= 3)
        or (least >= 8 and overlap >= 0.95 and jaccard >= 0.85 and ratio >= 0.9)
    )


def plain_fold(rows):
    kept = []
    for i, s, slides in rows:
        hits = [k for k, x in enumerate(kept) if same(x[1], s)]
        mine = (i, s, set(slides))
        if not hits:
            kept.append(mine)
            continue
        group = [kept[k] for k in hits] + [mine]
        best = max(group, key=lambda x: (int(listing(x[1])), len(content(x[1]))))
        kept[hits[0]] = (best[0], best[1], set().union(*[x[2] for x in group]))
        for k in reversed(hits[1:]):
            del kept[k]
    return sorted((i, s, sorted(x)) for i, s, x in kept)


def made(seed, n):
    r = random.Random(seed)
    things, verbs, words = "pump valve pipe lens mirror cell".split(), "moves uses stores requires is".split(), "water salt heat light cold fast long iron glass wire gear shaft drum belt tank wheel".split()
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.55:
            t = r.choice(texts).split()
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 1)] = [r.choice(words + ["not", "the", "item,", "part;"])] * r.randint(0, 2)
            texts.append(" ".join(t) or "pump")
        else:
            texts.append(f"The {r.choice(things)} {r.choice(verbs)} " + " ".join(r.choice(words) + r.choice(["", "", "", ",", ";"]) for _ in range(r.randint(3, 14))) + ".")
    return texts


def test_pairs_and_fold_against_plain_ones(spark):
    rows = [(m, k, t, [k % 7, -1, None]) for m in ("a", "b") for k, t in enumerate(dict.fromkeys(made(m, 90)))]
    df = spark.createDataFrame(rows, "module string, fact_row long, statement string, slides array<int>")
    f = _distinct_facts(df, ["module"], "fact_row")
    got = {(r.module, r.a, r.b) for r in duplicate_facts(f, ["module"]).collect()}
    of = {m: [(k, t) for x, k, t, _ in rows if x == m] for m in ("a", "b")}
    want = {(m, i, j) for m, ts in of.items() for i, s in ts for j, t in ts if i < j and same(s, t)}
    assert len(want) > 60 and got == want
    folded = {m: sorted((r.fact_row, r.statement, list(r.slides)) for r in folded_facts(df, ["module"], "fact_row").where(f"module = '{m}'").collect()) for m in of}
    assert folded == {m: plain_fold([(k, t, [x for x in [k % 7] if x > 0]) for k, t in ts]) for m, ts in of.items()}


def test_reworded_facts_fold(spark):
    rows = [
        (1, "The heart pump stores cold water in the long pipe.", [3]), (2, "The heart pump stores cold water in the pipe.", [1]), (3, "the heart pump stores cold water in the long pipe", None), (4, "The heart pump never stores cold water in the long pipe.", [9]),
        (5, "The heart pump stores cold water in the long pipe.", [2, 3]), (6, None, [1]), (7, "  ", [1]),
    ]
    df = spark.createDataFrame([("m", *r, 0) for r in rows], "module string, fact_row long, statement string, slides array<int>, form int")
    got = sorted((r.fact_row, list(r.slides), r.n_rows) for r in folded_facts(df, ["module"], "fact_row").collect())
    assert got == [(1, [1, 2, 3], 4), (4, [9], 1)]
    assert folded_facts(df.limit(0), ["module"], "fact_row").count() == 0
