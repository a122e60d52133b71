"""Folding of reworded facts: which pairs say the same, and which statement and slides each group keeps.

Pairs are found by equality joins, never by comparing all facts of a module. Two facts say the same when their forms are equal, or
when they agree on negations and one of three rules holds; each rule is met by some key of its own:

* the same subject (equal but for one word) and two thirds of the smaller set of words: the subject, and it without a word, each
  beside one of the rarest words of the smaller set, of which the other must have one;
* enumerations that overlap, and near-equal texts: both need four fifths of the smaller set, so one of its rarest words (a fifth of
  them and one) is in the other.

The fold itself looks at facts in their order, and each fact joins all kept statements that it repeats. As kept statements are
always statements of the module, it never leaves a connected component of the pairs, so components are folded apart.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from coursegrain.functions import lesson as L
from coursegrain.functions.text import squeezed
from coursegrain.operators.relational import components
from coursegrain.sources.tables import cut


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest matching blocks; the order of the two matters."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def _distinct_facts(facts: DataFrame, group: list[str], order: str) -> DataFrame:
    """One row for each different statement of a group: its first fact, its forms, and all slides of its facts."""
    base = facts.select(*group, F.col(order).alias("id"), squeezed("statement").alias("statement"), "slides").where("statement <> ''")
    slides = base.select(*group, "statement", F.explode("slides").alias("slide")).where("slide > 0").distinct().groupBy(*group, "statement").agg(F.array_sort(F.collect_list("slide")).alias("slides"))
    one = base.groupBy(*group, "statement").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_rows"))
    forms = one.withColumn("t", L.tokens(F.col("statement"))).withColumn("form", F.array_join("t", " "))
    forms = forms.select("*", L.content_of(F.col("t")).alias("content"), L.subject_of(F.col("form")).alias("subject"), L.is_enumeration(F.col("statement")).alias("listing")).drop("t")
    return forms.join(slides, [*group, "statement"], "left").withColumn("words", F.array_distinct("content"))


def _keys(f: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(asking, answering) keys of the facts: forms, rare words, and rare words beside subjects and subjects less a word."""
    subject = F.col("subject")
    less = F.transform(F.sequence(F.lit(1), F.size(subject)), lambda i: F.array_join(F.concat(F.slice(subject, 1, i - 1), F.slice(subject, i + 1, F.size(subject))), " "))
    none = F.array().cast("array<string>")
    variants = F.when(F.size(subject) > 0, F.array_distinct(F.concat(F.array(F.array_join(subject, " ")), less))).otherwise(none)
    # a word's uses in the group decide which of a fact's words are rare; ties by name
    words = f.where(F.size("content") >= 5).select(*group, "id", variants.alias("variants"), (F.size("content") >= 8).alias("long"), F.explode("words").alias("w"))
    uses = words.groupBy(*group, "w").agg(F.count(F.lit(1)).alias("uses"))
    ranked = words.join(uses, [*group, "w"]).groupBy(*group, "id").agg(F.first("variants").alias("variants"), F.first("long").alias("long"), F.array_sort(F.collect_list(F.struct("uses", "w"))).alias("r"))
    ranked = ranked.select(*group, "id", "variants", "long", F.transform("r", lambda x: x["w"]).alias("r"))
    n = F.size("r")
    rarest = lambda share: F.slice("r", 1, (n - F.ceil(n * share) + 1).cast("int"))
    plain = lambda ws: F.when(F.col("long"), F.transform(ws, lambda w: F.concat(F.lit("w"), w))).otherwise(none)
    beside = lambda ws: F.flatten(F.transform("variants", lambda v: F.transform(ws, lambda w: F.concat(F.lit("s"), v, F.lit("|"), w))))
    forms = f.select(*group, "id", F.concat(F.lit("f"), F.col("form")).alias("key"))
    asking = ranked.select(*group, "id", F.explode(F.concat(plain(rarest(0.8)), beside(rarest(0.65)))).alias("key"))
    answering = ranked.select(*group, "id", F.explode(F.concat(plain(F.col("r")), beside(F.col("r")))).alias("key"))
    return asking.unionByName(forms), answering.unionByName(forms)


def duplicate_facts(f: DataFrame, group: list[str]) -> DataFrame:
    """(group, a, b), a before b: the pairs of different statements that say the same, of ``_distinct_facts``."""
    asking, answering = _keys(f, group)
    met = asking.withColumnRenamed("id", "p").join(answering.withColumnRenamed("id", "q"), [*group, "key"]).where("p <> q").select(*group, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    side = lambda x: f.select(*group, F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("form", "content", "words", "subject", "listing")])
    p = met.join(side("a"), [*group, "a"]).join(side("b"), [*group, "b"])
    wa, wb = F.col("words_a"), F.col("words_b")
    shared = F.array_intersect(wa, wb)
    least = F.least(F.size("content_a"), F.size("content_b"))
    negated = lambda w: F.array_sort(F.array_intersect(w, F.array(*[F.lit(x) for x in L.FACT_NEGATIONS])))
    p = p.select(
        *group, "a", "b", (F.col("form_a") == F.col("form_b")).alias("equal"), (negated(wa) == negated(wb)).alias("agree"), F.size(shared).alias("shared"), F.size(wa).alias("na"), F.size(wb).alias("nb"), least.alias("least"),
        (F.col("listing_a") & F.col("listing_b")).alias("lists"), F.size("subject_a").alias("sa"), F.size("subject_b").alias("sb"), F.size(F.array_intersect("subject_a", "subject_b")).alias("ss"),
        F.size(F.array_except(shared, F.array_union("subject_a", "subject_b"))).alias("claims"), "form_a", "form_b",
    )
    overlap, jaccard = F.col("shared") / F.least("na", "nb"), F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    ready = (F.col("na") > 0) & (F.col("nb") > 0) & F.col("agree")
    subjects = (F.col("sa") > 0) & (F.col("sb") > 0) & (F.col("ss") == F.least("sa", "sb")) & (F.abs(F.col("sa") - F.col("sb")) <= 1)
    claim = ready & subjects & (F.col("least") >= 5) & (overlap >= 0.65) & (F.col("claims") >= 3)
    listed = ready & F.col("lists") & (F.col("least") >= 10) & (overlap >= 0.80) & (jaccard >= 0.62)
    near = ready & (F.col("least") >= 8) & (overlap >= 0.95) & (jaccard >= 0.85)
    p = p.select(*group, "a", "b", "form_a", "form_b", (F.col("equal") | claim).alias("sure"), listed.alias("listed"), near.alias("near"))
    p = cut(p.where("sure OR listed OR near"))
    # texts are compared only where nothing else decides, by all cores: the rows are small but take long
    doubt = p.where("NOT sure").repartition(p.sparkSession.sparkContext.defaultParallelism)
    told = doubt.withColumn("ratio", sequence_ratio(F.col("form_a"), F.col("form_b"))).where("(listed AND ratio >= 0.62) OR (near AND ratio >= 0.90)")
    return p.where("sure").select(*group, "a", "b").unionByName(told.select(*group, "a", "b"))


def folded_facts(facts: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, order, statement, slides, n_rows): the facts that stay, each with the slides and the number of the rows it stands for.

    Facts are taken by ``order``. The richest statement of a group stays (an enumeration first, then the most content words, then the
    earliest) at the place of its first. A statement that repeats an earlier one word for word joins it and decides nothing more.
    Null and blank statements are left out; repeated rows count. An empty table gives none.
    """
    f = cut(_distinct_facts(facts, group, order))
    pairs = cut(duplicate_facts(f, group))
    node = lambda x: F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group], F.col(x).cast("string"))
    of = components(pairs.select(node("a").alias("a"), node("b").alias("b")))
    rows = f.select(*group, "id", "statement", "slides", "n_rows", F.struct(F.col("listing").cast("int").alias("listing"), F.size("content").alias("n")).alias("score"), node("id").alias("node"))
    edges = pairs.groupBy(*group, F.col("b").alias("id")).agg(F.collect_list("a").alias("before"))
    linked = rows.join(of, "node").join(edges, [*group, "id"], "left")
    kind = f.schema[order if order in f.columns else "id"].dataType.simpleString()
    schema = ", ".join([*[f"`{g}` {f.schema[g].dataType.simpleString()}" for g in group], f"id {kind}", "statement string", "slides array<int>", "n_rows bigint"])

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        link = {(int(a), int(i)) for i, before in zip(part["id"], part["before"]) if before is not None for a in before}
        says = lambda x, y: (min(x, y), max(x, y)) in link
        kept: list[dict] = []
        for r in part.to_dict("records"):
            mine = {**r, "slides": {int(x) for x in r["slides"]} if r["slides"] is not None else set(), "score": (r["score"]["listing"], r["score"]["n"])}
            same = [k for k, x in enumerate(kept) if says(int(x["id"]), int(r["id"]))]
            if not same:
                kept.append(mine)
                continue
            group_of = [kept[k] for k in same] + [mine]
            best = max(group_of, key=lambda x: x["score"])
            kept[same[0]] = {**best, "slides": set().union(*[x["slides"] for x in group_of]), "n_rows": sum(x["n_rows"] for x in group_of)}
            for k in reversed(same[1:]):
                del kept[k]
        out = pd.DataFrame(kept)
        out["slides"] = [sorted(x) for x in out["slides"]]
        return out[[*group, "id", "statement", "slides", "n_rows"]]

    alone = rows.join(linked.select("node"), "node", "left_anti").select(*group, "id", "statement", F.coalesce("slides", F.array().cast("array<int>")).alias("slides"), "n_rows")
    merged = linked.groupBy("component").applyInPandas(fold, schema)
    return alone.unionByName(merged).withColumnRenamed("id", order)
