"""Rules of assessment cards, clusters and modules, as relations of violations, and the text operators they stand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursegrain.functions import cards as C
from coursegrain.operators import relational as R
from coursegrain.sources.tables import table

M = ["course_code", "module_number"]
QUERIES, SQL = {}, {}
CARDS_A_CLUSTER, CLUSTERS_A_MODULE = 5, 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _broken(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule): one row for each rule that a row breaks."""
    return df.select(*keys, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for n, x in rules.items()]))).alias("rule"))


def _broken_sql(source: str, keys: str, rules: dict[str, str]) -> str:
    return f"SELECT {keys}, unnest(list_filter([{', '.join(f'CASE WHEN {x} THEN {chr(39)}{n}{chr(39)} END' for n, x in rules.items())}], lambda r: r IS NOT NULL)) AS rule FROM {source}"


def _cards(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "cards", "card_id", *columns)


_ALLOWED = ", ".join(f"'{t}'" for t in C.TYPES)
_HAS_BREAK = " OR ".join(rf"regexp_matches(coalesce({f}, ''), '[\r\n]')" for f in C.TEXT_FIELDS)


@query(_broken_sql("(SELECT cluster, count(*) AS n, " + ", ".join(f"count(*) FILTER (card_type = '{t}') AS t{k}" for k, t in enumerate(C.TYPES)) + " FROM cards GROUP BY cluster)", "cluster", {"count": f"n <> {CARDS_A_CLUSTER}", "types": "t0 = 0 OR t1 = 0 OR t2 = 0"}))
def val_k1_cluster_shape(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that have not exactly five cards, or not one of each type."""
    n = [F.count(F.when(F.col("card_type") == t, 1)).alias(f"t{k}") for k, t in enumerate(C.TYPES)]
    per = table(spark, d, "cards", "cluster", "card_type").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *n)
    return _broken(per, ["cluster"], {"count": F.col("n") != CARDS_A_CLUSTER, "types": (F.col("t0") == 0) | (F.col("t1") == 0) | (F.col("t2") == 0)})


@query("SELECT cluster, count(DISTINCT assessment_approach) AS approaches, array_to_string(list_sort(list(DISTINCT assessment_approach)), ';') AS names FROM cards GROUP BY cluster HAVING count(DISTINCT assessment_approach) <> 5")
def val_p4_approaches(spark: SparkSession, d: str) -> DataFrame:
    """Clusters without exactly five distinct approaches (at most ten approaches are allowed, so the set is bounded)."""
    per = table(spark, d, "cards", "cluster", "assessment_approach").groupBy("cluster").agg(F.array_sort(F.collect_set("assessment_approach")).alias("a"))
    return per.where(F.size("a") != 5).select("cluster", F.size("a").cast("bigint").alias("approaches"), F.array_join("a", ";").alias("names"))


@query(_broken_sql("cards", "card_id", {
    "type": f"card_type IS NULL OR card_type NOT IN ({_ALLOWED})", **{f: C.blank_sql(f) for f in ("question", "expalanation", "hint")},
    "difficulty": "difficulty IS NULL OR difficulty NOT IN (1, 2, 3)", "approach": C.blank_sql("assessment_approach"), "line_break": _HAS_BREAK,
}))
def val_k3_fields(spark: SparkSession, d: str) -> DataFrame:
    c = _cards(spark, d, "card_type", "difficulty", "assessment_approach", *C.TEXT_FIELDS)
    line_break = F.lit(False)
    for f in C.TEXT_FIELDS:
        line_break = line_break | F.coalesce(f, F.lit("")).rlike(r"[\r\n]")
    return _broken(c, ["card_id"], {
        "type": F.col("card_type").isNull() | ~F.col("card_type").isin(*C.TYPES), **{f: C.blank(F.col(f)) for f in ("question", "expalanation", "hint")},
        "difficulty": F.col("difficulty").isNull() | ~F.col("difficulty").isin(1, 2, 3), "approach": C.blank(F.col("assessment_approach")), "line_break": line_break,
    })


@query(_broken_sql("cards", "card_id", {
    "wrapper": f"regexp_matches(trim(question), '{C.LEADING_WRAPPER}')", "framing": " OR ".join(f"contains(lower(question), '{p.lower()}')" for p in C.BANNED_FRAMING), "generic_explanation": f"regexp_matches(trim(expalanation), '{C.GENERIC_EXPLANATION}')",
}))
def val_k4_k6_framing(spark: SparkSession, d: str) -> DataFrame:
    """Questions that speak of their source, and explanations that only say that an answer is right."""
    framing = F.lit(False)
    for p in C.BANNED_FRAMING:
        framing = framing | F.contains(F.lower("question"), F.lit(p.lower()))
    return _broken(_cards(spark, d, "question", "expalanation"), ["card_id"], {"wrapper": F.trim("question").rlike(C.LEADING_WRAPPER), "framing": framing, "generic_explanation": F.trim("expalanation").rlike(C.GENERIC_EXPLANATION)})


@query("SELECT card_id, field, trigger FROM (" + " UNION ALL ".join(f"SELECT card_id, '{f}' AS field, {C.provenance_sql(f)} AS trigger FROM cards" for f in C.TEXT_FIELDS) + ") WHERE trigger IS NOT NULL")
def val_k5_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The seven text fields as rows, those that show where a claim came from with the wording that does."""
    c = _cards(spark, d, *C.TEXT_FIELDS)
    rows = c.select("card_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in C.TEXT_FIELDS])).alias("x"))
    # each field is searched once: the explode keeps the search from moving into the filter as well
    found = rows.select("card_id", "x.field", F.explode(F.array(C.provenance_trigger(F.col("x.value")))).alias("trigger"))
    return found.where("trigger IS NOT NULL")


@query(_broken_sql("cards", "card_id", {
    "stem": f"card_type = 'identification' AND NOT regexp_matches(trim(question), '{C.DIRECT_STEM}')", "question_mark": "card_type IN ('multiple-choice', 'identification') AND NOT suffix(rtrim(question), '?')",
    "declarative": "card_type = 'true-false' AND (contains(question, '?') OR regexp_matches(lower(trim(question)), '^true(?: or |/)false'))",
}))
def val_k7_stems(spark: SparkSession, d: str) -> DataFrame:
    kind, q = F.col("card_type"), F.col("question")
    return _broken(_cards(spark, d, "card_type", "question"), ["card_id"], {
        "stem": (kind == "identification") & ~F.trim(q).rlike(C.DIRECT_STEM), "question_mark": kind.isin("multiple-choice", "identification") & ~F.rtrim(q).endswith("?"),
        "declarative": (kind == "true-false") & (F.contains(q, F.lit("?")) | F.lower(F.trim(q)).rlike("^true(?: or |/)false")),
    })


_PAIRS = [(a, b) for k, a in enumerate(C.OPTIONS) for b in C.OPTIONS[k + 1 :]]


@query("WITH o AS (SELECT card_id, " + ", ".join(f"{C.canonical_option_sql(f'coalesce({f}, {chr(39)}{chr(39)})')} AS {f}" for f in C.OPTIONS) + " FROM cards WHERE card_type = 'multiple-choice') "
       + " UNION ALL ".join(f"SELECT card_id, '{a}' AS left_field, '{b}' AS right_field, {a} AS identity FROM o WHERE {a} = {b}" for a, b in _PAIRS))
def val_k8_option_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of options of a card (six at most) that are the same by option identity."""
    c = _cards(spark, d, "card_type", *C.OPTIONS).where("card_type = 'multiple-choice'").select("card_id", *[C.canonical_option(F.coalesce(f, F.lit(""))).alias(f) for f in C.OPTIONS])
    pairs = F.array_compact(F.array(*[F.when(F.col(a) == F.col(b), F.struct(F.lit(a).alias("left_field"), F.lit(b).alias("right_field"), F.col(a).alias("identity"))) for a, b in _PAIRS]))
    return c.select("card_id", F.explode(pairs).alias("x")).select("card_id", "x.*")


_ANSWER = r"regexp_replace(coalesce(correct_option, ''), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')"
_NO_WRONG = " AND ".join(C.blank_sql(f) for f in C.OPTIONS[1:])
_ALL_WRONG = " AND ".join(f"NOT {C.blank_sql(f)}" for f in C.OPTIONS[1:])


@query(_broken_sql("cards", "card_id", {
    "choice_options": f"card_type = 'multiple-choice' AND ({C.blank_sql('correct_option')} OR NOT ({_ALL_WRONG}))", "choice_is_true": "card_type = 'multiple-choice' AND is_true IS NOT NULL",
    "answer_missing": f"card_type = 'identification' AND {C.blank_sql('correct_option')}", "answer_options": f"card_type = 'identification' AND NOT ({_NO_WRONG})", "answer_is_true": "card_type = 'identification' AND is_true IS NOT NULL",
    "answer_long": f"card_type = 'identification' AND (len(regexp_extract_all({_ANSWER}, '[^\\s]+')) > 12 OR regexp_matches({_ANSWER}, '[.?!]$'))",
    "statement_options": f"card_type = 'true-false' AND NOT ({C.blank_sql('correct_option')} AND {_NO_WRONG})", "statement_is_true": "card_type = 'true-false' AND (is_true IS NULL OR is_true NOT IN (0, 1))",
}))
def val_k8_k10_options(spark: SparkSession, d: str) -> DataFrame:
    """What each type of card must have in its options and in is_true."""
    kind, is_true, blank = F.col("card_type"), F.col("is_true"), {f: C.blank(F.col(f)) for f in C.OPTIONS}
    wrong = [blank[f] for f in C.OPTIONS[1:]]
    none, some = wrong[0] & wrong[1] & wrong[2], wrong[0] | wrong[1] | wrong[2]
    answer = C.bare(F.coalesce("correct_option", F.lit("")))
    choice, name, claim = kind == "multiple-choice", kind == "identification", kind == "true-false"
    return _broken(_cards(spark, d, "card_type", "is_true", *C.OPTIONS), ["card_id"], {
        "choice_options": choice & (blank["correct_option"] | some), "choice_is_true": choice & is_true.isNotNull(),
        "answer_missing": name & blank["correct_option"], "answer_options": name & ~none, "answer_is_true": name & is_true.isNotNull(),
        "answer_long": name & ((F.size(F.regexp_extract_all(answer, F.lit(r"(\S+)"), 1)) > 12) | answer.rlike("[.?!]$")),
        "statement_options": claim & ~(blank["correct_option"] & none), "statement_is_true": claim & (is_true.isNull() | ~is_true.isin(0, 1)),
    })


@query("WITH c AS (SELECT card_id, card_type, " + ", ".join(f"{C.canonical_option_sql(f'coalesce({f}, {chr(39)}{chr(39)})')} AS {n}" for f, n in (("correct_option", "a"), ("question", "q"), ("hint", "h"))) + " FROM cards) "
       + _broken_sql("c", "card_id", {"question": f"card_type = 'identification' AND {C.holds_answer_sql('q', 'a')}", "hint": C.holds_answer_sql("h", "a")}))
def val_k9_k11_answer_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Identification questions, and hints of any card, in which the whole answer stands."""
    c = _cards(spark, d, "card_type", "correct_option", "question", "hint").select("card_id", "card_type", *[C.canonical_option(F.coalesce(f, F.lit(""))).alias(n) for f, n in (("correct_option", "a"), ("question", "q"), ("hint", "h"))])
    return _broken(c, ["card_id"], {"question": (F.col("card_type") == "identification") & C.holds_answer(F.col("q"), F.col("a")), "hint": C.holds_answer(F.col("h"), F.col("a"))})


_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


@query(f"WITH u AS (SELECT course_code, module_number, cluster, count(*) AS n FROM cards GROUP BY ALL), m AS (SELECT course_code, module_number, count(DISTINCT cluster) AS clusters, sum(n) AS cards, count(*) FILTER (cluster IS NULL OR NOT regexp_full_match(lower(cluster), '{_UUID}')) AS bad FROM u GROUP BY ALL) "
       + _broken_sql("m", "course_code, module_number", {"clusters": f"clusters <> {CLUSTERS_A_MODULE}", "cards": f"cards <> {CLUSTERS_A_MODULE * CARDS_A_CLUSTER}", "uuid": "bad > 0"}))
def val_m1_module_shape(spark: SparkSession, d: str) -> DataFrame:
    """Modules without exactly 20 clusters and 100 cards, or with a cluster that is no canonical UUID."""
    clusters = table(spark, d, "cards", *M, "cluster").groupBy(*M, "cluster").agg(F.count(F.lit(1)).alias("n"))
    bad = F.col("cluster").isNull() | ~F.lower("cluster").rlike(f"^{_UUID}$")
    per = clusters.groupBy(*M).agg(F.count("cluster").alias("clusters"), F.sum("n").alias("cards"), F.count(F.when(bad, 1)).alias("bad"))
    return _broken(per, M, {"clusters": F.col("clusters") != CLUSTERS_A_MODULE, "cards": F.col("cards") != CLUSTERS_A_MODULE * CARDS_A_CLUSTER, "uuid": F.col("bad") > 0})


@query(f"SELECT card_id, {C.question_stem_sql('question')} AS stem, array_to_string({C.negation_markers_sql(C.question_words_sql('question'))}, ' ') AS markers, array_to_string({C.content_words_sql(C.question_words_sql('question'))}, ' ') AS content, array_to_string({C.polarity_words_sql(C.content_words_sql(C.question_words_sql('question')))}, ' ') AS polarity FROM cards")
def str21_question_forms(spark: SparkSession, d: str) -> DataFrame:
    """Stem, negations, content words and polarity words of each question."""
    return _question_forms(_cards(spark, d, "question")).select("card_id", "stem", F.array_join("markers", " ").alias("markers"), F.array_join("content", " ").alias("content"), F.array_join("polarity", " ").alias("polarity"))


def _question_forms(c: DataFrame) -> DataFrame:
    w = c.select("*", C.question_stem(F.col("question")).alias("stem"), C.question_words(F.col("question")).alias("_w"))
    w = w.select("*", C.negation_markers(F.col("_w")).alias("markers"), C.content_words(F.col("_w")).alias("content")).drop("_w")
    return w.withColumn("polarity", C.polarity_words(F.col("content")))


@query(f"SELECT card_id, {C.canonical_option_sql('correct_option')} AS identity FROM cards WHERE correct_option IS NOT NULL")
def str22_option_identity(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d, "correct_option").where("correct_option IS NOT NULL").select("card_id", C.canonical_option(F.col("correct_option")).alias("identity"))


@query(f"SELECT course_code, module_number, {C.question_stem_sql('question')} AS stem, min(card_id) AS class_id, count(*) AS n_cards, count(DISTINCT card_type) AS n_types FROM cards WHERE question IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def val_m2_equal_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions that a module asks more than once, in any type: one row a class of equal questions, not its pairs."""
    q = _cards(spark, d, *M, "card_type", "question").where("question IS NOT NULL").select("card_id", *M, "card_type", C.question_stem(F.col("question")).alias("stem"))
    per_type = q.groupBy(*M, "stem", "card_type").agg(F.min("card_id").alias("c"), F.count(F.lit(1)).alias("n"))
    return per_type.groupBy(*M, "stem").agg(F.min("c").alias("class_id"), F.sum("n").alias("n_cards"), F.count("card_type").alias("n_types")).where("n_cards > 1")


def _form_classes(spark: SparkSession, d: str, block: list[str]) -> DataFrame:
    """One row for each different question of a block: its forms and its smallest card."""
    f = _question_forms(_cards(spark, d, *block, "question").where("question IS NOT NULL"))
    return f.groupBy(*block, "stem").agg(F.min("card_id").alias("card_id"), *[F.min(x).alias(x) for x in ("markers", "content", "polarity")])


def _one_word_apart(f: DataFrame, block: list[str], words: str) -> DataFrame:
    """(block, id_a, id_b) of classes whose ``words`` are equal, or differ by one more word beside at least four."""
    some = f.where(F.size(words) > 0)
    w = F.col(words)
    short = some.where(F.size(words) > 4).select(*block, F.col("card_id").alias("x"), "markers", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.concat(F.slice(w, 1, i - 1), F.slice(w, i + 1, F.size(w))), " ")))).alias("k"))
    full = some.select(*block, F.col("card_id").alias("y"), F.col("markers").alias("other"), F.array_join(words, " ").alias("k"))
    own = full.withColumnsRenamed({"y": "x", "other": "markers"})
    met = short.join(full, [*block, "k"]).unionByName(own.join(full, [*block, "k"]).where("x < y"))
    return met.where("x <> y").select(*block, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), (F.col("markers") == F.col("other")).alias("same")).distinct()


def near_question_classes(spark: SparkSession, d: str, block: list[str]) -> DataFrame:
    """(block, id_a, id_b, kind): near questions of a block, between the smallest cards of different questions.

    'near': the same negations, content words equal or one more. 'polarity': other negations, polarity words equal or one more.
    """
    f = _form_classes(spark, d, block)
    near = _one_word_apart(f, block, "content").where("same").select(*block, "id_a", "id_b", F.lit("near").alias("kind"))
    polar = _one_word_apart(f, block, "polarity").where("NOT same").select(*block, "id_a", "id_b", F.lit("polarity").alias("kind"))
    return near.unionByName(polar)


def _near_sql(block: str, on: str) -> str:
    words = C.question_words_sql("question")
    return f"""WITH f AS (SELECT {block}, {C.question_stem_sql('question')} AS stem, min(card_id) AS card_id, min({C.negation_markers_sql(words)}) AS markers, min({C.content_words_sql(words)}) AS content FROM cards WHERE question IS NOT NULL GROUP BY ALL),
g AS (SELECT *, {C.polarity_words_sql('content')} AS polarity FROM f),
e AS (SELECT {block}, card_id, markers, 'near' AS kind, content AS w FROM g UNION ALL SELECT {block}, card_id, markers, 'polarity', polarity FROM g),
k AS (SELECT {block}, card_id, markers, kind, w, array_to_string(w, ' ') AS k, true AS whole FROM e WHERE len(w) > 0
  UNION SELECT {block}, card_id, markers, kind, w, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' '), false FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM e WHERE len(w) > 4))
SELECT DISTINCT {', '.join('a.' + b.strip() for b in block.split(','))}, least(a.card_id, b.card_id) AS id_a, greatest(a.card_id, b.card_id) AS id_b, a.kind FROM k a JOIN k b ON {on} AND a.kind = b.kind AND a.k = b.k AND a.card_id <> b.card_id AND b.whole
WHERE CASE a.kind WHEN 'near' THEN a.markers = b.markers ELSE a.markers <> b.markers END"""


@query(_near_sql("course_code, module_number, card_type", "a.course_code = b.course_code AND a.module_number = b.module_number AND a.card_type = b.card_type"))
def val_m2_near_questions(spark: SparkSession, d: str) -> DataFrame:
    """Near questions of one type within a module."""
    return near_question_classes(spark, d, [*M, "card_type"])


@query(_near_sql("cluster", "a.cluster = b.cluster"))
def val_m3_cluster_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Near questions and mirrored claims within a cluster, across types."""
    return near_question_classes(spark, d, ["cluster"])


_NUMBER = "CASE WHEN regexp_full_match(module_number, '[0-9]+') THEN CAST(module_number AS BIGINT) END"


@query(f"""WITH q AS (SELECT card_id, course_code, {_NUMBER} AS n, {C.question_stem_sql('question')} AS stem FROM cards WHERE question IS NOT NULL), f AS (SELECT course_code, stem, min(n) AS first FROM q WHERE stem <> '' AND n IS NOT NULL GROUP BY ALL)
SELECT q.card_id, q.course_code, first AS first_module FROM q JOIN f USING (course_code, stem) WHERE q.n > f.first""")
def join11_earlier_questions(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose question an earlier module of the course asks; modules are compared as numbers, those without one are left out."""
    n = F.when(F.col("module_number").rlike("^[0-9]+$"), F.col("module_number").cast("bigint"))
    q = _cards(spark, d, *M, "question").where("question IS NOT NULL").select("card_id", "course_code", n.alias("n"), C.question_stem(F.col("question")).alias("stem")).where("stem <> '' AND n IS NOT NULL")
    f = q.groupBy("course_code", "stem").agg(F.min("n").alias("first_module"))
    return q.join(f, ["course_code", "stem"]).where("n > first_module").select("card_id", "course_code", "first_module")


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


#: Texts with sources, by kind, and what stays of them.
_CITED = [
    (1, "explanation", "Pressure is explicitly stated as force per area in the provided facts.", None, "Pressure is force per area."), (2, "explanation", "The provided facts state that water boils at high heat", None, "Water boils at high heat."),
    (3, "explanation", "The lesson explains that a pump moves water.", None, "A pump moves water."), (4, "explanation", "Fact f12 states that a valve opens the pipe.", None, "A valve opens the pipe."), (5, "explanation", "A pump, as described in the module, moves water.", None, "A pump moves water."),
    (6, "explanation", "The rule mentioned in the text guides the pump.", None, "The rule guides the pump."), (7, "explanation", "The answer quotes the definition, which describes osmosis as moving water across a wall.", None, "Osmosis is characterized by moving water across a wall."),
    (8, "explanation", "The term is defined in the provided definition as a wall of cells.", "membrane", "Membrane is a wall of cells."), (9, "explanation", "This statement is true: water is cold in winter.", None, "Water is cold in winter."),
    (10, "explanation", "It is mentioned in the text.", None, "It is mentioned in the text."), (11, "hint", "According to the lesson.", None, "."), (16, "hint", "The knowledge graph's text, provided text.", None, C.PLAIN_HINT), (12, "hint", "Think of the pipe, as stated in the module.", None, "Think of the pipe."),
    (13, "question", "What moves the water according to the provided facts?", None, "What moves the water?"), (14, "question", "Why, based on the text?", None, "Why, based on the text?"), (15, "hint", "Think of the pump.", None, "Think of the pump."),
]


@query(_values([(i, clean) for i, _, _, _, clean in _CITED], "id, clean"))
def str26_cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    """Literal explanations, hints and questions without the clauses that name a source."""
    t = spark.createDataFrame([r[:4] for r in _CITED], "id int, kind string, text string, answer string")
    x, kind = F.col("text"), F.col("kind")
    return t.select("id", F.when(kind == "hint", C.cleaned_hint(x)).when(kind == "question", C.cleaned_question(x)).otherwise(C.cleaned_explanation(x, F.col("answer"))).alias("clean"))


#: How a concept's cards may ask.
APPROACHES = ("recall", "comparison", "classification", "application", "scenario analysis", "cause/effect", "misconception detection", "conditions", "consequences", "reversed reasoning")
_ARTIFACT = r"(?i)^\s*(?:(?:the\s+)?(?:title|heading|name|number|topic|focus|overview|content)\s+(?:of|for)\s+(?:the\s+)?(?:module|unit|chapter|lesson|section|slide|page)\b|(?:the\s+)?(?:module|unit|chapter|lesson|section|slide|page)\s+(?:title|heading|name|number|topic|focus|overview|content)\b)"
CONCEPTS, TARGETS = 20, 5


def plan_violations(targets: DataFrame, facts: DataFrame, concepts: int = CONCEPTS) -> DataFrame:
    """(module, concept, rule) of concept plans.

    ``targets`` has one row for each planned card: module, concept, name, point, approach, fact_id; ``facts`` has module, fact_id and
    statement. A plan has enough concepts with names of their own that are no artifacts of presentation; a concept has five targets
    with different points and approaches, all of known facts, of which one at least is no artifact.
    """
    known = targets.join(facts.select("module", "fact_id", F.coalesce(F.col("statement").rlike(_ARTIFACT), F.lit(False)).alias("artifact")), ["module", "fact_id"], "left")
    per = known.withColumn("p", C.question_stem(F.col("point"))).groupBy("module", "concept").agg(
        F.min("name").alias("name"), F.count(F.lit(1)).alias("n"), F.countDistinct("p").alias("points"), F.count("p").alias("with_point"), F.countDistinct("approach").alias("approaches"),
        F.count(F.when(F.coalesce(~F.col("approach").isin(*APPROACHES), F.lit(True)), 1)).alias("odd"), F.count(F.when(F.col("artifact").isNull(), 1)).alias("unknown"), F.count(F.when(~F.col("artifact"), 1)).alias("sound"),
    ).withColumn("stem", C.question_stem(F.col("name")))
    twice = per.groupBy("module", "stem").agg(F.count(F.lit(1)).alias("uses"), F.min("concept").alias("first"))
    of = _broken(per.join(twice, ["module", "stem"]), ["module", "concept"], {
        "name": C.blank(F.col("name")), "name_again": (F.col("uses") > 1) & (F.col("concept") > F.col("first")), "name_artifact": F.col("name").rlike(_ARTIFACT), "targets": F.col("n") != TARGETS, "points": F.col("points") < F.col("with_point"),
        "approach": F.col("odd") > 0, "approaches": F.col("approaches") != TARGETS, "fact": F.col("unknown") > 0, "artifacts_only": (F.col("sound") == 0) & (F.col("unknown") == 0),
    })
    few = per.groupBy("module").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < concepts).select("module", F.lit(None).cast("int").alias("concept"), F.lit("concepts").alias("rule"))
    return of.unionByName(few)


_TARGETS = [("m", c, n, f"{n} point {k}", a, f"f{c}") for c, n in ((1, "Pumps"), (2, "pumps!"), (3, "Valves")) for k, a in enumerate(APPROACHES[:5])]
_TARGETS += [("m", 4, "Module title", "same", "recall", "f9"), ("m", 4, "Module title", "Same.", "guessing", "f5"), ("m", 5, "Slides", "a point", "recall", "f5")]
_PLAN_FACTS = [("m", "f1", "A pump moves water."), ("m", "f2", "A pump has a shaft."), ("m", "f3", "A valve opens."), ("m", "f5", "The title of the module is Pumps.")]


@query("SELECT module, concept, rule FROM (VALUES ('m', 2, 'name_again'), ('m', 4, 'name_artifact'), ('m', 4, 'targets'), ('m', 4, 'points'), ('m', 4, 'approach'), ('m', 4, 'approaches'), ('m', 4, 'fact'), ('m', 5, 'targets'), ('m', 5, 'approaches'), ('m', 5, 'artifacts_only'), ('m', NULL, 'concepts')) t(module, concept, rule)")
def val_p_plan_rules(spark: SparkSession, d: str) -> DataFrame:
    """A literal plan that breaks each rule of concept plans."""
    return plan_violations(spark.createDataFrame(_TARGETS, "module string, concept int, name string, point string, approach string, fact_id string"), spark.createDataFrame(_PLAN_FACTS, "module string, fact_id string, statement string"))


_PAIR = r"(?i)^card ([0-9]+) duplicates cluster (.+?) card ([0-9]+)$"


def reviewed(issues: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, card, of_cluster, of_card, error) of review reasons (cluster, reason): a duplicate must name two cards that there are and differ."""
    r = issues.join(clusters.select("cluster", F.col("n").alias("own")), "cluster", "left").withColumn("of_cluster", F.nullif(F.regexp_extract("reason", _PAIR, 2), F.lit("")))
    number = lambda k: F.nullif(F.regexp_extract("reason", _PAIR, k), F.lit("")).cast("int")
    r = r.withColumn("card", number(1)).withColumn("of_card", number(3)).join(clusters.select(F.col("cluster").alias("of_cluster"), F.col("n").alias("other")), "of_cluster", "left")
    inside = F.col("card").between(1, F.col("own")) & F.col("of_card").between(1, F.col("other"))
    error = (
        F.when(F.col("own").isNull(), "unknown cluster").when(C.blank(F.col("reason")), "no reason").when(F.col("card").isNull(), "no pair").when(F.col("other").isNull(), "unknown other cluster")
        .when(~inside, "no such card").when((F.col("cluster") == F.col("of_cluster")) & (F.col("card") == F.col("of_card")), "itself")
    )
    return r.select("cluster", "card", "of_cluster", "of_card", error.alias("error"))


_REASONS = [("a", "card 2 duplicates cluster b card 1"), ("a", "Card 1 duplicates cluster a card 1"), ("a", "card 9 duplicates cluster b card 1"), ("x", "card 1 duplicates cluster b card 1"), ("a", "too easy"), ("a", " "), ("b", "card 1 duplicates cluster z card 1")]


@query("SELECT cluster, card, of_cluster, of_card, error FROM (VALUES ('a', 2, 'b', 1, NULL), ('a', 1, 'a', 1, 'itself'), ('a', 9, 'b', 1, 'no such card'), ('x', 1, 'b', 1, 'unknown cluster'), ('a', NULL, NULL, NULL, 'no pair'), ('a', NULL, NULL, NULL, 'no reason'), ('b', 1, 'z', 1, 'unknown other cluster')) t(cluster, card, of_cluster, of_card, error)")
def val_r1_review_reasons(spark: SparkSession, d: str) -> DataFrame:
    return reviewed(spark.createDataFrame(_REASONS, "cluster string, reason string"), spark.createDataFrame([("a", 5), ("b", 5)], "cluster string, n int"))


def editable_fields(error: Column) -> Column:
    """The text fields that may be edited to mend a card, by its error message; empty where none may."""
    x = F.lower(error)
    named = F.filter(F.array(*[F.lit(f) for f in C.TEXT_FIELDS]), lambda f: F.contains(x, f))
    twice = F.regexp_extract_all(error, F.lit(r"(correct_option|wrong_option_[123])"), 1)
    return (
        F.when(x.rlike(r"^cards? [0-9]+ (?:and [0-9]+ )?(?:are|duplicates)\b"), F.array(F.lit("question")))
        .when(F.contains(x, F.lit("duplicate options:")), F.when(F.size(twice) >= 2, F.array(F.element_at(twice, -1))).otherwise(F.array().cast("array<string>")))
        .when(F.size(named) > 0, named).when(F.contains(x, F.lit("requires one correct and three non-empty wrong options")), F.array(*[F.lit(f) for f in C.OPTIONS]))
        .when(F.contains(x, F.lit("identification answer must be a concise phrase")), F.array(F.lit("correct_option"))).otherwise(F.array().cast("array<string>"))
    )


_MESSAGES = [
    (1, "cards 1 and 3 are near duplicates", "question"), (2, 'card 2 multiple-choice duplicate options: correct_option "a" and wrong_option_2 "a"', "wrong_option_2"), (3, "card 1 hint reveals the correct answer", "hint"), (4, "card 1 expalanation must explain the answer", "expalanation"),
    (5, "card 4 multiple-choice requires one correct and three non-empty wrong options", "correct_option;wrong_option_1;wrong_option_2;wrong_option_3"), (6, "card 4 identification answer must be a concise phrase", "correct_option"), (7, "expected exactly 5 cards, received 4", ""),
]


@query(_values([(i, f) for i, _, f in _MESSAGES], "id, fields"))
def val_rep_editable_fields(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([r[:2] for r in _MESSAGES], "id int, error string")
    return t.select("id", F.array_join(editable_fields(F.col("error")), ";").alias("fields"))
