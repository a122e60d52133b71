"""Checks of what comes in and goes out: card objects, signatures, manifests, file names, flagged cards, merged issues, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursegrain.functions import graph as G
from coursegrain.functions import lesson as L
from coursegrain.plans import lesson
from coursegrain.sources.tables import table

M = ["course_code", "module_number"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


_RULE = r"(?m)^[-=]{3,}[ \t]*$"


@query(rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(0), ' '), chr(13) || chr(10), chr(10)), '{_RULE}', chr(10), 'g'), '(?m)^[ \t]*[{{}}][ \t]*$', chr(10), 'g'), '(?m)^[ \t]*(?:Content|Brief Explanation):[ \t]*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))) AS digest FROM documents WHERE text IS NOT NULL")
def str4_graph_clean(spark: SparkSession, d: str) -> DataFrame:
    """Texts before relations are read from them: rules, lone braces and bare labels go, blank lines are squeezed."""
    x = F.replace(F.translate("text", "\0", " "), F.lit("\r\n"), F.lit("\n"))
    for pattern, kept in ((_RULE, "\n"), (r"(?m)^[ \t]*[{}][ \t]*$", "\n"), (r"(?m)^[ \t]*(?:Content|Brief Explanation):[ \t]*$", ""), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, f"(?d){pattern}" if "(?m)" in pattern else pattern, kept)
    return table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.md5(F.trim(x, F.lit(" \t\n"))).alias("digest"))


@query(f"""WITH {lesson._FACTS}, b AS (SELECT fact_row, regexp_extract(form, '^(.*?)\\b(?:{L.PREDICATE})\\b', 1) AS s FROM n)
SELECT fact_row, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(s), ' '), lambda x: x <> '' AND x NOT IN ({', '.join(f"'{w}'" for w in L.BRIDGE_WORDS)})))), ' ') AS subject FROM b""")
def str8_fact_subjects(spark: SparkSession, d: str) -> DataFrame:
    """What each fact is about: the content words before the first verb of its predicate."""
    f = table(spark, d, "facts", "fact_row", "statement").select("fact_row", L.normal_form(L.lesson_fact(F.col("statement"))).alias("form"))
    return f.select("fact_row", F.array_join(L.subject_of(F.col("form")), " ").alias("subject"))


_STEM = r"(?i)^(?:what\s+term|what|which\s+of\s+the\s+following|which|who|where|when|why|how)\b(?:\s+(?:is|are|was|were|does|do|did|best\s+describes?|most\s+accurately\s+describes?))?\s*"
_TAIL = r"(?i)\s*(?:according to|based on|as\s+(?:stated|described)\s+in)\s+the\s+(?:provided|supplied|given)?\s*(?:facts?|material|module|content|text|information|evidence)\s*\.?\s*$"


@query(rf"""WITH q AS (SELECT card_id, card_type, is_true, correct_option, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(trim(rtrim(trim(regexp_replace(question, '[\s\x{{a0}}]+', ' ', 'g')), '?')), '{_TAIL}', ''), '{_STEM}', '')), '(?i)^(?:a|an|the)\s+', ''), '\s+$', '')) AS s, trim(regexp_replace(question, '[\s\x{{a0}}]+', ' ', 'g')) AS q FROM cards WHERE question IS NOT NULL)
SELECT card_id, CASE WHEN s = '' THEN q[1:40] ELSE array_to_string(string_split(s, ' ')[1:8], ' ') END || ' -> ' || CASE WHEN card_type = 'true-false' THEN CASE WHEN is_true = 1 THEN 'true' ELSE 'false' END ELSE array_to_string(string_split(trim(regexp_replace(coalesce(correct_option, ''), '[\s\x{{a0}}]+', ' ', 'g')), ' ')[1:4], ' ') END AS signature FROM q""")
def str31_card_signatures(spark: SparkSession, d: str) -> DataFrame:
    """What a card asks about and its answer in a few words, as a short sign of what it tests."""
    c = table(spark, d, "cards", "card_id", "card_type", "is_true", "correct_option", "question").where("question IS NOT NULL")
    line = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    q = line(F.col("question"))
    s = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.rtrim(q, F.lit("?"))), _TAIL, ""), _STEM, "")), r"(?i)^(?:a|an|the)\s+", ""))
    few = lambda x, n: F.array_join(F.slice(F.split(x, " "), 1, n), " ")
    subject = F.when(s == "", F.substring(q, 1, 40)).otherwise(few(s, 8))
    answer = F.when(F.col("card_type") == "true-false", F.when(F.col("is_true") == 1, "true").otherwise("false")).otherwise(few(line(F.coalesce("correct_option", F.lit(""))), 4))
    return c.select("card_id", F.concat(subject, F.lit(" -> "), answer).alias("signature"))


_OF_SLIDE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:the\s+title|the\s+topic)\s+of\s+(?:the|this)\s+slide(?:$|[^\p{L}\p{N}_])"


@query(f"SELECT fact_row FROM facts WHERE regexp_matches(statement, '{_OF_SLIDE}')")
def flt3_slide_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that only speak of their slide's title or topic."""
    return table(spark, d, "facts", "fact_row", "statement").where(F.col("statement").rlike(_OF_SLIDE)).select("fact_row")


#: The fields of a card object, and those that each type must have beside the common ones.
CARD_FIELDS = "type question correct_option wrong_option_1 wrong_option_2 wrong_option_3 is_true expalanation explanation hint difficulty assessment_approach".split()
COMMON = "type question hint".split()
NEEDED = {"multiple-choice": "correct_option wrong_option_1 wrong_option_2 wrong_option_3 is_true".split(), "identification": ["correct_option", "is_true"], "true-false": ["is_true"]}


def card_object_error(raw: Column) -> Column:
    """Why a JSON text is no card object; null for those that are. Numbers are told from truth values and fractions by their JSON type."""
    v = F.try_parse_json(raw)
    kind = F.try_variant_get(v, "$.type", "string")
    of = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in CARD_FIELDS])))
    needed = F.array(*[F.lit(f) for f in COMMON])
    for t, fields in NEEDED.items():
        needed = F.when(kind == t, F.array(*[F.lit(f) for f in COMMON + fields])).otherwise(needed)
    missing = F.concat(F.array_sort(F.array_except(needed, keys)), F.when(F.array_contains(keys, "expalanation") | F.array_contains(keys, "explanation"), F.array().cast("array<string>")).otherwise(F.array(F.lit("expalanation"))))
    is_true, hard = F.try_variant_get(v, "$.is_true", "int"), of("difficulty")
    return (
        F.when(v.isNull() | ~F.coalesce(F.ltrim(raw).startswith("{"), F.lit(False)), "no object").when(of("type") != "STRING", "type").when(kind.isNull(), "type")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ", "))).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(raw.rlike(r"(?i)\b(?:distractor pool|allowed[_\s]wrong[_\s]option[_\s]terms)\b"), "internal wording").when(~of("is_true").isin("VOID", "BIGINT") | (of("is_true") == "BIGINT") & ~is_true.isin(0, 1), "is_true")
        .when(F.array_contains(keys, "difficulty") & (hard != "BIGINT"), "difficulty")
    )


_C = '"question": "q", "hint": "h", "expalanation": "e"'
_OBJECTS = [
    (1, f'{{"type": "true-false", {_C}, "is_true": 1}}', None), (2, f'{{"type": "true-false", {_C}, "is_true": true}}', "is_true"), (3, f'{{"type": "true-false", {_C}, "is_true": 2}}', "is_true"), (4, f'{{"type": "identification", {_C}, "is_true": null}}', "missing: correct_option"),
    (5, f'{{"type": "true-false", {_C}, "is_true": 0, "zeta": 1, "alpha": 2}}', "unknown: alpha, zeta"), (6, "[1]", "no object"), (7, "{nope", "no object"), (8, f'{{"type": 3, {_C}}}', "type"), (9, '{"type": "true-false", "question": "q", "hint": "h", "is_true": 1}', "missing: expalanation"),
    (10, '{"type": "true-false", "question": "the distractor pool", "hint": "h", "explanation": "e", "is_true": 1}', "internal wording"), (11, f'{{"type": "true-false", {_C}, "is_true": 1, "difficulty": 1.5}}', "difficulty"), (12, f'{{"type": "true-false", {_C}, "is_true": 1, "difficulty": 2}}', None), (13, None, "no object"),
]


@query(_rows([(i, e) for i, _, e in _OBJECTS], "id, error"))
def val_c1_card_objects(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([r[:2] for r in _OBJECTS], "id int, raw string").select("id", card_object_error(F.col("raw")).alias("error"))


def tolerant_list(raw: Column) -> Column:
    """Names in one string with commas between them, in brackets or not, without quotes; blank ones are dropped."""
    bare = F.regexp_replace(F.trim(raw), r"^\[(.*)\]$", "$1")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]+|['\"]+$", "")), lambda x: x != "")


_LISTS = [(1, "f1, f2", "f1|f2"), (2, "['f1', \"f2\"]", "f1|f2"), (3, " , ", ""), (4, "recall", "recall"), (5, "", "")]


@query(_rows([(i, x) for i, _, x in _LISTS], "id, items"))
def json4_name_lists(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([r[:2] for r in _LISTS], "id int, raw string").select("id", F.array_join(tolerant_list(F.col("raw")), "|").alias("items"))


def manifest_errors(files: DataFrame) -> DataFrame:
    """(path, error) of a manifest's records (path, size, digest): unsafe paths, paths that come twice up to case, bad sizes and digests."""
    p = F.replace("path", F.lit("\\"), F.lit("/"))
    unsafe = F.coalesce(F.trim("path") == "", F.lit(True)) | p.startswith("/") | p.rlike(r"(?:^|/)\.\.(?:/|$)") | p.rlike(r"^[^/]*:") | p.isin(".", "./")
    key = F.lower(F.regexp_replace(p, r"(?:^|(?<=/))\./|/{2,}", ""))
    keyed = files.withColumn("key", key)
    twice = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    error = F.when(unsafe, "unsafe path").when(F.col("uses") > 1, "path again").when(F.col("size").isNull() | (F.col("size") < 0), "size").when(~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest")
    return keyed.join(twice, "key", "left").select("path", error.alias("error")).where("error IS NOT NULL")


_HEX = "a" * 64
_FILES = [("ok/a.txt", 1, _HEX), ("../up", 1, _HEX), ("/abs", 1, _HEX), ("C:\\x", 1, _HEX), ("A/b", 1, _HEX), ("a/B", 1, _HEX), ("neg", -1, _HEX), ("hex", 1, "zz"), ("", 1, _HEX), (None, 1, _HEX), ("no/size", None, _HEX), ("x/../y", 1, _HEX)]


@query(_rows([("../up", "unsafe path"), ("/abs", "unsafe path"), ("C:\\x", "unsafe path"), ("A/b", "path again"), ("a/B", "path again"), ("neg", "size"), ("hex", "digest"), ("", "unsafe path"), (None, "unsafe path"), ("no/size", "size"), ("x/../y", "unsafe path")], "path, error"))
def src12_manifest_errors(spark: SparkSession, d: str) -> DataFrame:
    return manifest_errors(spark.createDataFrame(_FILES, "path string, size bigint, digest string"))


def upload_name(c: Column) -> Column:
    """The safe name of an uploaded file; null where there is none or it is no PDF."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"([^/]*)/*$", 1), "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when((x != "") & F.lower(x).endswith(".pdf"), x)


@query(r"SELECT course_code, module_number, CASE WHEN x <> '' AND suffix(lower(x), '.pdf') THEN x END AS name FROM (SELECT course_code, module_number, regexp_replace(regexp_replace(regexp_extract(source_file, '([^/]*)/*$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS x FROM modules)")
def path3_upload_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "modules", *M, "source_file").select(*M, upload_name(F.col("source_file")).alias("name"))


def untouched_cards(errors: DataFrame, total: int = 5) -> DataFrame:
    """(cluster, kept): the cards of each cluster that no message names, as numbers; null where a message names none, or none there is."""
    named = F.filter(F.flatten(F.array(F.regexp_extract_all("error", F.lit(r"(?i)\bcards? ([0-9]+)"), 1), F.regexp_extract_all("error", F.lit(r"(?i)\bcards [0-9]+ and ([0-9]+)"), 1))), lambda x: x != "").cast("array<int>")
    per = errors.select("cluster", named.alias("n")).select("cluster", "n", ((F.size("n") == 0) | F.exists("n", lambda x: ~x.between(1, total))).alias("lost"))
    g = per.groupBy("cluster").agg(F.bool_or("lost").alias("lost"), F.array_distinct(F.flatten(F.collect_list("n"))).alias("n"))  # at most ``total`` numbers a message
    kept = F.array_except(F.sequence(F.lit(1), F.lit(total)), F.col("n"))
    return g.select("cluster", F.when(~F.col("lost"), F.array_join(kept.cast("array<string>"), ",")).alias("kept"))


@query(_rows([("a", "2,4"), ("b", None), ("c", None)], "cluster, kept"))
def set8_untouched_cards(spark: SparkSession, d: str) -> DataFrame:
    rows = [("a", "card 1 hint reveals it"), ("a", "cards 3 and 5 are near duplicates"), ("b", "card 1 hint"), ("b", "expected exactly 5 cards"), ("c", "card 9 hint")]
    return untouched_cards(spark.createDataFrame(rows, "cluster string, error string"))


def merged_issues(issues: DataFrame) -> DataFrame:
    """(cluster, reasons): the reasons of each cluster once, in the order in which they first came (cluster, pos, reason)."""
    first = issues.groupBy("cluster", "reason").agg(F.min("pos").alias("pos"))
    g = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "reason"))).alias("r"))
    return g.select("cluster", F.array_join(F.transform("r", lambda x: x["reason"]), "; ").alias("reasons"))


@query(_rows([("a", "too easy; wrong"), ("b", "wrong")], "cluster, reasons"))
def agg9_merged_issues(spark: SparkSession, d: str) -> DataFrame:
    return merged_issues(spark.createDataFrame([("a", 1, "too easy"), ("b", 2, "wrong"), ("a", 3, "wrong"), ("a", 4, "too easy")], "cluster string, pos int, reason string"))


@query(r"SELECT lang, count(DISTINCT source_file) AS files, count(DISTINCT coalesce(module_title, '')) AS titles FROM modules GROUP BY lang HAVING count(DISTINCT source_file) > 1")
def set9_mixed_settings(spark: SparkSession, d: str) -> DataFrame:
    """Groups of a batch whose settings differ (here files and titles of each language of modules)."""
    m = table(spark, d, "modules", "lang", "source_file", "module_title").groupBy("lang").agg(F.countDistinct("source_file").alias("files"), F.countDistinct(F.coalesce("module_title", F.lit(""))).alias("titles"))
    return m.where("files > 1")


@query("SELECT fact_row, CASE WHEN k = 1 THEN base ELSE base || '#' || k END AS reference FROM (SELECT fact_row, base, row_number() OVER (PARTITION BY course_code, module_number, base ORDER BY fact_row) AS k FROM (SELECT *, coalesce(nullif(trim(fact_id), ''), 'fact-' || fact_row) AS base FROM facts))")
def grf7_unique_references(spark: SparkSession, d: str) -> DataFrame:
    """A reference of its own for each fact of a module: its id, and a number from the second with that id on."""
    base = F.coalesce(F.nullif(F.trim("fact_id"), F.lit("")), F.concat(F.lit("fact-"), F.col("fact_row").cast("string")))
    f = table(spark, d, "facts", "fact_row", *M, "fact_id").withColumn("base", base)
    k = F.row_number().over(W.partitionBy(*M, "base").orderBy("fact_row"))
    return f.withColumn("k", k).select("fact_row", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("#"), F.col("k").cast("string"))).alias("reference"))


_PARTS = [(1, "Intro.\nSlide 1\nA pump is a machine.\nSlide 2\nThe machine has a pump.\nSlide 3 A pump drives a machine.", "pump", "machine"), (2, "No slides: a pump is a machine.", "pump", "machine"), (3, "Slide 4\nNothing here.", "pump", "machine")]


def slide_evidence(chunks: DataFrame) -> DataFrame:
    """(id, slide, words, confidence): the slides of a chunk (id, text, subject, object) that name subject and object in order, else the whole chunk.

    Evidence of fewer than eight words counts half.
    """
    parts = F.filter(F.split(F.concat(F.lit("\n"), "text"), r"(?im)\n\s*(?=Slide\s+[0-9]+)"), lambda x: x.rlike(r"(?i)^Slide\s+[0-9]+"))
    e = chunks.select("id", "text", "subject", "object", F.explode_outer(parts).alias("part"))
    e = e.withColumn("slide", F.regexp_extract("part", r"(?i)^Slide\s+([0-9]+)", 1).cast("int")).withColumn("body", F.regexp_replace("part", r"(?i)^Slide\s+[0-9]+\s*", ""))
    e = e.where("part IS NOT NULL").where(G.supports(F.col("subject"), F.lit("is_a"), F.col("object"), F.col("body"))).select("id", "slide", "body")
    rest = chunks.join(e.select("id").distinct(), "id", "left_anti").select("id", F.lit(None).cast("int").alias("slide"), F.col("text").alias("body"))
    words = F.size(F.regexp_extract_all(F.lower("body"), F.lit("([a-z0-9]+)"), 1))
    return e.unionByName(rest).select("id", "slide", words.alias("words"), F.when(words < 8, 0.5).otherwise(1.0).alias("confidence"))


@query("SELECT * FROM (VALUES (1, 1, 5, CAST(0.5 AS DOUBLE)), (1, 3, 5, 0.5), (2, NULL, 7, 0.5), (3, NULL, 4, 0.5)) t(id, slide, words, confidence)")
def join13_slide_evidence(spark: SparkSession, d: str) -> DataFrame:
    return slide_evidence(spark.createDataFrame(_PARTS, "id int, text string, subject string, object string"))
