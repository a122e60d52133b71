"""Queries of the lesson pipeline's own operators, named by what they do, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursegrain.functions import lesson as L
from coursegrain.functions.unicode import folded_sql
from coursegrain.operators import relational as R
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


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(replace({0}, chr(0), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
_BRIDGE = ", ".join(f"'{w}'" for w in L.BRIDGE_WORDS)


def _lesson_fact(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim(regexp_replace(coalesce({c}, ''), '{L._SPACE}', ' ', 'g')), '^- ', ''), '{L.LIST_MARKER}', ''))"


def _tok(x: str) -> str:
    return f"regexp_extract_all({folded_sql(x)}, '[a-z0-9]+')"


def _normal(x: str) -> str:
    return f"array_to_string({_tok(x)}, ' ')"


@query(rf"""SELECT page_id, number, alnum, CASE WHEN alnum >= 40 THEN 'text' WHEN method = 'ocr' AND alnum >= 1 THEN 'ocr' WHEN alnum >= 1 THEN 'text' ELSE 'unreadable' END AS decided
FROM (SELECT page_id, number, method, length(regexp_replace(coalesce({_CLEAN.format('text')}, ''), '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum FROM extracted_pages)""")
def src1_page_method(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "extracted_pages", "page_id", "number", "method", "text").select("page_id", "number", "method", F.coalesce(L.alnum_count(L.cleaned(F.col("text"))), F.lit(0)).cast("bigint").alias("alnum"))
    return p.select("page_id", "number", "alnum", F.when(F.col("alnum") >= 40, "text").when((F.col("method") == "ocr") & (F.col("alnum") >= 1), "ocr").when(F.col("alnum") >= 1, "text").otherwise("unreadable").alias("decided"))


@query(f"SELECT page_id, length(c) AS n, md5(c) AS digest FROM (SELECT page_id, {_CLEAN.format('text')} AS c FROM extracted_pages)")
def str1_clean_text(spark: SparkSession, d: str) -> DataFrame:
    c = L.cleaned(F.col("text"))
    return table(spark, d, "extracted_pages", "page_id", "text").select("page_id", F.length(c).cast("bigint").alias("n"), F.md5(c).alias("digest"))


@query(rf"""SELECT page_id, md5(regexp_replace(array_to_string(list_filter(string_split({_CLEAN.format('text')}, chr(10)), lambda x: NOT (length(regexp_replace(x, '[ \t]+', '', 'g')) BETWEEN 1 AND 3 AND NOT regexp_matches(x, '[\p{{L}}\p{{N}}]'))), chr(10)), '^[ \n]+|[ \n]+$', '', 'g')) AS digest FROM extracted_pages""")
def str2_without_specks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_pages", "page_id", "text").select("page_id", F.md5(L.without_specks(F.col("text"))).alias("digest"))


_FACTS = rf"""f AS (SELECT fact_row, course_code, module_number, kind, topic, slides, {_lesson_fact('statement')} AS s FROM facts),
n AS (SELECT *, {_normal('s')} AS form, list_filter({_tok('s')}, lambda x: x NOT IN ({_BRIDGE})) AS content,
  length(s) - length(translate(s, ',;', '')) >= 2 OR len(regexp_extract_all(s, '(?:^|\s)[0-9]+[.)]\s')) >= 3 AS listing FROM f)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts", "fact_row", *M, "kind", "topic", "slides", "statement").withColumn("s", L.lesson_fact(F.col("statement"))).drop("statement")
    f = f.withColumn("t", L.tokens(F.col("s")))
    return f.select("*", F.array_join("t", " ").alias("form"), L.content_of(F.col("t")).alias("content"), L.is_enumeration(F.col("s")).alias("listing")).drop("t")


@query(f"WITH {_FACTS} SELECT fact_row, s AS statement, form, len(content) AS n_content, CAST(listing AS INT) AS listing FROM n")
def str5_fact_forms(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("fact_row", F.col("s").alias("statement"), "form", F.size("content").cast("bigint").alias("n_content"), F.col("listing").cast("int").alias("listing"))


_WORDS = "regexp_extract_all(s, '{0}')".format(L.CONTENT_WORD.replace("'", "''"))


@query(rf"""WITH f AS (SELECT fact_row, {_lesson_fact('statement')} AS s, {_lesson_fact('topic')} AS about, lower(trim(coalesce(kind, ''))) AS sort FROM facts),
w AS (SELECT *, {_WORDS} AS words, regexp_extract(s, '^[A-Za-z]+') AS first FROM f),
c AS (SELECT *, CASE WHEN list_contains([{', '.join(f"'{x}'" for x in L.FRAGMENT_STARTS)}], lower(first)) AND first <> upper(first) THEN false
  WHEN regexp_matches(s, '{L.FRAGMENT_END}') OR regexp_matches(s, '^[\p{{Ll}}ªº]') OR len(words) < 2 THEN false WHEN len(words) = 2 THEN regexp_matches(s, '[.!]$') AND regexp_matches(words[2], '[a-z]')
  ELSE regexp_matches(s, '[.!]$') OR contains(s, ': ') OR regexp_matches(s, '{L.RELATION_VERB}') OR (len(words) >= 8 AND len(list_filter(words, lambda x: regexp_matches(x, '[a-z]'))) >= len(words) // 2) END AS alone FROM w)
SELECT fact_row, s AS statement, CASE WHEN lower(s) IN ('', 'not specified', '[unreadable text]') THEN 'missing' WHEN length(s) < 5 OR NOT contains(s, ' ') THEN 'short' WHEN about <> '' AND {_normal('s')} = {_normal('about')} THEN 'topic'
 {' '.join(f"WHEN regexp_matches(s, '{form}') THEN '{name}'" for name, form in L.NO_FACTS.items())}
 WHEN sort IN ('title', 'header', 'heading', 'objective') THEN 'structural' WHEN sort = 'content' AND NOT alone THEN 'not_self_contained' END AS reason FROM c""")
def flt1_lesson_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its cleaned statement and the reason why it is no lesson fact, null for the facts that are kept."""
    f = table(spark, d, "facts", "fact_row", "statement", "topic", "kind").withColumn("statement", L.lesson_fact(F.col("statement")))
    return f.select("fact_row", "statement", L.no_fact_reason(F.col("statement"), F.col("topic"), F.col("kind")).alias("reason"))


@query(f"""WITH {_FACTS}, g AS (SELECT course_code, module_number, form, count(*) AS n_rows, arg_max(fact_row, (listing, len(content), -fact_row)) AS fact_row FROM n WHERE form <> '' GROUP BY ALL),
u AS (SELECT course_code, module_number, form, list_sort(list(DISTINCT slide)) AS slides FROM (SELECT course_code, module_number, form, unnest(slides) AS slide FROM n) WHERE slide > 0 GROUP BY ALL)
SELECT g.course_code, g.module_number, g.form, n_rows, fact_row, array_to_string(slides, ';') AS slides FROM g LEFT JOIN u USING (course_code, module_number, form)""")
def agg4_fact_groups(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d).where("form <> ''")
    g = f.groupBy(*M, "form").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.struct("listing", F.size("content"), (-F.col("fact_row")).alias("r"))).alias("b"))
    u = f.select(*M, "form", F.explode("slides").alias("slide")).where("slide > 0").distinct().groupBy(*M, "form").agg(F.array_join(F.array_sort(F.collect_list("slide")), ";").alias("slides"))
    return g.join(u, [*M, "form"], "left").select(*M, "form", "n_rows", (-F.col("b.r")).alias("fact_row"), "slides")


_SHARED = f"""WITH {_FACTS}, m AS (SELECT course_code, module_number, fact_row, list_distinct({_tok('s')}) AS a, list_distinct({_tok("coalesce(topic, '')")}) AS b FROM n)
SELECT fact_row, len(list_intersect(a, b)) AS shared, len(a) + len(b) - len(list_intersect(a, b)) AS either FROM m WHERE a IS NOT NULL"""


@query(_SHARED)
def set5_topic_overlap(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d).where("s IS NOT NULL").select("fact_row", F.array_distinct(L.tokens(F.col("s"))).alias("a"), F.array_distinct(L.tokens(F.coalesce("topic", F.lit("")))).alias("b"))
    return f.select("fact_row", F.size(F.array_intersect("a", "b")).cast("bigint").alias("shared"), F.size(F.array_union("a", "b")).cast("bigint").alias("either"))


_ENT = r"""replace(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), '–', '-')"""
_TRIPLES = f"""t AS (SELECT triple_id, course_code, module_number, {_ENT.format('subject')} AS s, {_ENT.format('relation')} AS r, {_ENT.format('object')} AS o, subject, object, evidence_count FROM triples WHERE trim(subject) <> '' AND trim(object) <> '' AND trim(relation) <> '')"""


def _triples(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "triples", "triple_id", *M, "subject", "relation", "object", "evidence_count").where("trim(subject) <> '' AND trim(object) <> '' AND trim(relation) <> ''")
    key = lambda c: F.replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit("–"), F.lit("-"))
    return t.select("triple_id", *M, key("subject").alias("s"), key("relation").alias("r"), key("object").alias("o"), "subject", "object", "evidence_count")


@query(f"WITH {_TRIPLES} SELECT course_code, module_number, s, r, o, count(*) AS n_rows, min(triple_id) AS first_id, arg_min(subject, triple_id) AS subject, sum(evidence_count) AS evidence FROM t GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY course_code, module_number, s, r, o"))
def agg1_edges(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).groupBy(*M, "s", "r", "o").agg(F.count(F.lit(1)).alias("n_rows"), F.min("triple_id").alias("first_id"), F.min_by("subject", "triple_id").alias("subject"), F.sum("evidence_count").alias("evidence"))


_NODES = f"""WITH {_TRIPLES}, e AS (SELECT course_code, module_number, s, r, o, min(triple_id) AS i FROM t GROUP BY course_code, module_number, s, r, o),
p AS (SELECT course_code, module_number, s AS k FROM e UNION ALL SELECT course_code, module_number, o FROM e), g AS (SELECT course_code, module_number, k AS label, count(*) AS degree FROM p GROUP BY ALL)"""


@query(f"{_NODES} SELECT degree, count(*) AS n_nodes FROM g GROUP BY degree")
def agg2_degrees(spark: SparkSession, d: str) -> DataFrame:
    e = _triples(spark, d).select(*M, "s", "r", "o").distinct()
    g = e.select(*M, F.explode(F.array("s", "o")).alias("label")).groupBy(*M, "label").agg(F.count(F.lit(1)).alias("degree"))
    return g.groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(r"""SELECT doc_id, p AS pos, trim(m[1]) AS subject, trim(m[3]) AS relation, trim(m[2]) AS object FROM (SELECT doc_id, generate_subscripts(l, 1) AS p, [regexp_extract(unnest(l), '<triplet>([^<]*)<subj>([^<]*)<obj>([^<]*)', 1), regexp_extract(unnest(l), '<triplet>([^<]*)<subj>([^<]*)<obj>([^<]*)', 2), regexp_extract(unnest(l), '<triplet>([^<]*)<subj>([^<]*)<obj>([^<]*)', 3)] AS m FROM
(SELECT doc_id, regexp_extract_all(text, '<triplet>[^<]*<subj>[^<]*<obj>[^<]*') AS l FROM documents WHERE contains(text, '<triplet>'))) WHERE m[1] IS NOT NULL""")
def str14_marked_triplets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").where("contains(text, '<triplet>')")
    e = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(<triplet>[^<]*<subj>[^<]*<obj>[^<]*)"), 1)).alias("p", "m"))
    part = lambda k: F.trim(F.regexp_extract("m", "<triplet>([^<]*)<subj>([^<]*)<obj>([^<]*)", k))
    return e.select("doc_id", (F.col("p") + 1).cast("bigint").alias("pos"), part(1).alias("subject"), part(3).alias("relation"), part(2).alias("object"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS t FROM documents), s AS (SELECT doc_id, t, unnest(generate_series(0, len(t) - 1, 320)) AS s FROM w WHERE len(t) > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS chunk_no, s AS first, least(s + 384, len(t)) AS last, md5(array_to_string(t[s + 1:s + 384], ' ')) AS digest FROM s WHERE s = 0 OR s + 64 < len(t)""")
def win5_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = R.windows(table(spark, d, "documents", "doc_id", "text"), ["doc_id"], F.regexp_extract_all("text", F.lit(r"([^ \t\n\r\f\x0b]+)"), 1), 384, 64)
    return c.select("doc_id", "chunk_no", "first", "last", F.md5("chunk").alias("digest"))


_BUCKET = "CASE WHEN len(slides) > 0 AND slides[1] IS NOT NULL THEN 's' || slides[1] ELSE 't' || lower(coalesce(topic, 'general')) END"


@query(f"""WITH b AS (SELECT fact_row, course_code, module_number, {_BUCKET} AS bucket FROM facts), r AS (SELECT *, row_number() OVER w AS r, min(fact_row) OVER (PARTITION BY course_code, module_number, bucket) AS f FROM b WINDOW w AS (PARTITION BY course_code, module_number, bucket ORDER BY fact_row))
SELECT fact_row, course_code, module_number, bucket, row_number() OVER (PARTITION BY course_code, module_number ORDER BY r, f) AS pick FROM r QUALIFY pick <= 50""")
def win1_coverage_sample(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts", "fact_row", *M, "slides", "topic")
    first = F.get("slides", F.lit(0))
    b = f.select("fact_row", *M, F.when(first.isNotNull(), F.concat(F.lit("s"), first)).otherwise(F.concat(F.lit("t"), F.lower(F.coalesce("topic", F.lit("general"))))).alias("bucket"))
    return R.coverage_sample(b, M, "bucket", "fact_row", 50).withColumn("pick", F.col("pick").cast("bigint"))


_STEM = r"trim(regexp_replace(regexp_replace(lower(question), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "cards", "card_id", *M, "card_type", "question")
    return q.select("card_id", *M, "card_type", F.trim(F.regexp_replace(F.regexp_replace(F.lower("question"), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " ")).alias("stem")).where("stem <> ''")


@query(f"SELECT course_code, stem, min(card_id) AS card_id, count(*) AS n_rows FROM (SELECT card_id, course_code, {_STEM} AS stem FROM cards) WHERE stem <> '' GROUP BY course_code, stem")
def inc1_course_corpus(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).groupBy("course_code", "stem").agg(F.min("card_id").alias("card_id"), F.count(F.lit(1)).alias("n_rows"))


@query(f"""WITH q AS (SELECT card_id, course_code, {_STEM} AS stem FROM cards), f AS (SELECT course_code, stem, min(card_id) AS card_id FROM q WHERE stem <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS n, sum(length(stem) + 1) OVER w AS s FROM f WINDOW w AS (PARTITION BY course_code ORDER BY card_id DESC ROWS UNBOUNDED PRECEDING))
SELECT course_code, card_id, stem FROM r WHERE n <= 50 AND (s <= 1200 OR n = 1)""")
def win3_recent_signals(spark: SparkSession, d: str) -> DataFrame:
    f = _questions(spark, d).groupBy("course_code", "stem").agg(F.min("card_id").alias("card_id"))
    return R.recent_within_budget(f, ["course_code"], "stem", "card_id", 50, 1200).select("course_code", "card_id", "stem")


@query("SELECT fact_row, course_code, module_number, CAST(floor((row_number() OVER (PARTITION BY course_code, module_number ORDER BY fact_row) - 1) / 24) AS BIGINT) AS batch FROM facts")
def win8_batches(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy(*M).orderBy("fact_row"))
    return table(spark, d, "facts", "fact_row", *M).withColumn("batch", F.floor((n - 1) / 24).cast("bigint"))


@query("SELECT cluster, count(*) AS n_cards, count(*) FILTER (card_type = 'multiple-choice') AS multiple_choice, count(*) FILTER (card_type = 'identification') AS identification, count(*) FILTER (card_type = 'true-false') AS true_false, count(DISTINCT card_pos) AS positions FROM cards GROUP BY cluster")
def agg5_cluster_types(spark: SparkSession, d: str) -> DataFrame:
    n = lambda t: F.count(F.when(F.col("card_type") == t, 1)).alias(t.replace("-", "_"))
    return table(spark, d, "cards", "cluster", "card_type", "card_pos").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cards"), n("multiple-choice"), n("identification"), n("true-false"), F.countDistinct("card_pos").alias("positions"))


@query(r"""SELECT course_code, module_number, coalesce(nullif(regexp_replace(regexp_replace(source_file, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'module') AS file_part,
CASE WHEN regexp_full_match(module_number, '[0-9]+') THEN CAST(CAST(module_number AS BIGINT) AS VARCHAR) ELSE module_number END AS label, coalesce(nullif(regexp_extract(lower(source_file), '(?:^|[^a-z0-9])m(?:odule)?[ _.-]?([0-9]+)', 1), ''), '1') AS number_in_name FROM modules""")
def path1_components(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract(F.lower("source_file"), "(?:^|[^a-z0-9])m(?:odule)?[ _.-]?([0-9]+)", 1)
    return table(spark, d, "modules", *M, "source_file").select(*M, L.safe_component(F.col("source_file"), "module").alias("file_part"), L.module_label(F.col("module_number")).alias("label"), F.coalesce(F.nullif(number, F.lit("")), F.lit("1")).alias("number_in_name"))


@query("SELECT slide_id, p AS pos, t.term AS term, t.definition AS definition FROM (SELECT slide_id, unnest(definitions) AS t, unnest(generate_series(1, len(definitions))) AS p FROM slides)")
def src5_definitions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "slides", "slide_id", "definitions").select("slide_id", F.posexplode("definitions").alias("p", "t"))
    return e.select("slide_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.col("t.term").alias("term"), F.col("t.definition").alias("definition"))


@query("""SELECT course_code, module_number, arg_min(trim(title), slide_id) FILTER (trim(title) <> '' AND lower(trim(title)) NOT IN ('not specified', '[unreadable text]', 'n/a')) AS title,
arg_min(trim(brief_explanation), slide_id) FILTER (trim(brief_explanation) <> '' AND lower(trim(brief_explanation)) NOT IN ('not specified', '[unreadable text]', 'n/a')) AS explanation FROM slides GROUP BY course_code, module_number""")
def win11_first_meaningful(spark: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.min(F.when((F.trim(c) != "") & ~F.lower(F.trim(c)).isin(*L.MISSING), F.struct("slide_id", F.trim(c).alias("v"))))["v"]
    return table(spark, d, "slides", *M, "slide_id", "title", "brief_explanation").groupBy(*M).agg(first("title").alias("title"), first("brief_explanation").alias("explanation"))