"""Tagged module texts, written from slides and read back: metadata, slides, sections, facts and prose; paths, files and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursegrain.functions import lesson as L
from coursegrain.operators import relational as R
from coursegrain.sources import files
from coursegrain.sources.tables import table

M = ["course_code", "module_number"]
QUERIES, SQL = {}, {}
#: The fields of a module's head, and the sections of a slide in their order.
HEAD = ("format_version", "course_code", "module_number", "module_title", "source_file")
SECTIONS = ("TITLE", "CONTENT", "VISUAL_TEXT", "DEFINITIONS", "KNOWLEDGE_STATEMENTS", "BRIEF_EXPLANATION")
MISSING = ("Not Specified", "[Unreadable Text]")
#: A line that would be read as a tag when it stands alone.
TAG_LIKE = r"(?i)^\[/?(?:MODULE|SLIDE(?:\s+[0-9]+)?|" + "|".join(SECTIONS) + r")\]$"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _safe(c: Column) -> Column:
    """One line; a text that would be read as a tag gets full-width brackets."""
    x = _one_line(c)
    return F.when(x.rlike(TAG_LIKE), F.translate(x, "[]", "［］")).otherwise(x)


_ONE_LINE = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{a0}}]+', ' ', 'g'))"
_TAG = TAG_LIKE.replace("'", "''")
_SAFE = f"(CASE WHEN regexp_matches({_ONE_LINE}, '{_TAG.replace('{', '{{').replace('}', '}}')}') THEN translate({_ONE_LINE}, '[]', '［］') ELSE {_ONE_LINE} END)"


def _list_sql(column: str) -> str:
    return f"coalesce(nullif(array_to_string(list_transform(list_filter({column}, lambda x: {_ONE_LINE.format('x')} <> ''), lambda x: '- ' || {_SAFE.format('x')}), chr(10)), ''), 'Not Specified')"


def _section_sql(name: str, body: str) -> str:
    return f"'[{name}]' || chr(10) || {body} || chr(10) || '[/{name}]'"


_DEFS = f"coalesce(nullif(array_to_string(list_transform(list_filter(definitions, lambda t: {_ONE_LINE.format('t.term')} <> '' AND {_ONE_LINE.format('t.definition')} <> ''), lambda t: '- ' || {_ONE_LINE.format('t.term')} || ' :: ' || {_ONE_LINE.format('t.definition')}), chr(10)), ''), 'Not Specified')"
_SLIDE = " || chr(10) || ".join([
    "'[SLIDE ' || number || ']'", "'extraction_method: ' || coalesce(extraction_method, 'text')", _section_sql("TITLE", f"coalesce(nullif({_SAFE.format('title')}, ''), 'Not Specified')"), _section_sql("CONTENT", _list_sql("content")),
    _section_sql("VISUAL_TEXT", _list_sql("visual_text")), _section_sql("DEFINITIONS", _DEFS), _section_sql("KNOWLEDGE_STATEMENTS", _list_sql("knowledge_statements")),
    _section_sql("BRIEF_EXPLANATION", f"coalesce(nullif({_SAFE.format('brief_explanation')}, ''), 'Not Specified')"), "'[/SLIDE]'",
])


def tagged_slide() -> Column:
    """The tagged text of a slide with its six sections; empty sections say so."""
    given = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(MISSING[0]))
    lines = lambda c: given(F.array_join(F.transform(F.filter(c, lambda x: _one_line(x) != ""), lambda x: F.concat(F.lit("- "), _safe(x))), "\n"))
    terms = F.filter("definitions", lambda t: (_one_line(t["term"]) != "") & (_one_line(t["definition"]) != ""))
    bodies = {
        "TITLE": given(_safe(F.col("title"))), "CONTENT": lines("content"), "VISUAL_TEXT": lines("visual_text"),
        "DEFINITIONS": given(F.array_join(F.transform(terms, lambda t: F.concat(F.lit("- "), _one_line(t["term"]), F.lit(" :: "), _one_line(t["definition"]))), "\n")),
        "KNOWLEDGE_STATEMENTS": lines("knowledge_statements"), "BRIEF_EXPLANATION": given(_safe(F.col("brief_explanation"))),
    }
    parts = [F.concat(F.lit("[SLIDE "), F.col("number").cast("string"), F.lit("]")), F.concat(F.lit("extraction_method: "), F.coalesce("extraction_method", F.lit("text")))]
    parts += [F.concat(F.lit(f"[{n}]\n"), b, F.lit(f"\n[/{n}]")) for n, b in bodies.items()] + [F.lit("[/SLIDE]")]
    return F.array_join(F.array(*parts), "\n")


_SLIDE_COLUMNS = ("number", "extraction_method", "title", "content", "visual_text", "definitions", "knowledge_statements", "brief_explanation")


@query(f"SELECT slide_id, {_SLIDE} AS tagged FROM slides WHERE number IS NOT NULL")
def snk1_tagged_slides(spark: SparkSession, d: str) -> DataFrame:
    """Every slide with all its sections as tagged text."""
    return table(spark, d, "slides", "slide_id", *_SLIDE_COLUMNS).where("number IS NOT NULL").select("slide_id", tagged_slide().alias("tagged"))


@query(f"""WITH t AS (SELECT course_code, module_number, number, slide_id, {_SLIDE} AS tagged FROM slides WHERE number IS NOT NULL), g AS (SELECT course_code, module_number, string_agg(tagged, chr(10) || chr(10) ORDER BY number, slide_id) AS body FROM t GROUP BY ALL)
SELECT m.course_code, m.module_number, md5('[MODULE]' || chr(10) || 'format_version: 1' || chr(10) || 'course_code: ' || m.course_code || chr(10) || 'module_number: ' || m.module_number || chr(10) || 'module_title: ' || coalesce(nullif({_ONE_LINE.format('module_title')}, ''), 'Not Specified') || chr(10) || 'source_file: ' || coalesce(source_file, 'Not Specified') || chr(10) || '[/MODULE]' || chr(10) || chr(10) || body || chr(10)) AS digest, length(body) AS n_chars
FROM modules m JOIN g USING (course_code, module_number)""")
def snk1_module_texts(spark: SparkSession, d: str) -> DataFrame:
    """The digest and size of each module's whole tagged text. A module is one file, so its slides do come together."""
    s = table(spark, d, "slides", "slide_id", *M, *_SLIDE_COLUMNS).where("number IS NOT NULL").select(*M, "number", "slide_id", tagged_slide().alias("tagged"))
    g = s.groupBy(*M).agg(F.array_sort(F.collect_list(F.struct("number", "slide_id", "tagged"))).alias("s")).select(*M, F.array_join(F.transform("s", lambda x: x["tagged"]), "\n\n").alias("body"))
    head = F.concat_ws("\n", F.lit("[MODULE]\nformat_version: 1"), F.concat(F.lit("course_code: "), "course_code"), F.concat(F.lit("module_number: "), "module_number"), F.concat(F.lit("module_title: "), F.coalesce(F.nullif(_one_line(F.col("module_title")), F.lit("")), F.lit(MISSING[0]))), F.concat(F.lit("source_file: "), F.coalesce("source_file", F.lit(MISSING[0]))), F.lit("[/MODULE]"))
    return table(spark, d, "modules", *M, "module_title", "source_file").join(g, M).select(*M, F.md5(F.concat(head, F.lit("\n\n"), "body", F.lit("\n"))).alias("digest"), F.length("body").cast("bigint").alias("n_chars"))


def tagged_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, line, head, slide, section) of tagged texts: each line with the slide and the section that are open at it."""
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "[\n\x0b\x0c\x1c\x1d\x1e\x85  ]", -1)).alias("at", "raw")).select(key, "at", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("line"))
    line = F.col("line")
    opened, closed = F.regexp_extract(line, r"^\[([A-Z_]+)(?:\s+[0-9]+)?\]$", 1), line.rlike(r"^\[/[A-Z_]+(?:\s+[0-9]+)?\]$")
    slide = F.regexp_extract(line, r"(?i)^\[SLIDE\s+([0-9]+)\]$", 1)
    is_slide, ends_slide = slide != "", F.lower(line) == "[/slide]"
    marks = {
        "slide": F.when(is_slide, slide.cast("int")).when(ends_slide, F.lit(-1)), "place": F.when(is_slide | ends_slide, F.col("at")),
        "section": F.when(is_slide | ends_slide | closed, F.lit("")).when(opened != "", opened), "head": F.when(line == "[MODULE]", 1).when(line == "[/MODULE]", 0),
    }
    return R.forward_filled(lines, [key], "at", marks)


_LINES = r"""lines AS (SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS pos, trim(unnest(l), ' ' || chr(9)) AS line FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents WHERE doc_kind = 'module_text' AND text IS NOT NULL)),
marked AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^\[SLIDE\s+[0-9]+\]$') THEN CAST(regexp_extract(line, '(?i)^\[SLIDE\s+([0-9]+)\]$', 1) AS INT) WHEN lower(line) = '[/slide]' THEN -1 END AS s,
 CASE WHEN regexp_matches(line, '(?i)^\[SLIDE\s+[0-9]+\]$') OR lower(line) = '[/slide]' OR regexp_matches(line, '^\[/[A-Z_]+(?:\s+[0-9]+)?\]$') THEN '' WHEN regexp_matches(line, '^\[[A-Z_]+(?:\s+[0-9]+)?\]$') THEN regexp_extract(line, '^\[([A-Z_]+)', 1) END AS t,
 CASE line WHEN '[MODULE]' THEN 1 WHEN '[/MODULE]' THEN 0 END AS h FROM lines),
tagged AS (SELECT doc_id, pos, line, last_value(s IGNORE NULLS) OVER w AS slide, last_value(CASE WHEN s IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS place, last_value(t IGNORE NULLS) OVER w AS section, last_value(h IGNORE NULLS) OVER w AS head FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


def _module_lines(spark: SparkSession, d: str) -> DataFrame:
    return tagged_lines(table(spark, d, "documents", "doc_id", "doc_kind", "text").where("doc_kind = 'module_text' AND text IS NOT NULL"), "doc_id", "text")


_FIELD = "^(" + "|".join(HEAD) + r")\s*:\s*(.*)$"


@query(rf"WITH {_LINES} SELECT doc_id, regexp_extract(line, '{_FIELD}', 1) AS name, arg_max(trim(regexp_extract(line, '{_FIELD}', 2)), pos) AS value FROM tagged WHERE head = 1 AND regexp_matches(line, '{_FIELD[:-6]}[^\s]') GROUP BY ALL")
def src4_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The five fields of a module's head that are not blank; of a field written twice the last."""
    t = _module_lines(spark, d).where("head = 1").where(F.col("line").rlike(_FIELD[:-6] + r"\S"))
    v = t.select("doc_id", "at", F.regexp_extract("line", _FIELD, 1).alias("name"), F.trim(F.regexp_extract("line", _FIELD, 2)).alias("value"))
    return v.groupBy("doc_id", "name").agg(F.max_by("value", "at").alias("value"))


_FACT_SECTIONS = {"DEFINITIONS": ("definition", 0), "KNOWLEDGE_STATEMENTS": ("knowledge_statement", 0), "CONTENT": ("content", 1)}


@query(rf"""WITH {_LINES}, l AS (SELECT *, CASE WHEN starts_with(line, '- ') THEN trim(line[3:]) ELSE line END AS body FROM tagged WHERE slide > 0 AND line <> '' AND NOT regexp_matches(line, '^\[/?[A-Z_]+(?:\s+[0-9]+)?\]$')),
f AS (SELECT doc_id, place, slide, pos, section, CASE section WHEN 'DEFINITIONS' THEN CASE WHEN contains(body, ' :: ') THEN trim(split_part(body, ' :: ', 1)) || ': ' || trim(body[instr(body, ' :: ') + 4:]) END ELSE line END AS s FROM l WHERE section IN ('DEFINITIONS', 'KNOWLEDGE_STATEMENTS', 'CONTENT')),
c AS (SELECT *, trim(regexp_replace(CASE WHEN starts_with(s, '- ') THEN s[3:] ELSE s END, '\s+', ' ', 'g')) AS statement FROM f WHERE s IS NOT NULL),
k AS (SELECT *, bool_or(section <> 'CONTENT') OVER (PARTITION BY doc_id, place) AS told FROM c WHERE length(statement) >= 5 AND contains(statement, ' ') AND lower(statement) NOT IN ('not specified', '[unreadable text]'))
SELECT doc_id, slide, pos, CASE section WHEN 'DEFINITIONS' THEN 'definition' WHEN 'KNOWLEDGE_STATEMENTS' THEN 'knowledge_statement' ELSE 'content' END AS kind, statement FROM k WHERE NOT (told AND section = 'CONTENT')""")
def src4_slide_facts(spark: SparkSession, d: str) -> DataFrame:
    """The statements that tagged slides offer: definitions and knowledge statements, and the content of slides that have neither."""
    line = F.col("line")
    body = F.when(line.startswith("- "), F.trim(F.substring(line, F.lit(3), F.length(line)))).otherwise(line)
    t = _module_lines(spark, d).where("slide > 0 AND line <> ''").where(~line.rlike(r"^\[/?[A-Z_]+(?:\s+[0-9]+)?\]$") & F.col("section").isin(*_FACT_SECTIONS)).withColumn("body", body)
    term, meaning = F.split_part("body", F.lit(" :: "), F.lit(1)), F.expr("substring(body, instr(body, ' :: ') + 4)")
    s = F.when(F.col("section") != "DEFINITIONS", line).when(F.contains("body", F.lit(" :: ")), F.concat(F.trim(term), F.lit(": "), F.trim(meaning)))
    c = t.withColumn("s", s).where("s IS NOT NULL").withColumn("statement", F.trim(F.regexp_replace(F.when(F.col("s").startswith("- "), F.expr("substring(s, 3)")).otherwise(F.col("s")), r"\s+", " ")))
    k = c.where((F.length("statement") >= 5) & F.contains("statement", F.lit(" ")) & ~F.lower("statement").isin("not specified", "[unreadable text]"))
    told = F.max(F.col("section") != "CONTENT").over(W.partitionBy("doc_id", "place"))
    kind = F.when(F.col("section") == "DEFINITIONS", "definition").when(F.col("section") == "KNOWLEDGE_STATEMENTS", "knowledge_statement").otherwise("content")
    return k.withColumn("told", told).where(~(F.col("told") & (F.col("section") == "CONTENT"))).select("doc_id", "slide", F.col("at").cast("bigint").alias("pos"), kind.alias("kind"), "statement")


@query(rf"""WITH {_LINES}, l AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '(?i)^\[SLIDE\s+[0-9]+\]$') THEN 'Slide ' || slide WHEN section = 'DEFINITIONS' AND starts_with(line, '- ') AND contains(line, ' :: ') THEN split_part(line[3:], ' :: ', 1) || ': ' || line[instr(line, ' :: ') + 4:] WHEN starts_with(line, '- ') THEN line[3:] ELSE line END AS out
 FROM tagged WHERE regexp_matches(line, '(?i)^\[SLIDE\s+[0-9]+\]$') OR (section IN ('{"', '".join(SECTIONS)}') AND line <> '' AND NOT regexp_matches(line, '^\[/?[A-Z_]+(?:\s+[0-9]+)?\]$') AND line NOT IN ('Not Specified', '- Not Specified', '[Unreadable Text]', '- [Unreadable Text]')))
SELECT doc_id, md5(string_agg(out, chr(10) ORDER BY pos)) AS digest, count(*) AS n_lines FROM l GROUP BY doc_id""")
def str12_graph_text(spark: SparkSession, d: str) -> DataFrame:
    """The prose of tagged texts that relations are read from: slide numbers and the lines of the six sections, without what is missing."""
    line = F.col("line")
    is_slide = line.rlike(r"(?i)^\[SLIDE\s+[0-9]+\]$")
    gone = [*MISSING, *[f"- {m}" for m in MISSING]]
    t = _module_lines(spark, d).where(is_slide | (F.col("section").isin(*SECTIONS) & (line != "") & ~line.rlike(r"^\[/?[A-Z_]+(?:\s+[0-9]+)?\]$") & ~line.isin(*gone)))
    rest = F.expr("substring(line, 3)")
    defined = F.concat(F.split_part(rest, F.lit(" :: "), F.lit(1)), F.lit(": "), F.expr("substring(line, instr(line, ' :: ') + 4)"))
    out = F.when(is_slide, F.concat(F.lit("Slide "), F.col("slide").cast("string"))).when((F.col("section") == "DEFINITIONS") & line.startswith("- ") & F.contains(line, F.lit(" :: ")), defined).when(line.startswith("- "), rest).otherwise(line)
    g = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", out.alias("out")))).alias("l"))
    return g.select("doc_id", F.md5(F.array_join(F.transform("l", lambda x: x["out"]), "\n")).alias("digest"), F.size("l").cast("bigint").alias("n_lines"))


_SAFE_PART = "coalesce(nullif(regexp_replace(regexp_replace(trim({0}), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), '{1}')"


@query(f"SELECT course_code, module_number, {_SAFE_PART.format('course_code', 'course')} || '/' || {_SAFE_PART.format('course_code', 'course')} || '_M' || CASE WHEN regexp_full_match(trim(module_number), '[0-9]+') THEN CAST(CAST(trim(module_number) AS BIGINT) AS VARCHAR) ELSE {_SAFE_PART.format('module_number', 'module')} END || '.csv' AS path FROM modules")
def path_card_files(spark: SparkSession, d: str) -> DataFrame:
    """Where the card file of each module goes."""
    course = L.safe_component(F.trim("course_code"), "course")
    return table(spark, d, "modules", *M).select(*M, F.concat(course, F.lit("/"), course, F.lit("_M"), L.module_label(F.trim("module_number")), F.lit(".csv")).alias("path"))


_FIELDS = ("card_type", "question", "correct_option", "wrong_option_1", "wrong_option_2", "wrong_option_3", "is_true", "expalanation", "hint", "difficulty", "cluster", "course_code", "module_number")
_PLAIN = " AND ".join(rf"NOT regexp_matches(coalesce({f}, ''), '[\r\n]')" for f in files.TEXT_COLUMNS)


@query(f"SELECT course_code, module_number, row_number() OVER (PARTITION BY course_code, module_number ORDER BY cluster, card_pos, card_id) AS card_no, " + ", ".join(f"coalesce(CAST({f} AS VARCHAR), '') AS f_{f}" for f in _FIELDS[:11]) + f" FROM cards WHERE {_PLAIN}")
def src8_card_file_rows(spark: SparkSession, d: str) -> DataFrame:
    """The cards of each module's file, written and read back; cards with a line break in a field are left out before."""
    cards = table(spark, d, "cards", "card_id", "card_pos", *_FIELDS)
    for f in files.TEXT_COLUMNS:
        cards = cards.where(~F.coalesce(f, F.lit("")).rlike(r"[\r\n]"))
    rows = files.read_card_lines(files.card_lines(cards))
    return rows.select(*M, "card_no", *[F.col(f"f_{f}") for f in _FIELDS[:11]])


@query("SELECT course_code, module_number, count(*) AS n_blocks, sum(n) AS n_cards, count(*) FILTER (n <> 50) AS bad_blocks FROM (SELECT course_code, module_number, CAST(floor((k - 1) / 50) AS BIGINT) AS b, count(*) AS n FROM (SELECT course_code, module_number, row_number() OVER (PARTITION BY course_code, module_number ORDER BY cluster, card_pos, card_id) AS k FROM cards WHERE " + _PLAIN + ") GROUP BY ALL) GROUP BY ALL")
def agg6_card_file_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What the blocks of each card file hold: how many there are, their cards, and blocks without exactly fifty."""
    cards = table(spark, d, "cards", "card_id", "card_pos", *_FIELDS)
    for f in files.TEXT_COLUMNS:
        cards = cards.where(~F.coalesce(f, F.lit("")).rlike(r"[\r\n]"))
    per = files.read_card_lines(files.card_lines(cards)).groupBy(*M, "block").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*M).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n").alias("n_cards"), F.count(F.when(F.col("n") != 50, 1)).alias("bad_blocks"))


_ANSWERS = [(1, '{"a": 1}'), (2, '```json\n{"a": 2}\n```'), (3, 'Here it is: {"a": 3} as asked'), (4, "no object"), (5, "[1, 2]"), (6, '```\n{"a": 6}```'), (7, '{"a": 7'), (8, None), (9, '  {"a": 9}  ')]


@query("SELECT * FROM (VALUES (1, '{\"a\":1}', true), (2, '{\"a\":2}', false), (3, '{\"a\":3}', false), (4, NULL, false), (5, NULL, false), (6, '{\"a\":6}', false), (7, NULL, false), (8, NULL, false), (9, '{\"a\":9}', true)) t(id, body, strict)")
def json1_answer_objects(spark: SparkSession, d: str) -> DataFrame:
    """The JSON object in a model's answer, also inside a fence or beside other words, and whether the answer is nothing but it."""
    t = spark.createDataFrame(_ANSWERS, "id int, raw string")
    body = files.json_object(F.col("raw"))
    return t.select("id", F.to_json(F.try_parse_json(body)).alias("body"), F.coalesce(files.is_strict_object(F.col("raw")), F.lit(False)).alias("strict"))


_ERRORS = [(1, "Response truncated at the length limit"), (2, "claim is not grounded"), (3, "card 1 assessment approach must be one of"), (4, "cards 1 and 2 are near duplicates"), (5, "unknown fields: x"), (6, "expected exactly 5 cards"), (7, "hint reveals the answer"), (8, "invalid JSON"), (9, None)]


def rejection_category(c: Column) -> Column:
    """The kind of an error message, by the first of its marks."""
    x = F.lower(F.coalesce(c, F.lit("")))
    has = lambda *marks: F.greatest(*[F.contains(x, F.lit(m)) for m in (*marks, marks[0])])
    return (
        F.when(has("truncated", "length limit"), "truncation").when(has("not grounded"), "grounding").when(has("assessment approach", "scenario analysis"), "assessment approach").when(has("duplicate"), "duplication")
        .when(has("unknown fields", "missing fields", "json", "expected exactly", "must be an object", "must be a json array"), "schema/structure").otherwise("other validation")
    )


@query("SELECT * FROM (VALUES ('truncation', 1), ('grounding', 1), ('assessment approach', 1), ('duplication', 1), ('schema/structure', 3), ('other validation', 2)) t(category, n)")
def agg7_rejections(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_ERRORS, "id int, error string").groupBy(rejection_category(F.col("error")).alias("category")).agg(F.count(F.lit(1)).cast("int").alias("n"))


#: Messages that go back to a model, and characters of each.
MOST_ERRORS, ERROR_CHARS = 8, 80


@query(rf"""WITH e AS (SELECT cluster, card_id, trim(regexp_replace(expalanation, '[\s\x{{a0}}]+', ' ', 'g')) AS m FROM cards WHERE expalanation IS NOT NULL),
s AS (SELECT cluster, card_id, CASE WHEN length(m) > {ERROR_CHARS} THEN rtrim(m[1:{ERROR_CHARS}]) || '...' ELSE m END AS m FROM e), f AS (SELECT cluster, m, min(card_id) AS first FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY first, m) AS k, count(*) OVER (PARTITION BY cluster) AS n FROM f) SELECT cluster, k AS pos, m AS message, greatest(n - {MOST_ERRORS}, 0) AS omitted FROM r WHERE k <= {MOST_ERRORS}""")
def win4_condensed_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of each cluster (here its explanations), shortened and each once in the order of their first card, a few of them, with the number left out."""
    m = _one_line(F.col("expalanation"))
    e = table(spark, d, "cards", "cluster", "card_id", "expalanation").where("expalanation IS NOT NULL").select("cluster", "card_id", F.when(F.length(m) > ERROR_CHARS, F.concat(F.rtrim(F.substring(m, 1, ERROR_CHARS)), F.lit("..."))).otherwise(m).alias("m"))
    f = e.groupBy("cluster", "m").agg(F.min("card_id").alias("first"))
    n = f.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    r = f.withColumn("pos", F.row_number().over(W.partitionBy("cluster").orderBy("first", "m"))).where(F.col("pos") <= MOST_ERRORS)
    return r.join(n, "cluster").select("cluster", F.col("pos").cast("bigint").alias("pos"), F.col("m").alias("message"), F.greatest(F.col("n") - MOST_ERRORS, F.lit(0)).alias("omitted"))


#: What each stage makes, in order; a stage that is done again makes all later artifacts stale.
STAGES = [("normalize", 0, "text"), ("graph", 1, "graph"), ("graph", 1, "checked_graph"), ("cards", 2, "cards"), ("cards", 3, "manifest")]


def stale_artifacts(redone: DataFrame) -> DataFrame:
    """(module, artifact): what is stale after stages (module, stage) were done again: all that later stages made from it."""
    made = redone.sparkSession.createDataFrame(STAGES, "stage string, rank int, artifact string")
    first = made.groupBy("stage").agg(F.min("rank").alias("from_rank"))
    return redone.join(F.broadcast(first), "stage").groupBy("module").agg(F.min("from_rank").alias("r")).join(F.broadcast(made), F.col("rank") > F.col("r")).select("module", "artifact").distinct()


@query("SELECT * FROM (VALUES ('a', 'graph'), ('a', 'checked_graph'), ('a', 'cards'), ('a', 'manifest'), ('b', 'cards'), ('b', 'manifest'), ('c', 'manifest')) t(module, artifact)")
def inc4_stale_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return stale_artifacts(spark.createDataFrame([("a", "normalize"), ("a", "cards"), ("b", "graph"), ("c", "cards")], "module string, stage string"))


@query("""SELECT m.course_code, m.module_number, CASE WHEN p.n IS NULL THEN 'no_pages' WHEN c.n IS NULL THEN 'no_cards' WHEN c.last < p.last THEN 'older_than_pages' END AS reason FROM modules m
LEFT JOIN (SELECT course_code, module_number, count(*) AS n, max(extracted_at) AS last FROM extracted_pages GROUP BY ALL) p USING (course_code, module_number) LEFT JOIN (SELECT course_code, module_number, count(*) AS n, max(generated_at) AS last FROM cards GROUP BY ALL) c USING (course_code, module_number)
WHERE p.n IS NULL OR c.n IS NULL OR c.last < p.last""")
def inc2_modules_to_do(spark: SparkSession, d: str) -> DataFrame:
    """Modules whose cards must be made, and why: nothing to make them from, none made, or pages extracted after all of them."""
    last = lambda t, at: table(spark, d, t, *M, at).groupBy(*M).agg(F.max(at).alias(at), F.count(F.lit(1)).alias(f"n_{t}"))
    j = table(spark, d, "modules", *M).join(last("extracted_pages", "extracted_at"), M, "left").join(last("cards", "generated_at"), M, "left")
    reason = F.when(F.col("n_extracted_pages").isNull(), "no_pages").when(F.col("n_cards").isNull(), "no_cards").when(F.col("generated_at") < F.col("extracted_at"), "older_than_pages")
    return j.select(*M, reason.alias("reason")).where("reason IS NOT NULL")
