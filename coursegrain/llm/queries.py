"""The pN_ queries of the llm problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursegrain.llm import canonical, encoding, leakage, near, oversized, pairs, residue, scans, survivor
from coursegrain.sources.tables import table

FACTS = ("course_code", "module_number", "fact_id", "fact_row", "statement", "method", "extracted_at", "slides")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivor_slides(table(spark, d, "facts", *FACTS))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return survivor.merged_records(table(spark, d, "facts", *FACTS, "kind", "topic"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "extracted_pages", "page_id", "text").select(F.lit("extracted_pages").alias("item_table"), F.col("page_id").alias("item_id"), F.lit(0).cast("bigint").alias("item_pos"), "text")
    slides = table(spark, d, "slides", "slide_id", "content").select(F.lit("slides").alias("item_table"), F.col("slide_id").alias("item_id"), F.posexplode("content").alias("item_pos", "text"))
    return pages.unionByName(slides.withColumn("item_pos", (F.col("item_pos") + 1).cast("bigint")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized.oversized_pieces(_items(spark, d)).where("piece_no = 1").select("item_table", "item_id", "item_pos")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return oversized.oversized_pieces(_items(spark, d))


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized text put together again from its pieces, and whether all of them keep the limit and the overlap."""
    return oversized.rejoined(oversized.oversized_pieces(_items(spark, d)))


NEAR_TABLES = ["facts", "cards"]


def _near_records(spark: SparkSession, d: str) -> DataFrame:
    facts = near.records(table(spark, d, "facts", "fact_row", "statement"), "facts", "fact_row", "statement")
    return facts.unionByName(near.records(table(spark, d, "cards", "card_id", "question"), "cards", "card_id", "question"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(_near_records(spark, d), NEAR_TABLES).withColumnRenamed("tab", "record_table")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(_near_records(spark, d), NEAR_TABLES).withColumnRenamed("tab", "record_table")


def _forms(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relation_list", "relation_code", "label", "also_written")
    return canonical.reference_forms(r, "relation_code", [F.array("label", "relation_code"), F.coalesce("also_written", F.array().cast("array<string>"))])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_values(table(spark, d, "triples", "triple_id", "relation"), "triple_id", "relation", _forms(spark, d), "relation_code")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched_report(table(spark, d, "triples", "relation"), "relation", _forms(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "cards", "card_id", "card_type", "question", "correct_option", "wrong_option_1", "wrong_option_2", "wrong_option_3", "expalanation", "hint"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noisy_lines(*_scanned(spark, d))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(*_scanned(spark, d))


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, d, "extracted_pages", "page_id", "course_code", "module_number", "number", "text")
    slides = table(spark, d, "slides", "slide_id", "course_code", "module_number", "number", "visual_text")
    return scans.page_lines(pages), scans.slide_lines(slides)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents", "doc_id", "text")).select("doc_id")


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents", "doc_id", "text"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encoded(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The texts that come back from their ids, with the number of tokens of each."""
    docs = table(spark, d, "documents", "doc_id", "text")
    back = encoding.decoded(encoding.encoded(docs, "doc_id", "text"), "doc_id", "ids")
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_pairs(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


P1_RULES = r"""
rows AS (
  SELECT course_code, module_number, lower(trim(fact_id)) AS fact_key, fact_row, extracted_at, slides, kind, topic,
         CASE method WHEN 'text' THEN 0 WHEN 'ocr' THEN 1 ELSE 2 END AS m, trim(regexp_replace(statement, '\s+', ' ', 'g')) AS s
  FROM facts WHERE lower(trim(fact_id)) <> ''
), ranked AS (
  SELECT *, count(*) OVER g AS n,
         row_number() OVER (g ORDER BY s IS NULL OR len(regexp_extract_all(s, '[\p{L}\p{N}]+')) < 3, m, length(s) DESC, extracted_at DESC, fact_row) AS k
  FROM rows WINDOW g AS (PARTITION BY course_code, module_number, fact_key)
), best AS (SELECT * FROM ranked WHERE n > 1 AND k = 1 AND len(regexp_extract_all(s, '[\p{L}\p{N}]+')) >= 3),
sl AS (SELECT DISTINCT course_code, module_number, fact_key, slide FROM (SELECT course_code, module_number, fact_key, unnest(slides) AS slide FROM rows) WHERE slide > 0)
"""
P1_SQL = f"WITH {P1_RULES} SELECT b.course_code, b.module_number, b.fact_key, b.fact_row, CAST(sl.slide AS BIGINT) AS slide FROM best b JOIN sl USING (course_code, module_number, fact_key)"
P1_RECORDS_SQL = f"""WITH {P1_RULES}, f AS (
  SELECT course_code, module_number, fact_key, count(*) AS n_rows,
         arg_max(trim(kind), (extracted_at, -fact_row)) FILTER (trim(kind) <> '') AS kind, arg_max(trim(topic), (extracted_at, -fact_row)) FILTER (trim(topic) <> '') AS topic
  FROM rows GROUP BY ALL
), c AS (SELECT course_code, module_number, fact_key, count(*) AS n_slides, min(slide) AS first_slide, max(slide) AS last_slide FROM sl GROUP BY ALL)
SELECT b.course_code, b.module_number, b.fact_key, b.fact_row, b.s AS statement, f.n_rows, f.kind, f.topic, coalesce(c.n_slides, 0) AS n_slides, c.first_slide, c.last_slide
FROM best b JOIN f USING (course_code, module_number, fact_key) LEFT JOIN c USING (course_code, module_number, fact_key)"""
P2_SQL = """
SELECT 'extracted_pages' AS item_table, page_id AS item_id, CAST(0 AS BIGINT) AS item_pos FROM extracted_pages WHERE length(text) > 1200
UNION ALL
SELECT 'slides', slide_id, CAST(p AS BIGINT) FROM (SELECT slide_id, unnest(content) AS t, unnest(generate_series(1, len(content))) AS p FROM slides) WHERE length(t) > 1200
"""
P2_REJOINED_SQL = """
SELECT 'extracted_pages' AS item_table, page_id AS item_id, CAST(0 AS BIGINT) AS item_pos, length(text) AS n_chars, md5(text) AS digest, true AS kept FROM extracted_pages WHERE length(text) > 1200
UNION ALL
SELECT 'slides', slide_id, CAST(p AS BIGINT), length(t), md5(t), true FROM (SELECT slide_id, unnest(content) AS t, unnest(generate_series(1, len(content))) AS p FROM slides) WHERE length(t) > 1200
"""
_P5_NEAR = r"""
forms AS (
  SELECT form, min(relation_code) AS code FROM (
    SELECT relation_code, regexp_replace(lower(regexp_replace(unnest(list_concat([label, relation_code], coalesce(also_written, []))), '(\p{Ll})(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+', '', 'g') AS form FROM relation_list)
  WHERE form <> '' GROUP BY form
), vals AS (
  SELECT triple_id, trim(regexp_replace(lower(regexp_replace(relation, '(\p{Ll})(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain FROM triples WHERE regexp_matches(relation, '[^\s\x{00a0}]')
), counted AS (SELECT DISTINCT plain, replace(plain, ' ', '') AS flat FROM vals),
variants AS (
  SELECT plain, flat AS v, 0 AS cost FROM counted
  UNION SELECT plain, flat[1:CAST(length(flat) / 2 AS INT)], 1 FROM counted WHERE length(flat) % 2 = 0 AND flat[1:CAST(length(flat) / 2 AS INT)] = flat[CAST(length(flat) / 2 AS INT) + 1:]
  UNION SELECT plain, replace(regexp_replace(plain, '^(is|are|was|were|be|been) ', ''), ' ', ''), 1 FROM counted
  UNION SELECT plain, replace(regexp_replace(plain, ' (the|a|an)$', ''), ' ', ''), 1 FROM counted
  UNION SELECT plain, replace(regexp_replace(regexp_replace(plain, '^(is|are|was|were|be|been) ', ''), ' (the|a|an)$', ''), ' ', ''), 2 FROM counted
), near AS (
  SELECT plain, v, cost, code, f.form, levenshtein(v, f.form) AS distance, length(v) - length(f.form) + 2 AS head
  FROM variants JOIN forms f ON v <> '' AND abs(length(v) - length(f.form)) <= 2 AND levenshtein(v, f.form) <= CASE WHEN length(f.form) <= 4 THEN 1 ELSE 2 END
), known AS (
  SELECT plain, code FROM near WHERE NOT (distance >= 2 AND head BETWEEN 0 AND 2 AND ends_with(v, form[3:]) AND translate(v[1:head], form[1:2], '') = v[1:head])
  QUALIFY row_number() OVER (PARTITION BY plain ORDER BY distance + cost, distance, length(form) DESC, code) = 1
)
"""
P5_SQL = f"WITH {_P5_NEAR} SELECT triple_id, coalesce(code, 'unmatched') AS relation_code FROM vals LEFT JOIN known USING (plain)"
P5_UNMATCHED_SQL = f"WITH {_P5_NEAR} SELECT plain AS value, count(*) AS n FROM vals ANTI JOIN known USING (plain) GROUP BY plain"

_P3_SETS = r"""
sets AS (
  SELECT record_table, id, list_sort(list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'))) AS w
  FROM (SELECT 'facts' AS record_table, fact_row AS id, statement AS t FROM facts UNION ALL SELECT 'cards', card_id, question FROM cards)
), rec AS (SELECT DISTINCT record_table, id, w, len(w) AS n FROM sets WHERE len(w) >= 6),
wide AS (SELECT record_table, id, n, unnest(w) AS v FROM rec),
pairs AS (
  SELECT a.record_table, a.id AS id_a, b.id AS id_b FROM wide a JOIN wide b ON a.record_table = b.record_table AND a.v = b.v AND a.id < b.id
  GROUP BY a.record_table, a.id, b.id, a.n, b.n HAVING count(*) >= 0.75 * (a.n + b.n - count(*))
)
"""
P3_SQL = f"WITH {_P3_SETS} SELECT record_table, id_a, id_b FROM pairs"
P3_GROUPS_SQL = f"""WITH {_P3_SETS}, cls AS (SELECT record_table, id, min(id) OVER (PARTITION BY record_table, w) AS class_id FROM rec),
ends AS (
  SELECT DISTINCT p.record_table, a.class_id AS c, b.class_id AS o FROM pairs p JOIN cls a ON a.record_table = p.record_table AND a.id = p.id_a JOIN cls b ON b.record_table = p.record_table AND b.id = p.id_b
  WHERE a.class_id <> b.class_id
), counted AS (SELECT record_table, c, count(*) AS links FROM (SELECT record_table, c, o FROM ends UNION SELECT record_table, o, c FROM ends) GROUP BY record_table, c)
SELECT cls.record_table, id, class_id, coalesce(links, 0) AS links FROM cls LEFT JOIN counted k ON k.record_table = cls.record_table AND k.c = cls.class_id"""
P8_ROUNDTRIP_SQL = "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents"
_P9_PLACES = r"""
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dp AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d WHERE len(w) >= 13),
ep AS (SELECT item_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM e WHERE len(w) >= 13),
places AS (
  SELECT DISTINCT doc_id, item_id, a.p FROM (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM dp) a
  JOIN (SELECT DISTINCT item_id, array_to_string(w[p:p + 12], ' ') AS g FROM ep) b USING (g)
)
"""
P9_SQL = f"WITH {_P9_PLACES} SELECT DISTINCT doc_id, item_id FROM places"
P9_SPANS_SQL = f"""WITH {_P9_PLACES}, marked AS (SELECT *, coalesce(p - lag(p) OVER w > 13, true) AS fresh FROM places WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY p)),
numbered AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, item_id ORDER BY p) AS g FROM marked)
SELECT doc_id, item_id, min(p) - 1 AS start_word, max(p) + 12 AS end_word FROM numbered GROUP BY doc_id, item_id, g"""

QUERIES = {
    "p1_found": p1_found, "p1_records": p1_records, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rejoined": p2_rejoined, "p5_found": p5_found, "p5_unmatched": p5_unmatched,
    "p6_found": p6_found, "p7_found": p7_found, "p7_repaired": p7_repaired, "p10_found": p10_found, "p10_residue": p10_residue,
    "p3_found": p3_found, "p3_groups": p3_groups, "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_found": p9_found, "p9_spans": p9_spans,
}
SQL = {"p1_found": P1_SQL, "p1_records": P1_RECORDS_SQL, "p2_found": P2_SQL, "p2_rejoined": P2_REJOINED_SQL, "p3_found": P3_SQL, "p3_groups": P3_GROUPS_SQL, "p5_found": P5_SQL, "p5_unmatched": P5_UNMATCHED_SQL, "p8_roundtrip": P8_ROUNDTRIP_SQL, "p9_found": P9_SQL, "p9_spans": P9_SPANS_SQL}
