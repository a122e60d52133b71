"""Queries of the knowledge graph: relations, entities and their aliases, nodes, edges, support, facts and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursegrain.functions import graph as G
from coursegrain.functions import lesson as L
from coursegrain.operators import relational as R
from coursegrain.operators.folding import folded_facts
from coursegrain.operators.packed import unpack
from coursegrain.plans import lesson
from coursegrain.plans.training import P4_SQL
from coursegrain.sources.tables import cut, table

M = ["course_code", "module_number"]
QUERIES, SQL = {}, {}
PLAN_FACTS = 50


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


@query(f"SELECT triple_id, {G.relation_sql('relation')} AS relation FROM triples")
def str15_relations(spark: SparkSession, d: str) -> DataFrame:
    """The graph's relation that each wording stands for; null where it stands for none."""
    return table(spark, d, "triples", "triple_id", "relation").select("triple_id", G.relation(F.col("relation")).alias("relation"))


@query(f"SELECT triple_id, {G.entity_key_sql('subject')} AS subject_key, {G.entity_key_sql('object')} AS object_key FROM triples")
def str18_entity_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triples", "triple_id", "subject", "object").select("triple_id", G.entity_key(F.col("subject")).alias("subject_key"), G.entity_key(F.col("object")).alias("object_key"))


def sanitized(triples: DataFrame) -> DataFrame:
    """Triples with trimmed ends and a relation of the graph; those with a blank end or another relation are dropped."""
    t = triples.withColumn("subject", F.trim("subject")).withColumn("object", F.trim("object")).withColumn("relation", G.relation(F.col("relation")))
    return t.where("subject <> '' AND object <> '' AND relation IS NOT NULL")


def entity_labels(triples: DataFrame, group: list[str]) -> DataFrame:
    """(group, value, label): the label of each written entity of a group, which is the longest of all that mean the same.

    Entities mean the same when they have one key, or when a law's identifier and its title are joined by a definition or by a text
    (``evidence``) that names an alias. Ties go to the later by name. Keys are few per value, so components run over keys only.
    """
    ends = triples.select(*group, F.explode(F.array("subject", "object")).alias("value")).distinct()
    keyed = ends.withColumn("key", G.entity_key(F.col("value")))
    s, o = F.col("subject"), F.col("object")
    named = (G.is_identifier(s) & G.is_title(o)) | (G.is_identifier(o) & G.is_title(s))
    cue = (F.col("relation") == "defines") | F.coalesce(F.col("evidence").rlike(G.ALIAS_CUE), F.lit(False))
    node = lambda k: F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group], k)
    links = triples.where(named & cue).select(node(G.entity_key(s)).alias("a"), node(G.entity_key(o)).alias("b"))
    of = R.components(links)
    both = keyed.withColumn("node", node(F.col("key"))).join(of, "node", "left").withColumn("root", F.coalesce("component", "node"))
    best = both.groupBy("root").agg(F.max(F.struct(F.length("value").alias("n"), F.lower("value").alias("low"), F.col("value").alias("value"))).alias("b"))
    return both.join(best, "root").select(*group, "value", F.col("b.value").alias("label"))


_SANE = f"""sane AS (SELECT triple_id, course_code, module_number, trim(subject) AS subject, {G.relation_sql('relation')} AS relation, trim(object) AS object, source_chunks, source_slides FROM triples WHERE trim(subject) <> '' AND trim(object) <> ''),
kept AS (SELECT * FROM sane WHERE relation IS NOT NULL),
ends AS (SELECT DISTINCT course_code, module_number, value, {G.entity_key_sql('value')} AS key FROM (SELECT course_code, module_number, subject AS value FROM kept UNION ALL SELECT course_code, module_number, object FROM kept)),
labels AS (SELECT course_code, module_number, value, key, last_value(value) OVER (PARTITION BY course_code, module_number, key ORDER BY length(value), lower(value), value ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS label FROM ends)"""


@query(f"WITH {_SANE} SELECT course_code, module_number, value, label FROM labels")
def grf1_entity_labels(spark: SparkSession, d: str) -> DataFrame:
    """The tables name no laws, so the SQL has equal keys only; the aliases of laws are in ``grf1_law_aliases``."""
    t = sanitized(table(spark, d, "triples", *M, "subject", "relation", "object")).withColumn("evidence", F.lit(None).cast("string"))
    return entity_labels(t, M)


_LAWS = [
    ("a", "RA 1425", "defines", "Rizal Act", None), ("a", "Republic Act 1425", "created_by", "the senator", "the law"), ("a", "the senator", "part_of", "the senate", None),
    ("b", "EO 12", "part_of", "Harbor Order", "Harbor Order (EO 12) was signed"), ("b", "Harbor Order", "is_a", "rule", None), ("c", "EO 12", "part_of", "Harbor Order", "signed later"), ("c", "pump", "is_a", "Pump", None),
    ("d", "9262", "defines", "Safety Law", None), ("d", "Safety Law", "mandates", "a fence", None),
]
_LAW_LABELS = [
    ("a", "RA 1425", "Republic Act 1425"), ("a", "Republic Act 1425", "Republic Act 1425"), ("a", "Rizal Act", "Republic Act 1425"), ("a", "the senator", "the senator"), ("a", "the senate", "the senate"),
    ("b", "EO 12", "Harbor Order"), ("b", "Harbor Order", "Harbor Order"), ("b", "rule", "rule"), ("c", "EO 12", "EO 12"), ("c", "Harbor Order", "Harbor Order"), ("c", "pump", "pump"), ("c", "Pump", "pump"),
    ("d", "9262", "Safety Law"), ("d", "Safety Law", "Safety Law"), ("d", "a fence", "a fence"),
]


@query(f"SELECT module, value, label FROM {_values(_LAW_LABELS, 'module, value, label')}")
def grf1_law_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Literal laws with identifiers and titles, joined by a definition or by an alias cue; only within a module."""
    t = _literal(spark, _LAWS, "module string, subject string, relation string, object string, evidence string")
    return entity_labels(t, ["module"])


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """One row for each labelled edge of a module: its first triple and how many there are."""
    t = sanitized(table(spark, d, "triples", "triple_id", *M, "subject", "relation", "object"))
    labels = entity_labels(t.withColumn("evidence", F.lit(None).cast("string")), M)
    named = lambda x: labels.select(*M, F.col("value").alias(x), F.col("label").alias(f"{x}_label"))
    full = t.join(named("subject"), [*M, "subject"]).join(named("object"), [*M, "object"])
    key = lambda x: G.entity_key(F.col(x)).alias(x.replace("_label", "_key"))
    edges = full.select(*M, "triple_id", "relation", "subject_label", "object_label", key("subject_label"), key("object_label")).groupBy(*M, "subject_key", "relation", "object_key").agg(
        F.min("triple_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"), F.min("subject_label").alias("subject"), F.min("object_label").alias("object")
    )
    return cut(edges)  # nodes, edges and facts are made from them


_EDGES = f"""{_SANE}, named AS (SELECT k.*, a.label AS s, b.label AS o FROM kept k JOIN labels a ON a.course_code = k.course_code AND a.module_number = k.module_number AND a.value = k.subject JOIN labels b ON b.course_code = k.course_code AND b.module_number = k.module_number AND b.value = k.object),
edges AS (SELECT course_code, module_number, {G.entity_key_sql('s')} AS subject_key, relation, {G.entity_key_sql('o')} AS object_key, min(triple_id) AS first_id, count(*) AS n_rows, min(s) AS subject, min(o) AS object FROM named GROUP BY ALL),
deg AS (SELECT course_code, module_number, key, min(label) AS label, count(*) AS degree FROM (SELECT course_code, module_number, subject_key AS key, subject AS label FROM edges UNION ALL SELECT course_code, module_number, object_key, object FROM edges) GROUP BY course_code, module_number, key),
nodes AS (SELECT *, 'n' || row_number() OVER (PARTITION BY course_code, module_number ORDER BY degree DESC, lower(label), label) AS node_id FROM deg)"""


def _nodes(edges: DataFrame) -> DataFrame:
    ends = edges.select(*M, F.explode(F.array(F.struct(F.col("subject_key").alias("key"), F.col("subject").alias("label")), F.struct(F.col("object_key").alias("key"), F.col("object").alias("label")))).alias("e")).select(*M, "e.*")
    g = ends.groupBy(*M, "key").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("degree"))
    order = W.partitionBy(*M).orderBy(F.desc("degree"), F.lower("label"), "label")
    return g.withColumn("node_id", F.concat(F.lit("n"), F.row_number().over(order)))


@query(f"WITH {_EDGES} SELECT course_code, module_number, node_id, label, degree FROM nodes")
def grf2_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each module's graph, numbered by falling degree and then by label."""
    return _nodes(_edges(spark, d)).select(*M, "node_id", "label", "degree")


@query(f"""WITH {_EDGES} SELECT e.course_code, e.module_number, 'e' || row_number() OVER (PARTITION BY e.course_code, e.module_number ORDER BY first_id) AS edge_id, a.node_id AS source, b.node_id AS target, e.subject, e.relation, e.object, n_rows
FROM edges e JOIN nodes a ON a.course_code = e.course_code AND a.module_number = e.module_number AND a.key = subject_key JOIN nodes b ON b.course_code = e.course_code AND b.module_number = e.module_number AND b.key = object_key""")
def grf3_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges in the order of their first triple, with the nodes at their ends."""
    e = _edges(spark, d)
    n = _nodes(e)
    end = lambda key, name: n.select(*M, F.col("key").alias(key), F.col("node_id").alias(name))
    both = e.join(end("subject_key", "source"), [*M, "subject_key"]).join(end("object_key", "target"), [*M, "object_key"])
    number = F.row_number().over(W.partitionBy(*M).orderBy("first_id"))
    return both.select(*M, F.concat(F.lit("e"), number).alias("edge_id"), "source", "target", "subject", "relation", "object", "n_rows")


_UNPACKED = P4_SQL[: P4_SQL.rindex("SELECT triple_id, field, CAST")].replace("WITH f AS", ", f AS", 1).strip()
_UNPACKED = _UNPACKED[_UNPACKED.index("f AS") :]


@query(f"""WITH {_UNPACKED}, n AS (SELECT triple_id, course_code, module_number, {G.canonical_sql('subject')} AS subject, {G.relation_sql('relation')} AS relation, {G.canonical_sql('object')} AS object FROM triples WHERE trim(subject) <> '' AND trim(object) <> ''),
i AS (SELECT n.course_code, n.module_number, n.subject, n.relation, n.object, t.field, unnest(t.items) AS item FROM n JOIN t USING (triple_id) WHERE n.relation IS NOT NULL),
c AS (SELECT course_code, module_number, subject, relation, object, array_to_string(list_sort(list(DISTINCT item) FILTER (field = 'source_chunks')), ';') AS source_chunks, array_to_string(list_transform(list_sort(list_distinct(list(try_cast(item AS INT)) FILTER (field = 'source_slides' AND regexp_full_match(item, '[0-9]{{1,9}}') AND try_cast(item AS INT) > 0))), lambda x: CAST(x AS VARCHAR)), ';') AS source_slides,
 count(DISTINCT item) FILTER (field = 'source_chunks') AS evidence_count FROM i GROUP BY ALL)
SELECT course_code, module_number, subject, relation, object, coalesce(source_chunks, '') AS source_chunks, coalesce(source_slides, '') AS source_slides, evidence_count FROM c""")
def snk2_triple_file(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the triple file: each edge with its distinct chunk labels and slide numbers and the number of its chunks.

    Labels are made distinct before they are collected, so a hot edge sends each of its labels once.
    """
    t = sanitized(table(spark, d, "triples", "triple_id", *M, "subject", "relation", "object", "source_chunks", "source_slides"))
    e = t.select(*M, G.canonical(F.col("subject")).alias("subject"), "relation", G.canonical(F.col("object")).alias("object"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), unpack(F.col(f)).alias("items")) for f in ("source_chunks", "source_slides")])).alias("x"))
    number = F.when(F.col("item").rlike("^[0-9]{1,9}$"), F.col("item").cast("int"))
    i = e.select(*M, "subject", "relation", "object", F.col("x.field").alias("field"), F.explode("x.items").alias("item"))
    i = i.select(*M, "subject", "relation", "object", F.when(F.col("field") == "source_chunks", F.col("item")).alias("chunk"), F.when(F.col("field") == "source_slides", number).alias("slide")).distinct()
    g = i.groupBy(*M, "subject", "relation", "object").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"), F.array_sort(F.collect_list(F.when(F.col("slide") > 0, F.col("slide")))).alias("slides"))
    return g.select(*M, "subject", "relation", "object", F.array_join("chunks", ";").alias("source_chunks"), F.array_join("slides", ";").alias("source_slides"), F.size("chunks").cast("bigint").alias("evidence_count"))


_SUPPORT = [
    (1, "pump", "is_a", "machine", "A pump is a machine."), (2, "machine", "is_a", "pump", "A pump is a machine."), (3, "pum", "is_a", "machine", "A pump is a machine."), (4, "law", "enacted_on", "1956", "The law of 1956"),
    (5, "law", "enacted_on", "June", "The law of June"), (6, "senator", "created_by", "the law", "The senator wrote the law"), (7, "RA 1425", "created_by", "the law", "RA-1425 is the law"), (8, "", "is_a", "machine", "machine"), (9, "valve", "part_of", "Pump", None),
]


@query(f"SELECT id, {G.supports_sql('subject', 'relation', 'object', 'text')} AS supported FROM {_values(_SUPPORT, 'id, subject, relation, object, text')}")
def flt7_support_rules(spark: SparkSession, d: str) -> DataFrame:
    t = _literal(spark, _SUPPORT, "id int, subject string, relation string, object string, text string")
    return t.select("id", G.supports(F.col("subject"), F.col("relation"), F.col("object"), F.col("text")).alias("supported"))


_MARKED = "<triplet>[^<]*<subj>[^<]*<obj>[^<]*"


@query(rf"""WITH m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_MARKED}')) AS m, generate_subscripts(regexp_extract_all(text, '{_MARKED}'), 1) AS pos FROM documents WHERE contains(text, '<triplet>')),
t AS (SELECT doc_id, pos, text, trim(regexp_extract(m, '<triplet>([^<]*)<subj>([^<]*)<obj>([^<]*)', 1)) AS subject, trim(regexp_extract(m, '<triplet>([^<]*)<subj>([^<]*)<obj>([^<]*)', 2)) AS object, trim(regexp_extract(m, '<triplet>([^<]*)<subj>([^<]*)<obj>([^<]*)', 3)) AS rel FROM m)
SELECT doc_id, pos, subject, relation, object FROM (SELECT *, {G.relation_sql('rel')} AS relation FROM t) WHERE relation IS NOT NULL AND {G.supports_sql('subject', 'relation', 'object', 'text')}""")
def flt7_supported_triplets(spark: SparkSession, d: str) -> DataFrame:
    """Marked triplets of a document whose relation is one of the graph's and that the document supports."""
    docs = table(spark, d, "documents", "doc_id", "text").where("contains(text, '<triplet>')")
    e = docs.select("doc_id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(f"({_MARKED})"), 1)).alias("p", "m"))
    part = lambda k: F.trim(F.regexp_extract("m", "<triplet>([^<]*)<subj>([^<]*)<obj>([^<]*)", k))
    t = e.select("doc_id", "text", (F.col("p") + 1).cast("bigint").alias("pos"), part(1).alias("subject"), G.relation(part(3)).alias("relation"), part(2).alias("object")).where("relation IS NOT NULL")
    return t.where(G.supports(F.col("subject"), F.col("relation"), F.col("object"), F.col("text"))).select("doc_id", "pos", "subject", "relation", "object")


_KEPT_FACTS = f"SELECT f.fact_row, f.course_code, f.module_number, k.statement, f.topic, f.kind, f.slides FROM facts f JOIN ({lesson.SQL['flt1_lesson_facts']}) k USING (fact_row) WHERE k.reason IS NULL"


def _kept_facts(spark: SparkSession, d: str) -> DataFrame:
    return L.kept_facts(table(spark, d, "facts", "fact_row", *M, "statement", "topic", "kind", "slides"))


@query(f"""WITH {_EDGES}, k AS ({_KEPT_FACTS}), u AS (SELECT course_code, module_number, {G.canonical_sql('statement')} AS statement, 0 AS side, fact_row AS id FROM k
 UNION ALL SELECT course_code, module_number, {G.canonical_sql("subject || ' | ' || relation || ' | ' || object")}, 1, first_id FROM edges)
SELECT course_code, module_number, statement, CASE min(side) WHEN 0 THEN 'fact' ELSE 'relationship' END AS kind, min(id) FILTER (side = 0) AS fact_row FROM u GROUP BY course_code, module_number, statement""")
def grf5_graph_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts that cards are written from: lesson facts and edges as statements, equal ones once, a lesson fact before an edge."""
    f = _kept_facts(spark, d).select(*M, G.canonical(F.col("statement")).alias("statement"), F.lit(0).alias("side"), F.col("fact_row").alias("id"))
    e = _edges(spark, d).select(*M, G.canonical(F.concat_ws(" | ", "subject", "relation", "object")).alias("statement"), F.lit(1).alias("side"), F.col("first_id").alias("id"))
    g = f.unionByName(e).groupBy(*M, "statement").agg(F.min("side").alias("side"), F.min(F.when(F.col("side") == 0, F.col("id"))).alias("fact_row"))
    return g.select(*M, "statement", F.when(F.col("side") == 0, "fact").otherwise("relationship").alias("kind"), "fact_row")


_ASKS = r"regexp_matches(rtrim(coalesce(statement, '')), '[?？]$')"


@query(f"""WITH {_EDGES}, f AS (SELECT course_code, module_number, count(*) AS facts, count(*) FILTER ({_ASKS}) AS removed_facts FROM facts GROUP BY ALL), e AS (SELECT course_code, module_number, count(*) AS edges FROM edges GROUP BY ALL), n AS (SELECT course_code, module_number, count(*) AS nodes FROM nodes GROUP BY ALL)
SELECT course_code, module_number, coalesce(facts, 0) - coalesce(removed_facts, 0) AS facts, coalesce(removed_facts, 0) AS removed_facts, coalesce(edges, 0) AS edges, coalesce(nodes, 0) AS nodes FROM f FULL JOIN e USING (course_code, module_number) FULL JOIN n USING (course_code, module_number)""")
def agg12_checked_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a checked graph: facts without open questions, the questions removed, edges, and the nodes that edges still name."""
    f = table(spark, d, "facts", *M, "statement").groupBy(*M).agg(F.count(F.lit(1)).alias("f"), F.count(F.when(F.rtrim(F.coalesce("statement", F.lit(""))).rlike("[?？]$"), 1)).alias("q"))
    e = _edges(spark, d)
    edges, nodes = e.groupBy(*M).agg(F.count(F.lit(1)).alias("e")), e.select(*M, F.explode(F.array("subject_key", "object_key")).alias("k")).distinct().groupBy(*M).agg(F.count(F.lit(1)).alias("n"))
    all_ = f.join(edges, M, "full").join(nodes, M, "full").na.fill(0, ["f", "q", "e", "n"])
    return all_.select(*M, (F.col("f") - F.col("q")).alias("facts"), F.col("q").alias("removed_facts"), F.col("e").alias("edges"), F.col("n").alias("nodes"))


_CHECK = [("fact", 1, "Water is wet.", None, None), ("fact", 2, "What is water?", None, None), ("edge", 1, None, "n1", "n2"), ("edge", 2, None, "n3", "n1"), ("node", 1, None, "n1", None), ("node", 2, None, "n2", None), ("node", 3, None, "n3", None)]
_REMOVED = [("edge", 2)]


@query("SELECT * FROM (VALUES ('edge', 1), ('fact', 1), ('node', 2)) t(item, left_over)")
def grf6_checked_graph(spark: SparkSession, d: str) -> DataFrame:
    """A literal graph after a check that removes one edge: open questions go too, and nodes that no edge names."""
    items = _literal(spark, _CHECK, "item string, id int, statement string, source string, target string")
    left = checked_items(items, _literal(spark, _REMOVED, "item string, id int"))
    return left.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("left_over"))


def checked_items(items: DataFrame, removed: DataFrame) -> DataFrame:
    """Items of a graph (fact, edge, node) that stay: not removed by the check, no open question, no node without an edge."""
    asks = F.coalesce(F.rtrim("statement").rlike("[?？]$"), F.lit(False))
    kept = items.join(removed, ["item", "id"], "left_anti").where((F.col("item") != "fact") | ~asks)
    used = kept.where("item = 'edge'").select(F.explode(F.array("source", "target")).alias("source")).where("source IS NOT NULL").distinct().withColumn("item", F.lit("node"))
    return kept.where("item <> 'node'").unionByName(kept.where("item = 'node'").join(used, ["item", "source"], "left_semi").select(*kept.columns))


@query()
def join9_fact_fold(spark: SparkSession, d: str) -> DataFrame:
    """The facts of each module after folding reworded ones (longest matching blocks have no SQL; tested against a plain fold)."""
    f = folded_facts(_kept_facts(spark, d).select("fact_row", *M, "statement", "slides"), M, "fact_row")
    return f.select(*M, "fact_row", "statement", F.array_join("slides", ";").alias("slides"), "n_rows")


_BUCKET = "CASE WHEN len(slides) > 0 AND slides[1] IS NOT NULL THEN 's' || slides[1] WHEN topic <> '' THEN 't' || lower(topic) ELSE 'g' END"


@query(f"""WITH {_EDGES}, p AS (SELECT course_code, module_number, 0 AS side, fact_row AS id, {_BUCKET} AS bucket FROM ({_KEPT_FACTS}) UNION ALL SELECT course_code, module_number, 1, first_id, 't' || lower(subject) FROM edges),
c AS (SELECT course_code, module_number, count(*) FILTER (side = 0) AS f, count(*) FILTER (side = 1) AS e FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY course_code, module_number, side, bucket ORDER BY id) AS turn, min(id) OVER (PARTITION BY course_code, module_number, side, bucket) AS first FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY course_code, module_number, side ORDER BY turn, first) AS pick FROM r),
l AS (SELECT k.*, CASE WHEN side = 1 THEN least(e, greatest({PLAN_FACTS // 2}, {PLAN_FACTS} - f)) ELSE least(f, {PLAN_FACTS} - least(e, greatest({PLAN_FACTS // 2}, {PLAN_FACTS} - f))) END AS most FROM k JOIN c USING (course_code, module_number))
SELECT course_code, module_number, CASE side WHEN 0 THEN 'fact' ELSE 'relationship' END AS kind, id, pick FROM l WHERE pick <= most""")
def win2_plan_facts(spark: SparkSession, d: str) -> DataFrame:
    """At most 50 facts a module for planning: up to half of them relationships, each side in turns over slides or topics."""
    first = F.get("slides", F.lit(0))
    bucket = F.when(first.isNotNull(), F.concat(F.lit("s"), first)).when(F.col("topic") != "", F.concat(F.lit("t"), F.lower("topic"))).otherwise("g")
    f = _kept_facts(spark, d).select(*M, F.lit(0).alias("side"), F.col("fact_row").alias("id"), bucket.alias("bucket"))
    e = _edges(spark, d).select(*M, F.lit(1).alias("side"), F.col("first_id").alias("id"), F.concat(F.lit("t"), F.lower("subject")).alias("bucket"))
    p = f.unionByName(e)
    n = p.groupBy(*M).agg(F.count(F.when(F.col("side") == 0, 1)).alias("f"), F.count(F.when(F.col("side") == 1, 1)).alias("e"))
    edges = F.least("e", F.greatest(F.lit(PLAN_FACTS // 2), F.lit(PLAN_FACTS) - F.col("f")))
    picked = R.coverage_sample(p, [*M, "side"], "bucket", "id", PLAN_FACTS).join(n, M)
    most = F.when(F.col("side") == 1, edges).otherwise(F.least("f", PLAN_FACTS - edges))
    return picked.where(F.col("pick") <= most).select(*M, F.when(F.col("side") == 0, "fact").otherwise("relationship").alias("kind"), "id", F.col("pick").cast("bigint").alias("pick"))
