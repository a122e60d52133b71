"""Reading and writing of the pipeline's files: tagged text, graph JSON, recorded model answers and the two-block card file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH_SCHEMA = (
    "metadata map<string,string>, facts array<struct<id:string,statement:string,slides:array<int>,kind:string,topic:string>>, nodes array<struct<id:string,label:string,degree:int>>, "
    "edges array<struct<id:string,source:string,target:string,subject:string,relation:string,object:string,evidence:array<struct<chunk_id:string,slides:array<int>,text:string>>>>, _bad string"
)
#: Columns of the card file, in order; fixed, the misspelt one included.
CARD_COLUMNS = ["Type", "Question", "Correct Option", "Wrong Option 1", "Wrong Option 2", "Wrong Option 3", "is_true", "expalanation", "hint", "difficulty", "cluster", "course code", "module number"]
#: The fields of a card that hold text.
TEXT_COLUMNS = ("card_type", "question", "correct_option", "wrong_option_1", "wrong_option_2", "wrong_option_3", "expalanation", "hint")


def json_object(raw: Column) -> Column:
    """The JSON object of a model's answer as text: the answer, what its fence holds, or what stands from the first to the last brace."""
    bare = F.regexp_replace(F.trim(raw), r"(?is)^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    valid = lambda x: F.when(F.is_variant_null(F.try_parse_json(x)).isNotNull() & F.try_parse_json(x).isNotNull() & F.ltrim(x).startswith("{"), x)
    whole = F.when(F.try_parse_json(bare).isNotNull(), bare)
    # a whole answer that is JSON but no object is refused, not searched
    return F.when(whole.isNotNull(), valid(bare)).otherwise(valid(F.nullif(inner, F.lit(""))))


def is_strict_object(raw: Column) -> Column:
    """Whether an answer is one JSON object and nothing else."""
    x = F.trim(raw)
    return x.startswith("{") & x.endswith("}") & F.try_parse_json(x).isNotNull()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, digest): the SHA-256 of the bytes of each file under ``path``; each file is read whole by one task."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files without a byte-order mark."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """One row a graph file with an ``error`` where it is no object or lacks nodes or edges; such a row fails nothing else."""
    g = spark.read.schema(GRAPH_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    error = F.when(F.col("_bad").isNotNull(), "not a JSON object").when(F.col("nodes").isNull(), "nodes missing").when(F.col("edges").isNull(), "edges missing")
    return g.select(F.col("_metadata.file_path").alias("path"), "metadata", "facts", "nodes", "edges", error.alias("error"))


def replayed(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Model requests with their recorded answers (joined on request_key and attempt) and the JSON object in each answer."""
    return requests.join(recorded, ["request_key", "attempt"], "left").withColumn("body", json_object(F.col("raw")))


def card_lines(cards: DataFrame, block_rows: int = 50) -> DataFrame:
    """(course_code, module_number, line_no, line): the card file of each module, a label and a header before each block.

    Rows keep the order of cluster and card position. Lines are made from positions, not by writing on the driver.
    """
    from pyspark.sql import Window as W

    m = ["course_code", "module_number"]
    n = F.row_number().over(W.partitionBy(*m).orderBy("cluster", "card_pos", "card_id")) - 1
    quoted = lambda c: F.when(F.coalesce(c, F.lit("")).rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    fields = [F.col(c).cast("string") for c in ("card_type", "question", "correct_option", "wrong_option_1", "wrong_option_2", "wrong_option_3", "is_true", "expalanation", "hint", "difficulty", "cluster", "course_code", "module_number")]
    rows = cards.withColumn("_n", n).withColumn("_b", F.floor(F.col("_n") / block_rows))
    body = rows.select(*m, (F.col("_n") + (F.col("_b") + 1) * 2 + F.col("_b") + 1).alias("line_no"), F.concat_ws(",", *[quoted(c) for c in fields]).alias("line"))
    blocks = rows.groupBy(*m).agg(F.max("_b").alias("last")).select(*m, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("b"))
    at = F.col("b") * (block_rows + 3)
    heads = blocks.select(*m, F.explode(F.array(
        F.struct((at + 1).alias("line_no"), F.concat(F.lit("Module "), F.col("module_number"), F.lit("."), (F.col("b") + 1).cast("string")).alias("line")),
        F.struct((at + 2).alias("line_no"), F.lit(",".join(CARD_COLUMNS)).alias("line")),
        F.struct(F.when(F.col("b") > 0, at).alias("line_no"), F.lit("").alias("line")),
    )).alias("x")).select(*m, "x.line_no", "x.line").where("line_no IS NOT NULL")
    return heads.unionByName(body)


def read_card_lines(lines: DataFrame, block_rows: int = 50) -> DataFrame:
    """(course_code, module_number, block, card_no, f_...): the cards in the lines of card files, as text, an empty field as ''.

    A block begins with its label; the header and blank lines are no cards. Lines are read each by itself, so a field must not hold
    a line break.
    """
    from pyspark.sql import Window as W

    m = ["course_code", "module_number"]
    names = [c.lower().replace(" ", "_") for c in CARD_COLUMNS]
    names[0] = "card_type"
    label = F.col("line").rlike(r"^Module .*[.][0-9]+$")
    order = W.partitionBy(*m).orderBy("line_no")
    cards = lines.withColumn("block", F.sum(label.cast("int")).over(order)).where(~label & (F.col("line") != "") & (F.col("line") != ",".join(CARD_COLUMNS)))
    parsed = F.from_csv("line", ", ".join(f"f_{n} string" for n in names), {"quote": '"', "escape": '"', "nullValue": "\u0001", "emptyValue": "", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    rows = cards.select(*m, "block", F.row_number().over(order).cast("bigint").alias("card_no"), parsed.alias("c"))
    return rows.select(*m, "block", "card_no", *[F.coalesce(f"c.f_{n}", F.lit("")).alias(f"f_{n}") for n in names])
