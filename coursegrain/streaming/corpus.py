"""The course corpus kept up to date from a stream of cards: each question of a course once, with the batch that brought it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def question_keys(cards: DataFrame) -> DataFrame:
    """(course_code, stem, card_id): the question as letters, digits and single blanks; blank ones are left out."""
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.lower("question"), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return cards.select("course_code", stem.alias("stem"), "card_id").where("stem <> '' AND course_code IS NOT NULL")


#: Folders that the courses are spread over, so that a batch reads only those of its own courses.
BUCKETS = 64
SCHEMA = "course_code string, stem string, card_id bigint, bucket int, batch int"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("course_code"), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def keep_corpus(stream: DataFrame, corpus: str, checkpoint: str) -> StreamingQuery:
    """Appends the questions of each micro-batch that the corpus at ``corpus`` lacks; runs until the source is read up.

    A batch is written under its number, so a batch that is run again after a failure replaces its own rows. Of the corpus only the
    buckets of the batch's courses are read (BUCKETS at most are named). ``compact_corpus`` makes one batch of many.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = question_keys(batch).groupBy("course_code", "stem").agg(F.min("card_id").alias("card_id")).withColumn("bucket", _bucket())
        if _exists(spark, corpus):
            buckets = [r.bucket for r in new.select("bucket").distinct().collect()]
            old = spark.read.schema(SCHEMA).parquet(corpus).where(F.col("bucket").isin(buckets) & (F.col("batch") < number))
            new = new.join(old.select("course_code", "stem"), ["course_code", "stem"], "left_anti")
        new.withColumn("batch", F.lit(number)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(corpus)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_corpus(spark: SparkSession, corpus: str, target: str) -> None:
    """The corpus as few files under ``target``: all its rows as those of its last batch, so that later batches still come after."""
    rows = spark.read.schema(SCHEMA).parquet(corpus)
    last = rows.agg(F.max("batch")).first()[0]
    rows.withColumn("batch", F.lit(last)).repartition("bucket").write.partitionBy("bucket", "batch").parquet(target)
