"""Free-entered values mapped to a canonical list by a partition-based pigeonhole join, in built-in SQL functions only.

Reference strings are cut into k + 1 segments. A string within k edits of a reference string holds at least one of its segments
unchanged, shifted by at most k places. So reference segments and positional substrings of the entered values are joined on
equality, candidates are verified with the built-in levenshtein, and the values left over are found by anti-join.

Entered values are reduced to their distinct spellings before anything else (an aggregation that combines on the map side), so
the join runs on spellings and a value that a third of all rows share counts once. The reference list is what the caller gives;
nothing is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most edits, and the length up to which a reference form allows only one.
EDITS, SHORT = 2, 4
#: Words that may stand before or after a form without changing what it means.
LEADING, TRAILING = ("is", "are", "was", "were", "be", "been"), ("the", "a", "an")
UNMATCHED = "unmatched"


def _plain(c: Column) -> Column:
    """Camel case parted, lower case, everything but letters and digits as one blank."""
    parted = F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(parted), r"[^\p{L}\p{N}]+", " "))


def _edits(length: Column) -> Column:
    return F.when(length <= SHORT, 1).otherwise(EDITS)


def _other_word(v: Column, form: Column) -> Column:
    """Whether both edits of ``v`` took the form's beginning: its rest is whole, but nothing is left of its first two letters.

    Slips keep some of a word's beginning; where all of it is something else ("sings about" for "brings about"), another word was meant.
    """
    size = F.length(v) - F.length(form) + 2
    head = F.substring(v, F.lit(1), F.greatest(size, F.lit(0)))
    lost = F.length(F.array_join(F.array_intersect(F.split(head, ""), F.split(F.substring(form, 1, 2), "")), "")) == 0
    return size.between(0, 2) & F.endswith(v, F.substring(form, F.lit(3), F.length(form))) & lost


def reference_forms(reference: DataFrame, code: str, forms: list[Column]) -> DataFrame:
    """(code, form): each form of each entry as letters and digits only; blank and null forms are left out.

    A form that several codes share belongs to the smallest code.
    """
    each = reference.select(F.col(code).alias("code"), F.explode(F.concat(*forms)).alias("form")).select("code", F.replace(_plain(F.col("form")), F.lit(" "), F.lit("")).alias("form"))
    return each.where("form <> ''").groupBy("form").agg(F.min("code").alias("code"))


def _variants(plain: Column) -> Column:
    """The readings of an entry with the cost of each: as it is, said once instead of twice, without helper words."""
    bare = F.regexp_replace(F.regexp_replace(plain, f"^({'|'.join(LEADING)}) ", ""), f" ({'|'.join(TRAILING)})$", "")
    lead = F.regexp_replace(plain, f"^({'|'.join(LEADING)}) ", "")
    tail = F.regexp_replace(plain, f" ({'|'.join(TRAILING)})$", "")
    once = F.regexp_replace(plain, r"^(.+?) ?\1$", "$1")
    entry = lambda v, cost: F.struct(F.replace(v, F.lit(" "), F.lit("")).alias("v"), F.lit(cost).alias("cost"))
    return F.array_distinct(F.array(entry(plain, 0), entry(once, 1), entry(lead, 1), entry(tail, 1), entry(bare, 2)))


def matched_spellings(values: DataFrame, column: str, forms: DataFrame) -> DataFrame:
    """(plain, code, distance): the entry meant by each distinct spelling that means one."""
    entered = values.where(F.col(column).isNotNull()).select(_plain(F.col(column)).alias("plain")).distinct()
    read = entered.select("plain", F.explode(_variants(F.col("plain"))).alias("x")).select("plain", F.col("x.v").alias("v"), F.col("x.cost").alias("cost")).where("v <> ''")

    size = F.length("form")
    parts = _edits(size) + 1
    segment = lambda j: F.struct(
        j.alias("j"),
        size.alias("len"),
        F.substring("form", (F.floor(j * size / parts) + 1).cast("int"), (F.floor((j + 1) * size / parts) - F.floor(j * size / parts)).cast("int")).alias("s"),
    )
    segments = forms.select("code", "form", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), segment)).alias("g")).select("code", "form", "g.j", "g.len", "g.s")

    # the same segments as a value sees them: for each length within reach, each segment, each shift
    n = F.length("v")
    lens = F.transform(F.sequence(F.greatest(n - EDITS, F.lit(1)), n + EDITS), lambda x: x)
    spots = F.flatten(F.transform(lens, lambda ln: F.flatten(F.transform(F.sequence(F.lit(0), _edits(ln)), lambda j: F.transform(
        F.sequence(-_edits(ln), _edits(ln)),
        lambda d: F.struct(
            ln.alias("len"), j.alias("j"),
            (F.floor(j * ln / (_edits(ln) + 1)) + 1 + d).cast("int").alias("at"),
            (F.floor((j + 1) * ln / (_edits(ln) + 1)) - F.floor(j * ln / (_edits(ln) + 1))).cast("int").alias("size"),
        ),
    )))))
    probes = (
        read.select("plain", "v", "cost", F.explode(spots).alias("p"))
        .where("p.at >= 1 AND p.size >= 1 AND p.at + p.size - 1 <= length(v)")
        .select("plain", "v", "cost", "p.j", "p.len", F.expr("substring(v, p.at, p.size)").alias("s"))
        .distinct()
    )
    near = (
        probes.join(segments, ["len", "j", "s"])
        .select("plain", "v", "cost", "code", "form")
        .distinct()
        .withColumn("distance", F.levenshtein("v", "form"))
        .where(F.col("distance") <= _edits(F.length("form")))
    )
    judged = near.where(~((F.col("distance") >= 2) & _other_word(F.col("v"), F.col("form"))))
    best = F.min(F.struct((F.col("distance") + F.col("cost")).alias("total"), "distance", (-F.length("form")).alias("size"), "code"))  # at most a few candidates a spelling
    return judged.groupBy("plain").agg(best.alias("b")).select("plain", F.col("b.code").alias("code"), F.col("b.distance").alias("distance"))


def canonical_values(df: DataFrame, key: str, column: str, forms: DataFrame, code: str) -> DataFrame:
    """(key, code): the entry meant by each row's value, or 'unmatched', for rows whose value is neither null nor blank.

    Several entries as near give the one with the longest form, then the smallest code. Values of only punctuation, very long
    values and an empty reference list give 'unmatched'. Repeated rows each give their row; further columns are not read.
    """
    rows = df.select(F.col(key).alias(key), F.col(column).alias("value")).where(F.col("value").rlike(r"(?U)\S")).withColumn("plain", _plain(F.col("value")))
    known = matched_spellings(rows, "value", forms).select("plain", "code")
    hit = rows.join(known, "plain").select(key, F.col("code").alias(code))
    rest = rows.join(known, "plain", "left_anti").select(key, F.lit(UNMATCHED).alias(code))  # the unmatched, by anti-join
    return hit.unionByName(rest)


def unmatched_report(df: DataFrame, column: str, forms: DataFrame) -> DataFrame:
    """(value, n): the spellings that no entry of the list stands for, with their rows."""
    rows = df.select(F.col(column).alias("value")).where(F.col("value").rlike(r"(?U)\S")).withColumn("plain", _plain(F.col("value")))
    known = matched_spellings(rows, "value", forms).select("plain")
    return rows.join(known, "plain", "left_anti").groupBy(F.col("plain").alias("value")).agg(F.count(F.lit(1)).alias("n"))
