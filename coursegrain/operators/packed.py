"""Several values packed in one field: one row a value, with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening quote and the character that ends it.
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "‘": "’"}
_MARKS = "".join(dict.fromkeys("".join(k + v for k, v in QUOTES.items())))
_UNQUOTED = r"[A-Za-z0-9#._\-]+"
#: Words that stand between values as delimiters do.
DELIMITER_WORDS = ("and",)


def unpack(field: Column) -> Column:
    """The values of a packed field, in order, as ARRAY<STRING>.

    The field is split on quote characters. A fold over the pieces knows which quote is open: a piece inside quotes is a
    literal (with a doubled quote standing for one), a piece outside is split on everything that can't be part of an unquoted
    value, and the delimiter word "and" is no value. Empty values are dropped. A quote that is never closed keeps its rest as
    one literal. Null gives null, a blank field an empty array.
    """
    pieces = F.regexp_extract_all(field, F.lit(f"([{_MARKS}]|[^{_MARKS}]+)"), 1)
    closing = F.create_map(*[F.lit(x) for pair in QUOTES.items() for x in pair])
    start = F.struct(
        F.lit("").alias("end"),  # the character that closes the open quote; "" outside
        F.lit("").alias("last"),  # the quote that the piece before closed, for doubled quotes
        F.lit("").alias("held"),
        F.array().cast("array<string>").alias("out"),
    )

    def loose(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(f"({_UNQUOTED})"), 1)
        return F.filter(found, lambda v: ~F.lower(v).isin(*DELIMITER_WORDS))

    def step(s: Column, x: Column) -> Column:
        inside, quote = s["end"] != "", F.length(x) == 1
        state = lambda end, last, held, out: F.struct(end.alias("end"), last.alias("last"), held.alias("held"), out.alias("out"))
        none = F.lit("")
        closed = F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["held"])))
        return (
            F.when(inside & (x == s["end"]), state(none, x, s["held"], s["out"]))  # maybe the first of a doubled quote
            .when(inside, state(s["end"], none, F.concat(s["held"], x), s["out"]))
            .when((s["last"] != "") & (x == s["last"]), state(x, none, F.concat(s["held"], x), s["out"]))
            .when(quote & closing[x].isNotNull(), state(closing[x], none, none, closed))
            .otherwise(state(none, none, none, F.concat(closed, loose(x))))
        )

    def finish(s: Column) -> Column:
        return F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["held"])))

    return F.aggregate(pieces, start, step, finish)


def packed_values(df: DataFrame, key: str, fields: list[str], least: int = 1) -> DataFrame:
    """One row (key, field, pos, item) for each value of the packed ``fields`` that hold ``least`` values or more.

    ``pos`` counts from 1 within the field. Null and blank fields give no row; a repeated row gives its values each time; other
    columns, whatever their names, are not read. It is a projection: no shuffle, whatever the skew of the keys.
    """
    arrays = df.select(
        F.col(key).alias(key),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), unpack(F.col(f).cast("string")).alias("items")) for f in fields])).alias("f"),
    )
    return arrays.where(F.size("f.items") >= least).select(
        key, F.col("f.field").alias("field"), F.posexplode("f.items").alias("p", "item")
    ).select(key, "field", (F.col("p") + 1).cast("bigint").alias("pos"), "item")
