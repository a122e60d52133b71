"""Compatibility forms and full case folding, which the JVM side has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _folded(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def folded(c: Column) -> Column:
    """NFKC and case folding. ASCII texts, for which that is lower case, stay in the JVM; only the others reach Python, in batches."""
    other = c.rlike(r"[^\x00-\x7f]")
    return F.when(other, _folded(F.when(other, c))).otherwise(F.lower(c))


def folded_sql(x: str) -> str:
    """The same for an engine without compatibility forms, for the characters that the tables hold."""
    for wide, plain in (("…", "'...'"), ("\xa0", "' '"), ("ﬁ", "'fi'"), ("ﬂ", "'fl'"), ("ß", "'ss'")):
        x = f"replace({x}, '{wide}', {plain})"
    return f"lower({x})"
