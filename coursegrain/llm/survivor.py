"""Best representative of each group of duplicate records, with currency reasoning where timestamps are missing.

Values have *classes*, of which there is a bounded number whatever the data: the way a statement was obtained and the shape it has
(method and form), and the kind itself where a share of KIND_SHARE of the rows has it. From rows with a timestamp we learn how often,
within one group, values of class a come before all values of class b; the majority directions, taken by falling margin and never
closing a cycle, are the precedence of classes. A row without a timestamp is then placed after everything in its group that must
come before its class: its effective time is the latest time of the preceding classes, and what is placed at a time comes after what
is known to be of it; of several placed at one time the topologically latest class comes last.

Everything over rows is an aggregation that combines on the map side, so a group with a third of all rows leaves at most one
record a class for each map task; no task or driver ever holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrain.functions.text import squeezed, words

#: Trust in a method, best first; anything else and null come last.
METHODS = ("text", "ocr")
FORMS = ("missing", "cut", "bulleted", "capitals", "unended", "plain")
MIN_WORDS = 3
#: A kind is a class of its own when this share of the rows has it; the others are one class.
KIND_SHARE = 0.01


def _method_rank(c: Column) -> Column:
    out = F.lit(len(METHODS))
    for k, m in reversed(list(enumerate(METHODS))):
        out = F.when(c == m, F.lit(k)).otherwise(out)
    return out


def _form(text: Column) -> Column:
    letters = F.regexp_replace(text, r"[^\p{L}]+", "")
    return (
        F.when(text.isNull() | (F.size(words(text)) < MIN_WORDS), F.lit(0))
        .when(text.rlike(r"(\.\.\.|…|\[\.\.\.\])$"), F.lit(1))
        .when(text.rlike(r"^[-*•]"), F.lit(2))
        .when((F.length(letters) > 8) & (letters == F.upper(letters)) & (letters != F.lower(letters)), F.lit(3))
        .when(~text.rlike(r"[.!?。！？][\"”»')\]]*$"), F.lit(4))
        .otherwise(F.lit(5))
    )


def classified(facts: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """The rows with their group key, squeezed statement, value class ``cls`` (method rank * 6 + form) and the columns ``kept``."""
    text = squeezed("statement")
    base = facts.select(
        "course_code",
        "module_number",
        F.lower(F.trim(F.regexp_replace("fact_id", r"(?U)^\s+|\s+$", ""))).alias("fact_key"),
        "fact_row",
        text.alias("text"),
        _method_rank(F.col("method")).alias("m"),
        F.col("extracted_at").cast("timestamp").alias("extracted_at"),
        "slides",
        *(kept or []),
    ).where("course_code IS NOT NULL AND module_number IS NOT NULL AND fact_key <> ''")
    return base.withColumn("cls", F.col("m") * len(FORMS) + _form(F.col("text")))


KEY = ["course_code", "module_number", "fact_key"]


def _by_class(rows: DataFrame) -> DataFrame:
    """One record for each group and class: its times and its best rows with and without a timestamp."""
    good = F.col("cls") % len(FORMS) != 0
    at = F.unix_micros("extracted_at")
    return rows.groupBy(*KEY, "cls").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(at).alias("first"),
        F.max(at).alias("last"),
        F.min(F.when(good & at.isNotNull(), F.struct((-F.length("text")).alias("c"), (-at).alias("t"), F.col("fact_row").alias("r")))).alias("timed"),
        F.min(F.when(good & at.isNull(), F.struct((-F.length("text")).alias("c"), F.lit(0).cast("bigint").alias("t"), F.col("fact_row").alias("r")))).alias("untimed"),
    )


def transitions(rows: DataFrame) -> DataFrame:
    """(before, after, n): the groups in which every timed value of class before is older than every one of class after.

    At most (number of classes) squared rows; null timestamps take no part; an empty table gives none.
    """
    spans = rows.where("extracted_at IS NOT NULL").groupBy(*KEY, "cls").agg(F.min("extracted_at").alias("first"), F.max("extracted_at").alias("last"))
    one = spans.groupBy(*KEY).agg(F.collect_list(F.struct("cls", "first", "last")).alias("s")).where(F.size("s") > 1)  # at most one entry a class
    pairs = one.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a.last < b.first")
    return pairs.groupBy(F.col("a.cls").alias("before"), F.col("b.cls").alias("after")).agg(F.count(F.lit(1)).alias("n"))


def precedence(counted: list[tuple[int, int, int]]) -> tuple[dict[int, set[int]], dict[int, int]]:
    """All classes before each class (closed under transitivity), and each class's topological level.

    ``counted`` holds (before, after, n). The majority direction of each pair is taken, widest margin first (ties by class
    number), unless it would close a cycle; equal counts give no edge.
    """
    n = {(a, b): k for a, b, k in counted}
    edges = sorted(((n[a, b] - n.get((b, a), 0), a, b) for a, b in n if n[a, b] > n.get((b, a), 0)), key=lambda e: (-e[0], e[1], e[2]))
    nodes = {x for a, b in n for x in (a, b)}
    before: dict[int, set[int]] = {x: set() for x in nodes}
    direct: dict[int, set[int]] = {x: set() for x in nodes}
    for _, a, b in edges:
        if b in before[a]:
            continue
        direct[b].add(a)
        added = before[a] | {a}
        for x in nodes:
            if x == b or b in before[x]:
                before[x] |= added
    level: dict[int, int] = {}
    for x in sorted(nodes, key=lambda x: len(before[x])):
        level[x] = 1 + max((level[y] for y in direct[x]), default=-1)
    return before, level


class Currency:
    """The precedence of the classes in a column, as expressions over them."""

    def __init__(self, rows: DataFrame, classes: int):
        before, level = precedence([(r["before"], r["after"], r["n"]) for r in transitions(rows).collect()])  # at most classes squared
        self._earlier = F.array(*[F.array(*[F.lit(y) for y in sorted(before.get(x, ()))]).cast("array<int>") for x in range(classes)])
        self._levels = F.array(*[F.lit(level.get(x, 0)) for x in range(classes)])

    def placed(self, cls: Column, classes: Column) -> Column:
        """The latest time of the classes of the group that come before ``cls``; null where there is none with a time."""
        earlier = F.element_at(self._earlier, cls + 1)
        return F.array_max(F.transform(F.filter(classes, lambda o: F.array_contains(earlier, o["cls"])), lambda o: o["last"]))

    def level(self, cls: Column) -> Column:
        return F.element_at(self._levels, cls + 1)


def _chosen(rows: DataFrame, currency: Currency) -> DataFrame:
    """KEY, n (rows) and best: method, size, time, level and number of the best statement, null where the group has none."""
    grouped = _by_class(rows).groupBy(*KEY).agg(F.sum("n").alias("n"), F.collect_list(F.struct("cls", "last", "timed", "untimed")).alias("s"))

    def pick(e: Column) -> Column:
        cls, m = e["cls"], F.floor(e["cls"] / len(FORMS)).cast("int")
        entry = lambda x, t, level: F.struct(m.alias("m"), x["c"].alias("c"), t.alias("t"), (-level).alias("l"), x["r"].alias("r"))
        late = F.coalesce(-currency.placed(cls, F.col("s")), F.lit(2**62))
        # levels start at 0: what is placed comes after what is known to be of that time
        return F.array(
            F.when(e["timed"].isNotNull(), entry(e["timed"], e["timed"]["t"], F.lit(0))), F.when(e["untimed"].isNotNull(), entry(e["untimed"], late, currency.level(cls) + 1))
        )

    return grouped.select(*KEY, "n", F.array_min(F.array_compact(F.flatten(F.transform("s", pick)))).alias("best"))


def _statement_currency(rows: DataFrame) -> Currency:
    return Currency(rows, len(FORMS) * (len(METHODS) + 1))


def _of_groups(chosen: DataFrame) -> DataFrame:
    return chosen.where("n > 1 AND best IS NOT NULL").select(*KEY, F.col("best.r").alias("fact_row"))


def survivors(facts: DataFrame) -> DataFrame:
    """One row for each group of two or more rows that has a usable statement: KEY and ``fact_row`` of the survivor.

    Order of choice: method (text, ocr, others), most characters, latest effective time, topologically latest class, smallest
    ``fact_row``. Statements of fewer than three words are missing. Rows with a null module or a null or blank fact_id belong to
    no group. Repeated rows tie and the smallest number wins. Very long statements count with all their characters.
    """
    rows = classified(facts)
    return _of_groups(_chosen(rows, _statement_currency(rows)))


def survivor_slides(facts: DataFrame) -> DataFrame:
    """One row for each survivor and each distinct positive slide number of its group; null lists and members are skipped."""
    slides = classified(facts).select(*KEY, F.explode("slides").alias("slide")).where("slide > 0").distinct()
    return survivors(facts).join(slides, KEY).select(*KEY, "fact_row", F.col("slide").cast("bigint").alias("slide"))


def _latest(rows: DataFrame, field: str, currency: Currency) -> DataFrame:
    """KEY and the latest value of ``field`` that is not blank; a value without a time is placed by its class ``cls``.

    Ties go to the smallest fact_row. Where nothing with a time comes before it, a value without a time comes before all.
    """
    at, value = F.unix_micros("extracted_at"), F.trim(field)
    per = rows.where(value != "").groupBy(*KEY, "cls").agg(
        F.max(at).alias("last"),
        F.max(F.when(at.isNotNull(), F.struct(at.alias("t"), (-F.col("fact_row")).alias("r"), value.alias("v")))).alias("timed"),
        F.max(F.when(at.isNull(), F.struct((-F.col("fact_row")).alias("r"), value.alias("v")))).alias("untimed"),
    )

    def candidates(e: Column) -> Column:
        entry = lambda x, t, level: F.struct(t.alias("t"), level.alias("l"), x["r"].alias("r"), x["v"].alias("v"))
        late = F.coalesce(currency.placed(e["cls"], F.col("s")), F.lit(-(2**62)))
        return F.array(F.when(e["timed"].isNotNull(), entry(e["timed"], e["timed"]["t"], F.lit(0))), F.when(e["untimed"].isNotNull(), entry(e["untimed"], late, currency.level(e["cls"]) + 1)))

    one = per.groupBy(*KEY).agg(F.collect_list(F.struct("cls", "last", "timed", "untimed")).alias("s"))
    return one.select(*KEY, F.array_max(F.array_compact(F.flatten(F.transform("s", candidates))))["v"].alias(field))


def merged_records(facts: DataFrame) -> DataFrame:
    """One built record a group: the survivor's statement, all its slides, and kind and topic taken field by field.

    kind and topic are the latest values that are not null or blank (ties: smallest fact_row), whichever row has them. A row without
    a time is placed by the precedence of its kind for the kind, and of its statement's class for the topic.
    """
    kept = ["kind", "topic"]
    rows = classified(facts, kept)
    currency = _statement_currency(rows)
    known = F.lower(F.trim("kind"))
    n = rows.count()
    kinds = sorted(r["k"] for r in rows.where(known != "").groupBy(known.alias("k")).count().where(F.col("count") >= KIND_SHARE * n).select("k").collect())  # at most 1 / KIND_SHARE
    of_kind = rows.withColumn("cls", F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]).cast("array<string>"), known) - 1, F.lit(-1)).cast("int"))
    of_kind = of_kind.withColumn("cls", F.when(F.col("cls") < 0, len(kinds)).otherwise(F.col("cls")))
    kind = _latest(of_kind, "kind", Currency(of_kind.where(known != ""), len(kinds) + 1))
    slides = rows.select(*KEY, F.explode("slides").alias("slide")).where("slide > 0").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_slides"), F.min("slide").alias("first_slide"), F.max("slide").alias("last_slide"))
    chosen = _chosen(rows, currency).where("n > 1 AND best IS NOT NULL").select(*KEY, F.col("n").alias("n_rows"), F.col("best.r").alias("fact_row"))
    return (
        chosen.join(rows.groupBy(*KEY, "fact_row").agg(F.min("text").alias("statement")), [*KEY, "fact_row"])
        .join(kind, KEY, "left").join(_latest(rows, "topic", currency), KEY, "left").join(slides, KEY, "left")
        .select(*KEY, "fact_row", "statement", "n_rows", "kind", "topic", F.coalesce("n_slides", F.lit(0)).cast("bigint").alias("n_slides"), "first_slide", "last_slide")
    )
