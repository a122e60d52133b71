"""Scalar text functions of the lesson pipeline, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrain.functions.unicode import folded

#: Words that carry no content in a fact, negations of a fact, and verbs with which a predicate begins.
BRIDGE_WORDS = "a an and are as be been being described describes in include includes is its of refer refers that the through to was were which within with".split()
FACT_NEGATIONS = "except never no not without".split()
PREDICATE = (
    r"is|are|was|were|has|have|had|can|could|may|might|must|should|would|refers?|means?|defines?|describes?|outlines?|addresses?|includes?|contains?|comprises?|consists?|involves?|uses?|stores?|produces?|converts?|causes?"
    r"|affects?|determines?|requires?|enables?|supports?|provides?|allows?|prevents?|reduces?|increases?|improves?|measures?|measured|measuring|evaluates?|evaluated|evaluating|assesses?|assessed|assessing|categorizes?|categorized"
    r"|represents?|follows?|precedes?|creates?|controls?|performs?|occurs?|exists?|depends?|leads?|results?"
)
MISSING = ("not specified", "[unreadable text]", "n/a", "")


def cleaned(c: Column) -> Column:
    """NUL to blank, line ends to LF, blanks and tabs squeezed, three or more LF to two, trimmed."""
    x = F.regexp_replace(F.translate(c, "\0", " "), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


def without_specks(c: Column) -> Column:
    """The cleaned text without lines of one to three marks and no letter or digit; blank lines stay."""
    bare = lambda x: F.regexp_replace(x, r"[ \t]+", "")
    keep = F.filter(F.split(cleaned(c), "\n", -1), lambda x: ~((F.length(bare(x)).between(1, 3)) & ~x.rlike(r"[\p{L}\p{N}]")))
    return F.regexp_replace(F.array_join(keep, "\n"), "^[ \n]+|[ \n]+$", "")


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Before and after a word, for engines whose word boundaries know ASCII only.
_A, _B = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_PARTS = "(?:module|unit|chapter|lesson|section|slide|page)"
_SHOWN = "(?:covered|discussed|included|introduced|mentioned|presented)"
_LABEL = "(?:title|heading|name|number|topic|focus|overview|content)"
LIST_MARKER = r"^(?:[-•▪◦‣]|\p{Nd}+[.)]) ?"
#: Forms of statements that are no facts, in the order in which they are looked for; for squeezed text, in the JVM and in RE2.
NO_FACTS = {
    "address": rf"(?i)(?:https?://|www\.|{_A}doi ?:)",
    "question": "[?？]$",
    "section_path": r"(?i)^(?:module|unit|chapter|lesson|section) ?[a-z0-9.-]* ?[:|>›→-]",
    "objective": rf"(?i)^(?:(?:learning )?objectives?{_B}|(?:the )?(?:learner|student|reader)s? (?:will|should|can|must) )",
    "presentation": rf"(?i)^(?:(?:this|the|the first|the current|first) (?:slide|page)|the module title|(?:this|the) (?:module|lesson|chapter|section) (?:introduces|covers|discusses|presents|contains|provides an overview of)"
    rf"|(?:this|the) (?:content|material|presentation) (?:includes|contains|covers|discusses|introduces|presents|is titled)){_B}",
    "presence_only": rf"(?i){_A}(?:is|are|was|were) (?:a |the )?(?:key )?(?:aspect|concept|item|part|section|topic)s? {_SHOWN} in{_B}",
    "provenance": rf"(?i){_A}{_SHOWN} in (?:this|the) (?:module|lesson|chapter|section|slide|presentation){_B}",
    "quote_meta": rf"(?i)^(?:the )?(?:quote|quotation) (?:by|from)[^\p{{L}}\p{{N}}_](?:.*[^\p{{L}}\p{{N}}_])?(?:mentions|states|says|describes){_B}",
    "label": rf"(?i)^(?:(?:the )?{_LABEL} (?:of|for) (?:the )?{_PARTS}{_B}"
    rf"|(?:the )?{_PARTS} (?:\p{{Nd}}+[a-z]?|[ivxlcdm]+)(?: ?[:|>-]| (?:{_LABEL}|is (?:sub)?titled|is named|is called|covers?|discusses?|focuses? on|provides? an? overview))"
    rf"|(?:this|the) {_PARTS} (?:is )?(?:sub)?titled{_B}|content of (?:this|the) {_PARTS} (?:is (?:about|titled)|discusses|mentions|includes){_B})",
}
STRUCTURAL = ("title", "header", "heading", "objective")
#: Raw slide text: first words that go on from something, ends that lead on, verbs that make a claim, and words.
FRAGMENT_STARTS = "and or but it this these those that which who whose where when while because is are was were has have had can could may might must should would".split()
FRAGMENT_END = rf"(?i)(?:[,;:/-]|{_A}(?:a|an|and|as|at|by|for|from|in|of|on|or|the|to|with))$"
RELATION_VERB = (
    rf"(?i){_A}(?:is|are|was|were|becomes?|(?:refer|mean|define|describe|include|contain|comprise|consist|involve|use|store|produce|convert|cause|affect|determine|require|enable|support|provide|allow|prevent|reduce|increase|improve"
    rf"|measure|evaluate|represent|follow|precede|create|control|perform|occur|exist|depend|lead|result)s?|assesses?){_B}"
)
CONTENT_WORD = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"


def lesson_fact(c: Column) -> Column:
    """One line without a leading dash and then a list marker of any kind; null is empty."""
    x = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _SPACE, " "))
    return F.trim(F.regexp_replace(F.regexp_replace(x, "^- ", ""), LIST_MARKER, ""))


def self_contained(s: Column) -> Column:
    """Whether raw slide text, as ``lesson_fact`` gives it, states a claim on its own."""
    first = F.regexp_extract(s, "^([A-Za-z]+)", 1)
    words = F.regexp_extract_all(s, F.lit(f"({CONTENT_WORD})"), 1)
    n, low = F.size(words), F.size(F.filter(words, lambda w: w.rlike("[a-z]")))
    stopped = s.rlike("[.!]$")
    return (
        F.when((F.lower(first).isin(*FRAGMENT_STARTS) & (first != F.upper(first))) | s.rlike(FRAGMENT_END) | s.rlike(r"^[\p{Ll}ªº]") | (n < 2), False)
        .when(n == 2, stopped & F.get(words, F.lit(1)).rlike("[a-z]"))
        .otherwise(stopped | F.contains(s, F.lit(": ")) | s.rlike(RELATION_VERB) | ((n >= 8) & (low >= F.floor(n / 2))))
    )


def no_fact_reason(s: Column, topic: Column, kind: Column) -> Column:
    """Why a statement, as ``lesson_fact`` gives it, is no usable lesson fact; null for those that are kept."""
    about, sort = lesson_fact(topic), F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    reason = F.when(F.lower(s).isin("", "not specified", "[unreadable text]"), "missing").when((F.length(s) < 5) | ~F.contains(s, F.lit(" ")), "short")
    reason = reason.when((about != "") & (normal_form(s) == normal_form(about)), "topic")
    for name, form in NO_FACTS.items():
        reason = reason.when(s.rlike(form), name)
    return reason.when(sort.isin(*STRUCTURAL), "structural").when((sort == "content") & ~self_contained(s), "not_self_contained")


def kept_facts(facts: DataFrame) -> DataFrame:
    """The rows of facts that are lesson facts, with their statement as ``lesson_fact`` gives it.

    The statement and the reason are worked out once a row: as elements of arrays they do not move into the filter.
    """
    rest = [c for c in facts.columns if c != "statement"]
    f = facts.select(*rest, F.explode(F.array(lesson_fact(F.col("statement")))).alias("statement"))
    f = f.select("*", F.explode(F.array(no_fact_reason(F.col("statement"), F.col("topic"), F.col("kind")))).alias("reason"))
    return f.where("reason IS NULL").drop("reason")


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits of the folded text."""
    return F.regexp_extract_all(folded(c), F.lit("([a-z0-9]+)"), 1)


def normal_form(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def content_of(words: Column) -> Column:
    """The tokens that carry content."""
    return F.filter(words, lambda x: ~x.isin(*BRIDGE_WORDS))


def subject_of(form: Column) -> Column:
    """The distinct content words of a normal form before the predicate's first verb, in order of name; none where there is no such verb."""
    before = F.regexp_extract(form, rf"^(.*?)\b(?:{PREDICATE})\b", 1)
    return F.array_sort(F.array_distinct(F.filter(F.split(F.trim(before), " "), lambda x: (x != "") & ~x.isin(*BRIDGE_WORDS))))


def is_enumeration(c: Column) -> Column:
    return (F.length(c) - F.length(F.translate(c, ",;", "")) >= 2) | (F.size(F.regexp_extract_all(c, F.lit(r"((?:^|\s)[0-9]+[.)]\s)"), 1)) >= 3)


def safe_component(c: Column, fallback: str) -> Column:
    x = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(fallback))


def module_label(c: Column) -> Column:
    """Decimal numbers without leading zeros, anything else made safe."""
    return F.when(c.rlike("^[0-9]+$"), F.regexp_replace(c, "^0+(?=[0-9])", "")).otherwise(safe_component(c, "module"))


def duration(seconds: Column) -> Column:
    s = F.bround(seconds).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m "), two(r), F.lit("s"))).when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(r), F.lit("s"))).otherwise(F.concat(r.cast("string"), F.lit("s")))
