"""Text rules of entities, relations and their support in a source, as expressions and as SQL with the same meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coursegrain.functions.unicode import folded, folded_sql

#: The relations of the graph, and phrases that stand for them.
RELATIONS = "defines created_by enacted_on part_of contrasts_with example_of mandates is_a".split()
PHRASES = {
    "define": "defines", "defines": "defines", "meaning": "defines", "created by": "created_by", "creates": "created_by", "created": "created_by", "enacted on": "enacted_on", "enacted": "enacted_on",
    "date of enactment": "enacted_on", "part of": "part_of", "belongs to": "part_of", "contrasts with": "contrasts_with", "opposite of": "contrasts_with", "example of": "example_of",
    "is an example of": "example_of", "mandates": "mandates", "requires": "mandates", "is a": "is_a", "type of": "is_a", "category of": "is_a",
}
#: Kinds of laws as they are written and as they are keyed, cues that a text names an alias.
LAW_KINDS = {"ra": "act", "republic act": "act", "act": "act", "law": "act", "eo": "order", "executive order": "order", "proclamation": "proclamation", "ordinance": "ordinance", "resolution": "resolution"}
_A, _B = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
LAW = rf"{_A}(ra|republic act|act|law|eo|executive order|proclamation|ordinance|resolution)\s*[-.]?\s*([0-9]{{2,}}){_B}"
LAW_TITLE = rf"{_A}(?:act|law|order|proclamation|ordinance|resolution)$"
ALIAS_CUE = rf"(?i){_A}(?:also known as|known as|aka|otherwise called|officially called){_B}|[()]"
_LAW_WORD = rf"(?i){_A}(?:ra|republic act|act|law){_B}"
_DATE = rf"(?:{_A}(?:19|20)[0-9]{{2}}{_B})|(?:{_A}[0-9]{{1,2}} [A-Za-z]+ [0-9]{{4}}{_B})"


def canonical(c: Column) -> Column:
    return F.trim(F.regexp_replace(folded(c), r"(?U)\s+", " "))


def canonical_sql(x: str) -> str:
    return rf"trim(regexp_replace({folded_sql(x)}, '\s+', ' ', 'g'))"


def relation(c: Column) -> Column:
    """The relation that a wording stands for: a relation's own name, a phrase, else the longest phrase in it; null for others."""
    x = canonical(F.replace(c, F.lit("_"), F.lit(" ")))
    exact = F.create_map(*[F.lit(v) for pair in PHRASES.items() for v in pair])
    inside = F.coalesce(*[F.when(F.contains(x, F.lit(p)), F.lit(r)) for p, r in sorted(PHRASES.items(), key=lambda e: -len(e[0]))])
    return F.coalesce(exact[x], inside)


def relation_sql(c: str) -> str:
    x = canonical_sql(f"replace({c}, '_', ' ')")
    whens = [f"WHEN x = '{p}' THEN '{r}'" for p, r in PHRASES.items()] + [f"WHEN contains(x, '{p}') THEN '{r}'" for p, r in sorted(PHRASES.items(), key=lambda e: -len(e[0]))]
    return f"(SELECT CASE {' '.join(whens)} END FROM (SELECT {x} AS x))"


def entity_key(c: Column) -> Column:
    """One key for the ways in which an entity is written; laws by kind and number, bare numbers as laws of unknown kind."""
    x = F.replace(canonical(c), F.lit("–"), F.lit("-"))
    kinds = F.create_map(*[F.lit(v) for pair in LAW_KINDS.items() for v in pair])
    kind, number = F.regexp_extract(x, LAW, 1), F.regexp_extract(x, LAW, 2)
    return F.when(number != "", F.concat(F.lit("legal:"), kinds[kind], F.lit(":"), number)).when(x.rlike("^[0-9]{2,}$"), F.concat(F.lit("legal:unknown:"), x)).otherwise(x)


def entity_key_sql(c: str) -> str:
    x = f"replace({canonical_sql(c)}, '–', '-')"
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LAW_KINDS.items())
    return f"(CASE WHEN regexp_matches({x}, '{LAW}') THEN 'legal:' || (CASE regexp_extract({x}, '{LAW}', 1) {kinds} END) || ':' || regexp_extract({x}, '{LAW}', 2) WHEN regexp_full_match({x}, '[0-9]{{2,}}') THEN 'legal:unknown:' || {x} ELSE {x} END)"


def is_identifier(c: Column) -> Column:
    return F.lower(c).rlike(LAW) | F.trim(c).rlike("^[0-9]{2,}$")


def is_title(c: Column) -> Column:
    return canonical(c).rlike(LAW_TITLE)


def surface(c: Column) -> Column:
    """The ASCII words of a text with one blank around each, so that a run of words is found as a part of a string."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1), " "), F.lit(" "))


def surface_sql(x: str) -> str:
    return f"(' ' || array_to_string(regexp_extract_all(lower({x}), '[a-z0-9]+'), ' ') || ' ')"


def supports(subject: Column, rel: Column, obj: Column, text: Column) -> Column:
    """Whether a text names subject and object as runs of words, the subject not after the object, with a date for an enactment and no
    law as the maker of what is no law. Words are compared exactly."""
    s, o, t = surface(subject), surface(obj), surface(text)
    at = lambda x: F.position(x, t)
    named = (s != "  ") & (o != "  ") & (at(s) > 0) & (at(o) > 0) & (at(s) <= at(o))
    dated = (rel != "enacted_on") | obj.rlike(_DATE)
    made = (rel != "created_by") | subject.rlike(_LAW_WORD) | ~obj.rlike(_LAW_WORD)
    return F.coalesce(named & dated & made, F.lit(False))


def supports_sql(subject: str, rel: str, obj: str, text: str) -> str:
    s, o, t = surface_sql(subject), surface_sql(obj), surface_sql(text)
    return (
        f"coalesce({s} <> '  ' AND {o} <> '  ' AND instr({t}, {s}) > 0 AND instr({t}, {o}) > 0 AND instr({t}, {s}) <= instr({t}, {o}) AND ({rel} <> 'enacted_on' OR regexp_matches({obj}, '{_DATE}'))"
        f" AND ({rel} <> 'created_by' OR regexp_matches({subject}, '{_LAW_WORD}') OR NOT regexp_matches({obj}, '{_LAW_WORD}')), false)"
    )
