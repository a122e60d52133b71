"""Text rules of assessment cards, as expressions and as SQL with the same meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coursegrain.functions.unicode import folded, folded_sql

_W = r"[\p{L}\p{N}_]"
#: Before and after a word, for engines whose word boundaries know ASCII only.
_A, _B = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"

TYPES = ("multiple-choice", "identification", "true-false")
TEXT_FIELDS = ("question", "correct_option", "wrong_option_1", "wrong_option_2", "wrong_option_3", "expalanation", "hint")
OPTIONS = TEXT_FIELDS[1:5]
#: Phrases that may not frame a question.
BANNED_FRAMING = (
    "This statement accurately describes", "The following claim", "According to the graph", "According to the material", "According to the module", "According to the lesson",
    "According to the document", "Based on the material", "The material/module/lesson/document states", "Identify the concept associated with", "Consider the following statement", "Evaluate this statement",
)
LEADING_WRAPPER = rf"(?i)^(?:according to|based on){_B}"
DIRECT_STEM = rf"(?i)^(?:what|which|who|where|when|why|how){_B}"
GENERIC_EXPLANATION = r"(?i)^(?:.+?\s+is\s+the\s+correct\s+answer(?:\s+here)?|this\s+is\s+the\s+correct\s+answer(?:\s+for\s+this\s+question)?|this\s+statement\s+is\s+(?:true|false))\.?$"
#: What a source may be called, and wording that shows where a claim came from, in the order in which it is looked for.
_SOURCE = r"(?:knowledge\s+graph|concept\s+facts?|facts?|source(?:\s+material)?|evidence|material|information|text|module(?:\s+content)?|document|lesson|slides?|file|chunk|citation|url|definition|vocabulary)"
_GIVEN = r"(?:(?:provided|supplied|given)\s+)?"
PROVENANCE = tuple(
    rf"(?i){_A}({body}){_B}"
    for body in (
        r"concept facts?",
        r"distractor pool",
        r"(?:allowed|suggested)[_\s]+wrong[_\s]+option[_\s]+terms",
        r"already covered subjects|previously covered concepts",
        r"provided vocabulary",
        r"fact(?:[_\s]+id)?\s*[:#-]?\s*[a-z][0-9]+",
        rf"(?:according\s+to|based\s+on)\s+(?:the\s+)?{_GIVEN}{_SOURCE}",
        rf"as\s+(?:stated|described|noted|shown|mentioned)\s+in\s+(?:the\s+)?{_GIVEN}{_SOURCE}",
        r"(?:provided|supplied|given)\s+(?:facts?|material|information|text|source(?:\s+material)?|definition|vocabulary)",
        rf"(?:appears?|found|listed|included|defined|described|mentioned|discussed|presented|introduced|covered|stated|shown)\s+(?:only\s+)?(?:in|by)\s+(?:the\s+)?{_GIVEN}{_SOURCE}",
        rf"(?:follows?|comes?)\s+from\s+(?:the\s+)?{_GIVEN}{_SOURCE}",
        r"(?:the\s+)?(?:source|document|lesson|slides?|facts?|knowledge\s+graph)\s+(?:explicitly\s+)?(?:states?|says?|explains?|describes?|notes?|indicates?|mentions?|shows?|confirms?)",
        r"(?:the\s+)?module(?:'s|’s)\s+(?:content|description|focus|overview|title|heading)",
    )
)


def bare(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(bare(c), F.lit("")) == ""


def blank_sql(x: str) -> str:
    return rf"(coalesce(regexp_replace({x}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'), '') = '')"


def provenance_trigger(c: Column) -> Column:
    """The first wording that shows a source, by the order of the patterns; null where there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in PROVENANCE])


def provenance_sql(x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p.replace(chr(39), chr(39) * 2)}', 1), '')" for p in PROVENANCE) + ")"


#: Signs that look alike and mean the same, and what tells that an option is written in symbols.
_LOOKALIKES = ("‐‑‒–—−﹣‘’ʼ", "-------'''")
_NOTATION = (
    r"<<|>>|==|!=|<=|>=|:=|->|=>|\+\+|--|&&|\|\||[=+*/^%<>|&~]",
    r"[()\[\]{}]",
    r"""\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'""",
    r"(?:^|[^\p{L}\p{N}_])[0-9]+(?:\.[0-9]+)?\s*:\s*[0-9]+(?:\.[0-9]+)?(?:$|[^\p{L}\p{N}_])",
    r"(?i)(?:^|[^\p{L}\p{N}_])[0-9]+(?:\.[0-9]+)?\s*[a-zµ°ωΩ]{1,8}(?:/[a-zµ°ωΩ]{1,8})?(?:$|[^\p{L}\p{N}_])",
)
_TIGHT = r"\s*([_+#*/^%=<>|&~@()\[\]{}:\-])\s*"
_SUFFIX = r"([\p{L}\p{N}_])([+#]+)([a-z]{2,}(?:$|[^\p{L}\p{N}_]))"


def canonical_option(c: Column) -> Column:
    """Option identity: one form of Unicode, case and blanks, with the marks that carry meaning; marks at the end go."""
    x = F.translate(folded(c), *_LOOKALIKES)
    written = F.lit(False)
    for p in _NOTATION:
        written = written | x.rlike(p)
    y = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), _TIGHT, "$1"), _SUFFIX, "$1$2 $3")
    return F.when(written, F.regexp_replace(y, r"[.!?:]+$", "")).otherwise(F.regexp_replace(y, r"[.!?,;:]+$", ""))


def canonical_option_sql(x: str) -> str:
    x = f"translate({folded_sql(x)}, '{_LOOKALIKES[0]}', '{_LOOKALIKES[1].replace(chr(39), chr(39) * 2)}')"
    written = " OR ".join(f"regexp_matches({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in _NOTATION)
    y = rf"regexp_replace(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '{_TIGHT}', '\1', 'g'), '{_SUFFIX}', '\1\2 \3', 'g')"
    return f"(CASE WHEN {written} THEN regexp_replace({y}, '[.!?:]+$', '') ELSE regexp_replace({y}, '[.!?,;:]+$', '') END)"


_JOINED = r"\p{L}\p{N}_+#\-*/^%=<>|&~@."
_LEFT, _RIGHT = rf"(?:^|[^{_JOINED}])", rf"(?:$|\.(?:$|[^\p{{L}}\p{{N}}])|[^{_JOINED}])"


def holds_answer(text: Column, answer: Column) -> Column:
    """Whether a canonical answer stands in a canonical text, not as a part of a longer identifier. An empty answer stands in none."""
    pattern = F.concat(F.lit(_LEFT + r"\Q"), answer, F.lit(r"\E" + _RIGHT))
    return F.coalesce((answer != "") & F.contains(text, answer) & F.when(F.contains(text, answer), F.regexp_like(text, pattern)), F.lit(False))


def holds_answer_sql(text: str, answer: str) -> str:
    return rf"coalesce({answer} <> '' AND contains({text}, {answer}) AND regexp_matches({text}, '{_LEFT}\Q' || {answer} || '\E{_RIGHT}'), false)"


def question_stem(c: Column) -> Column:
    """Letters, digits and underscores of the folded question, with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(c), r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def question_stem_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({folded_sql(x)}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


#: Words of negation, words that frame a question, and endings that are read as one root.
NEGATIONS = "not no never without except neither nor cannot least most".split()
FRAMES = "how what when where which who whom whose why".split()
ROOTS = {
    "safe": "safe", "safety": "safe", "comfort": "comfort", "comfortable": "comfort", "enjoy": "enjoy", "enjoyable": "enjoy", "enjoyment": "enjoy",
    "efficient": "efficient", "efficiency": "efficient", "effective": "effective", "effectiveness": "effective", "satisfied": "satisfy", "satisfaction": "satisfy",
}


def stem(c: Column) -> Column:
    """A word without plural and verb endings; known roots first, numbers stay."""
    n = F.length(c)
    roots = F.create_map(*[F.lit(x) for pair in ROOTS.items() for x in pair])
    return (
        F.when(roots[c].isNotNull(), roots[c]).when(c.rlike("^[0-9]+$"), c).when((n > 4) & c.endswith("ies"), F.concat(F.substring(c, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & c.endswith("es"), F.substring(c, F.lit(1), n - 2)).when((n > 3) & c.endswith("s") & ~c.endswith("ss"), F.substring(c, F.lit(1), n - 1))
        .when((n > 5) & c.endswith("ing"), F.substring(c, F.lit(1), n - 3)).when((n > 4) & c.endswith("ed"), F.substring(c, F.lit(1), n - 2)).otherwise(c)
    )


def stem_sql(w: str) -> str:
    roots = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROOTS.items())
    return (
        f"coalesce(CASE {w} {roots} END, CASE WHEN regexp_full_match({w}, '[0-9]+') THEN {w} WHEN length({w}) > 4 AND suffix({w}, 'ies') THEN {w}[:-4] || 'y' WHEN length({w}) > 4 AND suffix({w}, 'es') THEN {w}[:-3]"
        f" WHEN length({w}) > 3 AND suffix({w}, 's') AND NOT suffix({w}, 'ss') THEN {w}[:-2] WHEN length({w}) > 5 AND suffix({w}, 'ing') THEN {w}[:-4] WHEN length({w}) > 4 AND suffix({w}, 'ed') THEN {w}[:-3] ELSE {w} END)"
    )


def expanded(c: Column) -> Column:
    """The folded text with short negations written out."""
    x = F.replace(folded(c), F.lit("’"), F.lit("'"))
    return F.regexp_replace(F.replace(F.replace(x, F.lit("can't"), F.lit("cannot")), F.lit("won't"), F.lit("will not")), rf"({_W}+)n't{_B}", "$1 not ")


def expanded_sql(x: str) -> str:
    x = f"replace(replace(replace({folded_sql(x)}, '’', ''''), 'can''t', 'cannot'), 'won''t', 'will not')"
    return rf"regexp_replace({x}, '({_W}+)n''t{_B}', '\1 not ', 'g')"


def question_words(c: Column) -> Column:
    x = F.trim(F.regexp_replace(F.regexp_replace(expanded(c), r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))
    return F.filter(F.split(x, " "), lambda w: w != "")


def question_words_sql(x: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace(regexp_replace({expanded_sql(x)}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


def negation_markers(words: Column) -> Column:
    return F.array_sort(F.filter(words, lambda w: w.isin(*NEGATIONS)))


def content_words(words: Column) -> Column:
    """Stems of the words that neither frame a question nor negate."""
    return F.transform(F.filter(words, lambda w: ~w.isin(*FRAMES, *NEGATIONS)), stem)


def polarity_words(content: Column) -> Column:
    """Content words without do-support and a final e, for statements that differ by a negation."""
    kept = F.filter(content, lambda w: ~w.isin("do", "doe", "did"))
    return F.transform(kept, lambda w: F.when((F.length(w) > 4) & w.endswith("e"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def _in_sql(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def negation_markers_sql(ws: str) -> str:
    return f"list_sort(list_filter({ws}, lambda w: w IN ({_in_sql(NEGATIONS)})))"


def content_words_sql(ws: str) -> str:
    return f"list_transform(list_filter({ws}, lambda w: w NOT IN ({_in_sql(FRAMES + NEGATIONS)})), lambda w: {stem_sql('w')})"


def polarity_words_sql(content: str) -> str:
    return f"list_transform(list_filter({content}, lambda w: w NOT IN ('do', 'doe', 'did')), lambda w: CASE WHEN length(w) > 4 AND suffix(w, 'e') THEN w[:-2] ELSE w END)"


_FROM = _GIVEN + _SOURCE
_TELLS = r"(?:states?|stated|says?|said|explains?|explained|describes?|described|notes?|noted|indicates?|indicated|mentions?|mentioned|discusses?|discussed|shows?|showed|confirms?|confirmed)"
_PLACED = r"(?:mentioned|discussed|described|defined|presented|introduced|covered)"
#: Wording about a source, in the order in which it goes, and what stays of it.
CITATIONS = (
    (r"(?i)\bis\s+explicitly\s+stated\s+as\s+(.+?)\s+in\s+the\s+(?:provided|supplied)\s+facts?\b", "is $1"),
    (r"(?i)^\s*the\s+(?:provided|supplied)\s+facts?\s+(?:explicitly\s+)?(?:state|states|stated|support|supports|supported|indicate|indicates|show|shows|confirm|confirms)\s+that\s+", ""),
    (rf"(?i)^\s*(?:the\s+)?{_FROM}\s+(?:explicitly\s+)?{_TELLS}(?:\s+that\s+|\s*:\s*)", ""),
    (r"(?i)^\s*fact(?:[_\s]+id)?\s*[:#-]?\s*[a-z]\d+\s+(?:states?|says?|explains?|describes?|notes?|indicates?|mentions?|shows?|confirms?)\s+(?:that\s+|:\s*)", ""),
    (rf"(?i)(?:\s+(?:that|which)\s+(?:is|are|was|were)\s+|,\s*(?:as\s+)?|\s+as\s+){_PLACED}\s+in\s+(?:the\s+)?{_FROM}\b(?!['’]s\b)\s*,?", " "),
    # a participle stays where it is the predicate
    (rf"(?i)(?<!\b(?:is|are|was|were|been|being)(?:\s{{1,9}}[a-z]{{1,30}}ly)?)\s+{_PLACED}\s+in\s+(?:the\s+)?{_FROM}\b(?!['’]s\b)\s*,?", " "),
    (rf"(?i),?\s*(?:(?:according\s+to|based\s+on)\s+(?:the\s+)?{_FROM}|as\s+(?:stated|described)\s+in\s+(?:the\s+)?{_FROM})\b(?=\s*[,?.!]|$),?\s*", " "),
)
#: What a hint says when nothing of its own is left.
PLAIN_HINT = "Consider the key relationship or distinction central to this topic."


def _let(x: Column, f) -> Column:
    """f(x), with x worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _ended(x: Column) -> Column:
    """The text with a final mark and a capital."""
    x = F.regexp_replace(x, r"([^.!?])$", "$1.")
    return _let(x, lambda y: F.concat(F.upper(F.substring(y, 1, 1)), F.substring(y, F.lit(2), F.length(y))))


def without_citations(c: Column) -> Column:
    """The text without the clauses that say where it comes from, as a sentence; what else is said stays."""
    for pattern, kept in CITATIONS:
        c = F.regexp_replace(c, pattern, kept)
    c = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    c = F.regexp_replace(F.regexp_replace(c, r"\s+([.,?!])", "$1"), r"\.\s*\.", ".")
    return _ended(F.trim(c, F.lit(" ,")))


def _defined(subject: Column, description: Column) -> Column:
    what = F.regexp_replace(F.trim(description), r"[.!?]+$", "")
    return _ended(F.concat(F.trim(subject), F.when(what.rlike(r"^[A-Za-z]+ing\b"), F.lit(" is characterized by ")).otherwise(F.lit(" is ")), what, F.lit(".")))


_QUOTES = rf"(?i)^\s*(?:the\s+)?(?:correct\s+answer|answer)\s+(?:directly\s+)?(?:quotes?|repeats?|restates?)\s+(?:the\s+)?{_FROM}\s*,?\s*which\s+(?:defines?|describes?)\s+(.+?)\s+as\s+(.+?)[.!]?\s*$"
_DEFINES = rf"(?i)^\s*(?:the\s+)?(?:term|concept|answer)\s+is\s+(?:directly\s+)?(?:defined|described|presented)\s+in\s+(?:the\s+)?{_FROM}\s+as\s+(.+?)[.!]?\s*$"
_words = lambda c: F.size(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), 1))


def cleaned_explanation(c: Column, answer: Column) -> Column:
    """An explanation as a plain claim; as it was where less than four words or still a source would be left."""
    told = F.when(c.rlike(_QUOTES), _defined(F.regexp_extract(c, _QUOTES, 1), F.regexp_extract(c, _QUOTES, 2))).when(
        c.rlike(_DEFINES) & ~blank(answer), _defined(answer, F.regexp_extract(c, _DEFINES, 1))
    ).otherwise(without_citations(c))
    bare_claim = lambda x: _let(F.trim(F.regexp_replace(x, r"(?i)^this\s+statement\s+is\s+(?:true|false)\s*[.!:]?\s*", "")), lambda r: F.when(r != "", _ended(r)).otherwise(x))
    return _let(_let(told, bare_claim), lambda x: F.when((_words(x) < 4) | provenance_trigger(x).isNotNull(), c).otherwise(x))


def cleaned_hint(c: Column) -> Column:
    return _let(without_citations(c), lambda x: F.when((x == "") | provenance_trigger(x).isNotNull(), F.lit(PLAIN_HINT)).otherwise(x))


def cleaned_question(c: Column) -> Column:
    """A question without its source; as it was where less than three words or still a source would be left."""
    return _let(without_citations(c), lambda x: F.when((_words(x) < 3) | provenance_trigger(x).isNotNull(), c).otherwise(x))
