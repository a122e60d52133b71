"""Noise in text from scanned pages: running headers, page numbers, words broken over lines and misread characters.

Misread words are found in SQL by anagram hashes: a word's hash is the sum of the fifth powers of its code points, so putting the
right characters for confused ones changes it by a fixed difference. Rare words are joined on hash plus difference with frequent
words, and a hit is verified by really making the replacement. Headers are edge lines that other numbers of the module repeat, up
to confusable characters; page numbers are edge lines of nothing else; hyphens need their word to go on in the next line, which the other
lines decide: they have the word, or its compound, or at least not its second part alone. In the repaired text the hyphen stays where the
other lines have the word with it more often than without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrain.sources.tables import cut

#: What scanners read, and what stood there (lower case); fixed values.
CONFUSED = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("i", "l"), ("l", "i"), ("|", "l"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"),
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("nn", "m"), ("in", "m"), ("ri", "n"), ("u", "n"), ("n", "u"), ("o", "0"), ("q", "g"), ("f", "t"), ("t", "f"), ("y", "v"), ("a", "o"), ("o", "a"),
]
#: Each confusable reduced to one sign, then groups of signs: lines that differ by misreadings only become equal.
_SIGNS = ("01|!il5689cebfuaq", "oiiiiishhgeehtnog")
_SAME = [("ri", "n"), ("rn", "m"), ("nn", "m"), ("vv", "w"), ("ei", "d"), ("ii", "n")]
#: Lines that stand for missing text and are no headers.
SENTINELS = ("not specified", "[unreadable text]", "unreadable text", "n/a")
HYPHENS = "\\-\u00ad\u00ac\u2010\u2011"
HYPHEN_MARKS = ("-", "\u00ad", "\u00ac", "\u2010", "\u2011")
#: Signs that a header has at least; fewer are bullets and marks that any page may have.
LEAST_SIGNS = 5
#: A misread word is at most this share as frequent as its variant, which must occur so often.
RARE_SHARE, LEAST_USES = 0.25, 4
#: Letters of a word in which two changes may be put right.
TWO_CHANGES = 6
#: Words up to which a table of them goes to all executors; beyond it the join is shuffled.
BROADCAST_WORDS = 200_000
_ROMAN = r"(?:x{0,3}(?:ix|iv|v?i{1,3}|v)|x{1,3}|xl|l)"
_LOOSE = r"[0-9olis|]+"
_NUM = r"[0-9olis|]*[0-9][0-9olis|]*"
PAGE_NUMBER = rf"(?i)^[\s\[(\-–—•.|]*(?:(?:page|pagc|paqe|p|pg|pp|pag|página|pagina|pahina|seite|slide)\b\.?\s*{_LOOSE}(?:\s*(?:/|of|0f|de|ng|von|-)\s*{_LOOSE})?|{_NUM}(?:\s*(?:/|of|0f|de|ng|von|-)\s*{_NUM})?|{_ROMAN})[\s\])\-–—•.|]*$"


def _items(df: DataFrame, name: str, key: str, lines: Column) -> DataFrame:
    """One row an item, with its lines as an array."""
    return df.select(F.lit(name).alias("item_table"), F.col(key).cast("bigint").alias("item_id"), "course_code", "module_number", "number", lines.alias("lines"))


def _bare(x: Column) -> Column:
    return F.rtrim(F.coalesce(x, F.lit("")), F.lit("\r"))


def _lines(items: DataFrame) -> DataFrame:
    """One row a line, numbered from 1, with the line after it."""
    e = items.select("item_table", "item_id", "lines", F.posexplode_outer("lines").alias("at", "x"))
    return e.select("item_table", "item_id", (F.col("at") + 1).cast("bigint").alias("line_no"), _bare(F.col("x")).alias("line"), F.get("lines", F.col("at") + 1).alias("after"))


def page_lines(pages: DataFrame) -> DataFrame:
    """Items with the lines of extracted_pages.text, split at line feeds; null and empty texts have none."""
    return _items(pages.where("text <> ''"), "extracted_pages", "page_id", F.split("text", "\n", -1))


def slide_lines(slides: DataFrame) -> DataFrame:
    """Items with the entries of slides.visual_text as lines; null and empty lists have none, null items are blank lines."""
    return _items(slides.where("size(visual_text) > 0"), "slides", "slide_id", F.col("visual_text"))


def _skeleton(c: Column) -> Column:
    x = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}|!]+", "")
    x = F.translate(x, *_SIGNS)
    for wrong, right in _SAME:
        x = F.replace(x, F.lit(wrong), F.lit(right))
    return x


def _is_number(c: Column) -> Column:
    return (F.trim(c) != "") & F.trim(c).rlike(PAGE_NUMBER)


def edge_lines(items: DataFrame) -> DataFrame:
    """(item_table, item_id, line_no, noise) of running headers and footers and of page numbers.

    An edge line is the first or last that is not blank, or the one next to it. A header repeats, up to confusable characters, on
    edges of at least two different numbers of its module, is no end of a sentence, and, where it is not outermost, has a header
    or page number outside it. A page number stands outermost, or next to a header.
    """
    keys = ["item_table", "item_id"]
    # only the outer four lines of an item are looked at one by one
    full = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.trim(_bare(F.get("lines", i))) != "")
    base = items.select(*keys, "course_code", "module_number", "number", "lines", full.alias("full"))
    place = lambda i: F.struct((F.get("full", i) + 1).cast("bigint").alias("line_no"), i.alias("from_top"), (F.size("full") - 1 - i).alias("from_end"), _bare(F.get("lines", F.get("full", i))).alias("line"))
    outer = F.filter(F.sequence(F.lit(0), F.size("full") - 1), lambda i: (i <= 1) | (i >= F.size("full") - 2))
    edge = base.where("size(full) > 0").select(*keys, "course_code", "module_number", "number", F.explode(F.transform(outer, place)).alias("e")).select(*keys, "course_code", "module_number", "number", "e.*")
    # of a line only its signs are needed, worked out once: nothing moves below the explode
    headed = ~F.trim("line").rlike(r"[.!?;,。][\"”»')]?$") & ~F.lower(F.trim("line")).isin(*SENTINELS)
    signs = F.when(_is_number(F.col("line")), "\n").when(headed, _skeleton(F.col("line")))
    edge = edge.select(*keys, "course_code", "module_number", "number", "line_no", "from_top", "from_end", F.explode(F.array(signs)).alias("signs")).where(f"signs = '\n' OR length(signs) >= {LEAST_SIGNS}")
    # lines of any length meet on their hash
    named = cut(edge.select(*keys, "course_code", "module_number", "number", "line_no", "from_top", "from_end", (F.col("signs") == "\n").alias("is_number"), F.when(F.col("signs") != "\n", F.struct(F.xxhash64("signs"), F.length("signs"))).alias("skel")))
    module = ["course_code", "module_number", "skel"]
    seen = named.where("skel IS NOT NULL").select(*module, "number").distinct().groupBy(*module).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    hit = named.where("skel IS NOT NULL").join(seen.select(*module), module, "left_semi").select(*keys, "line_no", "from_top", "from_end", F.lit("header").alias("noise"))
    numbers = named.where("is_number").select(*keys, "line_no", "from_top", "from_end", F.lit("page_number").alias("noise"))
    # at most four edge lines an item
    per = hit.unionByName(numbers).groupBy(*keys).agg(F.collect_set(F.struct("line_no", "from_top", "from_end", "noise")).alias("e"))
    outermost = lambda x: (x["from_top"] == 0) | (x["from_end"] == 0)
    good = F.filter("e", lambda x: outermost(x) | F.exists("e", lambda o: ((x["from_top"] == 1) & (o["from_top"] == 0)) | ((x["from_end"] == 1) & (o["from_end"] == 0))))
    return per.select(*keys, F.explode(good).alias("x")).select(*keys, "x.line_no", "x.noise")


def _goes_on() -> Column:
    """Whether the line ends with a letter and a hyphen and the next begins with a letter."""
    return F.right(F.rtrim("line"), F.lit(1)).isin(*HYPHEN_MARKS) & F.col("line").rlike(rf"\p{{L}}[{HYPHENS}]\s*$") & F.col("after").rlike(r"^\s*\p{L}")


def _first_part() -> Column:
    w = r"[\p{L}\p{N}]"
    return F.regexp_extract(F.lower("line"), rf"(?<!{w})({w}++)[{HYPHENS}]\s*+$", 1)


def _rest_part() -> Column:
    return F.regexp_extract(F.lower("after"), r"^\s*([\p{L}\p{N}]++)", 1)


def _hash(c: Column) -> Column:
    """The sum of the fifth powers of a word's code points, whatever their order."""

    def value(x: Column) -> Column:
        a = F.ascii(x).cast("bigint")
        return F.when(a < 1024, a * a * a * a * a).otherwise(a * 1000003)

    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("bigint"), lambda s, x: s + value(x))


def _value(s: str) -> int:
    return sum(ord(c) ** 5 for c in s)


def _line_words(c: Column) -> Column:
    """The words of a line in lower case, but for one that is broken off by a hyphen at its end."""
    broken = F.right(F.rtrim(c), F.lit(1)).isin(*HYPHEN_MARKS)
    whole = F.when(broken, F.regexp_replace(c, rf"(?<!\p{{L}})\p{{L}}++[{HYPHENS}]\s*+$", "")).otherwise(c)
    return F.filter(F.split(F.lower(whole), r"[^\p{L}\p{N}|]+"), lambda w: w != "")


#: Stands between the two parts of a break, so that breaks count and meet as words do; no word holds a blank, and none a hyphen.
_BREAK = " "


def _break() -> Column:
    """The parts of the word that is broken at the line's end, as an array of one or none."""
    return F.when(_goes_on(), F.array(F.concat_ws(_BREAK, _first_part(), _rest_part()))).otherwise(F.array().cast("array<string>"))


def _word_counts(lines: DataFrame) -> DataFrame:
    """(word, n): the uses of each word of the lines, of each compound with a hyphen inside a line and of each break between two."""
    w = r"[\p{L}\p{N}]"
    inside = F.regexp_extract_all(F.translate(F.lower("line"), "\u2010\u2011", "--"), F.lit(rf"(?<!{w})(?=({w}++-{w}++))"), 1)
    compounds = F.when(F.col("line").rlike(rf"[-\u2010\u2011]{w}"), inside).otherwise(F.array().cast("array<string>"))
    words = lines.select(F.explode(F.concat(_line_words(F.col("line")), compounds, _break())).alias("word"))
    return cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def broken_words(counts: DataFrame) -> DataFrame:
    """(word, goes_on, hyphened): the distinct breaks (the word parts on both sides), and what the other lines say of them.

    ``hyphened``: inside lines the two are written with a hyphen more often than as one word, so the compound keeps it. ``goes_on`` is
    false where nothing speaks for a broken word: neither form is written anywhere, while the second part is a word of other lines
    by itself ("pre-" and "and").
    """
    part = lambda k: F.split_part("word", F.lit(_BREAK), F.lit(k))
    pairs = counts.where(F.contains("word", F.lit(_BREAK))).select("word", part(1).alias("first"), part(2).alias("rest"), F.col("n").alias("breaks"))
    uses = lambda key, n: counts.select(F.col("word").alias(key), F.col("n").alias(n))
    own = pairs.groupBy("rest").agg(F.sum("breaks").alias("as_rest")).join(uses("rest", "rest_uses"), "rest")
    known = (
        pairs.withColumn("compound", F.concat_ws("-", "first", "rest")).join(uses("compound", "with_hyphen"), "compound", "left")
        .withColumn("whole", F.concat("first", "rest")).join(uses("whole", "as_one"), "whole", "left").join(own, "rest", "left")
    )
    written = F.col("as_one").isNotNull() | F.col("with_hyphen").isNotNull()
    return known.select("word", (written | ~F.coalesce(F.col("rest_uses") > F.col("as_rest"), F.lit(False))).alias("goes_on"), (F.coalesce("with_hyphen", F.lit(0)) > F.coalesce("as_one", F.lit(0))).alias("hyphened"))


def misread_words(lines: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(word, variant): rare words that become a frequent word of letters when one or two confused characters are put right.

    The most frequent variant is taken (ties: fewest changes, then the first by name).
    """
    counts = _word_counts(lines) if counts is None else counts
    frequent = counts.where((F.col("n") >= LEAST_USES) & F.col("word").rlike(r"^\p{L}{3,}$")).select(F.col("word").alias("variant"), F.col("n").alias("m"), _hash(F.col("word")).alias("h"))
    if frequent.count() <= BROADCAST_WORDS:
        frequent = F.broadcast(frequent)
    changes = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(r).alias("r"), F.lit(_value(r) - _value(w)).cast("bigint").alias("d")) for w, r in CONFUSED])
    plain = (F.length("word") >= 3) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(f"[-{_BREAK}]")
    rare = counts.where(plain).select("word", "n", _hash(F.col("word")).alias("g"), F.filter(changes, lambda x: F.contains(F.col("word"), x["w"])).alias("c"))
    one = rare.select("word", "n", "g", F.explode("c").alias("a"), "c")
    # one change, or, in longer words, two of them; the second may only follow in the list, or repeat
    second = F.when(F.length("word") >= TWO_CHANGES, F.filter("c", lambda x: (x["w"] > F.col("a.w")) | ((x["w"] == F.col("a.w")) & (x["r"] >= F.col("a.r")))))
    none = F.array(F.lit(None).cast("struct<w:string,r:string,d:bigint>"))
    probes = one.select("word", "n", "a", F.explode(F.concat(none, F.coalesce(second, F.array().cast("array<struct<w:string,r:string,d:bigint>>")))).alias("b"), "g")
    probes = probes.select("word", "n", "a", "b", (F.col("g") + F.col("a.d") + F.coalesce("b.d", F.lit(0))).alias("h"))
    near = probes.join(frequent, "h").where(F.col("n") <= RARE_SHARE * F.col("m"))

    def put(text: Column, c: Column) -> Column:
        """All texts in which one place of the change is put right."""
        size = F.length(c["w"])
        spots = F.filter(F.sequence(F.lit(1), F.length(text)), lambda k: F.substring(text, k, size) == c["w"])
        return F.transform(spots, lambda k: F.concat(F.substring(text, F.lit(1), k - 1), c["r"], F.substring(text, k + size, F.length(text))))

    first = put(F.col("word"), F.col("a"))
    second = F.flatten(F.transform(first, lambda t: F.when(F.contains(t, F.col("b.w")), put(t, F.col("b"))).otherwise(F.array().cast("array<string>"))))
    right = F.when(F.col("b").isNull(), F.array_contains(first, F.col("variant"))).otherwise(F.array_contains(second, F.col("variant")))
    changed = F.when(F.col("b").isNull(), 1).otherwise(2)
    verified = near.where(right)
    best = F.max(F.struct("m", (-changed).alias("c"), "variant"))
    return verified.groupBy("word").agg(best.alias("x")).select("word", F.col("x.variant").alias("variant"))


def noisy_places(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_table, item_id, line_no, word, variant, hyphened) of the misread words of each line and of its break, where word is null.

    One pass over the lines: their words, and a break as one more, meet the few words and breaks that are noise.
    """
    wrong = misread_words(lines, counts).select("word", "variant", F.lit(None).cast("boolean").alias("hyphened"))
    breaks = broken_words(counts).where("goes_on").select("word", F.lit(None).cast("string").alias("variant"), "hyphened")
    # a word as an expression: what is known of these words (their letters and changes) is not to be tested again on every word of the lines
    noise = cut(wrong.unionByName(breaks)).withColumn("word", F.concat_ws("", "word"))
    if noise.count() <= BROADCAST_WORDS:
        noise = F.broadcast(noise)
    spots = lines.select("item_table", "item_id", "line_no", F.explode(F.concat(_line_words(F.col("line")), _break())).alias("word"))
    return spots.join(noise, "word").withColumn("word", F.when(F.col("hyphened").isNull(), F.col("word")))


#: Bits of the kinds of noise.
KINDS = ("hyphen", "misread", "header", "page_number")


def noisy_lines(pages: DataFrame, slides: DataFrame) -> DataFrame:
    """(item_table, item_id, line_no, noise), each once; a header or page number has no other entry.

    Null, empty and blank texts and lines give none; repeated items give their lines once.
    """
    items = pages.unionByName(slides)
    lines = _lines(items)
    keys = ["item_table", "item_id", "line_no"]
    inner = noisy_places(lines, _word_counts(lines)).select(*keys, F.when(F.col("word").isNull(), 1).otherwise(2).alias("kind"))
    edges = edge_lines(items).select(*keys, F.when(F.col("noise") == "header", 4).otherwise(8).alias("kind"))
    # only lines with noise are shuffled, as numbers; an edge line wins over what else it has
    found = inner.unionByName(edges).groupBy(*keys).agg(F.bit_or("kind").alias("kinds"))
    won = F.when(F.col("kinds") >= 4, F.col("kinds").bitwiseAND(12)).otherwise(F.col("kinds"))
    named = F.array_compact(F.array(*[F.when(won.bitwiseAND(1 << k) > 0, F.lit(n)) for k, n in enumerate(KINDS)]))
    return found.select(*keys, F.explode(named).alias("noise"))


def repaired(pages: DataFrame, slides: DataFrame) -> DataFrame:
    """(item_table, item_id, text): each item as paragraphs, one a line, without edge lines, with broken and misread words put right.

    A compound that is broken at its own hyphen keeps it. Blank lines part paragraphs. An item of noise only has the empty text.
    """
    items = pages.unionByName(slides)
    lines = _lines(items)
    item, keys = ["item_table", "item_id"], ["item_table", "item_id", "line_no"]
    none = F.array().cast("array<struct<word:string,variant:string>>")
    places = noisy_places(lines, _word_counts(lines)).groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("word").isNotNull(), F.struct("word", "variant")))).alias("fixes"), F.bool_or("hyphened").alias("hyphened"), F.lit(False).alias("edge")
    )
    edges = edge_lines(items).select(*keys).distinct().select(*keys, none.alias("fixes"), F.lit(None).cast("boolean").alias("hyphened"), F.lit(True).alias("edge"))
    # what is known of an item's lines comes to the item, so each text is shuffled once; the lists are no longer than the text
    known = places.unionByName(edges).groupBy(*item).agg(F.collect_set(F.when(F.col("edge"), F.col("line_no"))).alias("edges"), F.collect_list(F.when(~F.col("edge"), F.struct("line_no", F.struct("hyphened", "fixes")))).alias("noise"))
    known = known.select(*item, "edges", F.map_from_entries("noise").alias("noise"))
    full = items.select(*item, "lines").dropDuplicates(item).join(known, item, "left")

    def put(text: Column, x: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), x["word"], F.lit(r"\E(?![\p{L}\p{N}])"))
        return F.regexp_replace(text, pattern, x["variant"])

    def mended(raw: Column, at: Column) -> Column:
        number = (at + 1).cast("bigint")
        noise = F.try_element_at("noise", number)
        line = _bare(raw)
        broken = F.concat(F.regexp_replace(line, rf"[{HYPHENS}]\s*$", ""), F.when(noise["hyphened"], "-").otherwise(""))
        whole = F.concat(F.regexp_replace(F.trim(line), r"(?U)\s+", " "), F.lit(" "))
        s = F.when(noise["hyphened"].isNotNull(), broken).otherwise(whole)
        return F.when(F.coalesce(F.array_contains("edges", number), F.lit(False)), "").when(F.trim(line) == "", "\n").otherwise(F.aggregate(F.coalesce(noise["fixes"], none), s, put))

    text = F.array_join(F.transform("lines", mended), "")
    return full.select(*item, F.trim(F.regexp_replace(F.regexp_replace(text, " *\n[ \n]*", "\n"), "^\n|[ \n]+$", "")).alias("text"))
