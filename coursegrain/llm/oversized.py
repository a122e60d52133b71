"""Splitting of oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 120
#: Places to cut, strongest first; a cut lies at the end of a match.
BOUNDARIES = (
    re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*"),  # between paragraphs
    re.compile(r"(?:\r\n?|\n)+\s*"),  # between lines
    re.compile(r"[.!?…][\"”»')\]]*\s+|[。！？]+[」』”]?\s*"),  # between sentences
    re.compile(r"[,;:][\"”»')\]]*\s+|\s[-–—]\s+|[、，；：]\s*"),  # between clauses
    re.compile(r"\s+"),  # between words
    re.compile(r"[\W_]+"),  # at a mark within a word
)


def _middle(places: list[int], low: int, high: int, mid: int) -> int | None:
    """The place in [low, high] nearest to mid, the first of two as near."""
    k = bisect_left(places, mid)
    near = [p for p in places[max(0, k - 1) : k + 1] if low <= p <= high]
    return min(near, key=lambda p: (abs(p - mid), p), default=None)


def bisect_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core_start, end) of the consecutive pieces of ``text``.

    The cores [core_start, end) follow each other without a gap and cover the text; each piece but the first starts ``overlap``
    characters before its core. A part is cut at the strongest boundary within a quarter of its length from its midpoint (the
    nearest of equals), else at the nearest boundary between words, or at a mark, anywhere in it, else in the middle, there never before
    a combining mark if that can be helped; halves longer than limit - overlap are cut again. A text within the limit is one piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    most = limit - overlap
    places = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    cores, stack = [], [(0, len(text))]
    while stack:
        a, b = stack.pop()
        if b - a <= most:
            cores.append((a, b))
            continue
        mid, wide = (a + b) // 2, (b - a) // 4
        cut = next((p for q in places if (p := _middle(q, max(a + 1, mid - wide), min(b - 1, mid + wide), mid)) is not None), None)
        if cut is None:
            cut = next((p for q in places[-2:] if (p := _middle(q, a + 1, b - 1, mid)) is not None), None)
        if cut is None:
            cut = mid
            while cut > a + 1 and cut > mid - 32 and unicodedata.combining(text[cut]):
                cut -= 1
        stack += [(cut, b), (a, cut)]  # the left half comes next
    return [(max(0, a - overlap) if k else a, a, b) for k, (a, b) in enumerate(cores)]


PIECES = "item_table string, item_id bigint, item_pos bigint, piece_no int, core_start int, start int, end int, text string"


def _pieces_of(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (t, i, p, k, c, a, b, text[a:b])
                for t, i, p, text in zip(batch["item_table"], batch["item_id"], batch["item_pos"], batch["text"])
                for k, (a, c, b) in enumerate(bisect_text(text, limit, overlap), 1)
            ]
            yield pd.DataFrame(rows, columns=["item_table", "item_id", "item_pos", "piece_no", "core_start", "start", "end", "text"])

    return run


def oversized_pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each text of more than ``limit`` characters (code points).

    ``items`` has item_table, item_id, item_pos and text; other columns are not read. Null, empty and small texts give no row;
    a repeated row gives its pieces each time. Only texts over the limit leave the JVM, and nothing is shuffled.
    """
    over = items.select("item_table", F.col("item_id").cast("bigint").alias("item_id"), F.col("item_pos").cast("bigint").alias("item_pos"), "text").where(F.length("text") > limit)
    return over.mapInPandas(_pieces_of(limit, overlap), PIECES)


def rejoined(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_table, item_id, item_pos, n_chars, digest, kept): each text from its pieces without their overlaps, by its MD5.

    ``kept``: no piece is longer than the limit, each holds what its places say, and each but the first begins ``overlap`` characters
    before the end of the one before it (with less only where that one begins the text). A repeated item counts once.
    """
    order = F.array_sort(F.collect_set(F.struct("piece_no", "start", "core_start", "end", "text")))
    one = pieces.groupBy("item_table", "item_id", "item_pos").agg(order.alias("p"))
    core = F.array_join(F.transform("p", lambda x: F.substring(x["text"], x["core_start"] - x["start"] + 1, x["end"] - x["core_start"])), "")
    sound = F.forall("p", lambda x: (F.length(x["text"]) == x["end"] - x["start"]) & (F.length(x["text"]) <= limit))
    # the pieces are numbered from 1, so the one before piece k stands at place k - 2 of the array
    follows = F.forall(F.filter("p", lambda x: x["piece_no"] > 1), lambda x: (F.get("p", x["piece_no"] - 2)["end"] == x["core_start"]) & (x["start"] == F.greatest(x["core_start"] - overlap, F.lit(0))))
    return one.select("item_table", "item_id", "item_pos", F.length(core).cast("bigint").alias("n_chars"), F.md5(core).alias("digest"), (sound & follows).alias("kept"))
