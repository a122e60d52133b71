"""Passages of held-out items inside a corpus, by an FM-index of each corpus shard.

A shard holds the runs of words that could hold a passage: maximal runs of words that occur in the items at all, of at least
``LEAST`` words; a passage can lie nowhere else, so nothing is lost. Its suffixes are sorted by prefix doubling, the
Burrows-Wheeler transform goes into a wavelet matrix, and all distinct item phrases of ``LEAST`` words are searched backward at
once, as arrays. Occurrences are located by walking to sampled suffix positions, and windows that touch are merged into spans.
Shards never meet; only found spans are shuffled, to merge those of one passage that a long document has in two shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST = 13
#: Words of a shard, words of a block of items (its phrases take LEAST * 4 bytes a word), blocks that one scan of the documents looks
#: for, and the distance of sampled positions.
SHARD_WORDS, ITEM_WORDS, BLOCKS_A_SCAN, SAMPLE = 1 << 18, 1 << 18, 4, 16
_WORD = re.compile(r"[^\W_]+")


def text_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            ones = (symbols >> bit) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(symbols) - int(before[-1])
            self.levels.append((bit, before, zeros))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i symbols are c, for arrays of c and i."""
        low = np.zeros_like(i)
        for bit, before, zeros in self.levels:
            one = (c >> bit) & 1 == 1
            low = np.where(one, zeros + before[low], low - before[low])
            i = np.where(one, zeros + before[i], i - before[i])
        return i - low

    def at(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for _, before, zeros in self.levels:
            one = before[i + 1] - before[i]
            c = c * 2 + one
            i = np.where(one == 1, zeros + before[i], i - before[i])
        return c


class FMIndex:
    """Of an array of symbols in which 0 ends each run and every other symbol is at least 1."""

    def __init__(self, symbols: np.ndarray, size: int):
        n = len(symbols)
        ends = symbols == 0
        # the ends differ from each other, so no two suffixes agree beyond the end of a run
        rank = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum())).astype(np.int64)
        order, k = np.argsort(rank, kind="stable"), 1
        while True:
            ordered = rank[order]
            if k == 1:
                new = ordered[1:] != ordered[:-1]
            else:
                new = key[order][1:] != key[order][:-1]
            dense = np.empty(n, np.int64)
            dense[order] = np.concatenate([[0], np.cumsum(new)])
            rank = dense
            if n == 0 or int(rank[order[-1]]) == n - 1:
                break
            follow = np.zeros(n, np.int64)
            follow[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (n + 2) + follow
            order, k = np.argsort(key, kind="stable"), 2 * k
        self.n, self.size = n, size
        bwt = symbols[order - 1]  # the symbol before the first suffix is the last one, which ends a run
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))]).astype(np.int64)
        self.wave = WaveletMatrix(bwt.astype(np.int64), size)
        first = np.concatenate([[True], ends[:-1]])
        self.sampled = ((np.arange(n) % SAMPLE == 0) | first)[order]
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled].astype(np.int64)

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the sorted suffixes that begin with each phrase (a row of ``phrases``)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for j in reversed(range(phrases.shape[1])):
            c = phrases[alive, j]
            low[alive] = self.starts[c] + self.wave.rank(c, low[alive])
            high[alive] = self.starts[c] + self.wave.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.where(low < high, high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            hit = self.sampled[rows[left]]
            done = left[hit]
            out[done] = self.positions[self.sampled_before[rows[done]]] + steps
            left = left[~hit]
            if len(left):
                c = self.wave.at(rows[left])
                rows[left] = self.starts[c] + self.wave.rank(c, rows[left])
            steps += 1
        return out


class Phrases:
    """All windows of LEAST words of some items: distinct rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.number: dict[str, int] = {}
        of: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            nums = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            for k in range(len(nums) - LEAST + 1):
                of.setdefault(tuple(nums[k : k + LEAST]), set()).add(item)
        self.table = np.array(list(of) or np.zeros((0, LEAST)), np.int32).reshape(-1, LEAST)
        self.items = [sorted(x) for x in of.values()]
        self.size = len(self.number) + 1

    def runs(self, words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(place, numbers) of each run of known words that is long enough, in parts that overlap where it is very long."""
        get = self.number.get
        nums = np.array([get(w, 0) for w in words], np.int64)
        if len(nums) < LEAST:
            return
        cuts = np.flatnonzero(np.diff(np.concatenate([[0], nums != 0, [0]])))
        for a, b in zip(cuts[::2], cuts[1::2]):
            if b - a >= LEAST:
                for k in range(a, b - LEAST + 1, SHARD_WORDS // 2):
                    yield k, nums[k : min(b, k + SHARD_WORDS // 2 + LEAST - 1)]

    def hits(self, shard: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, int]]:
        """(document, item, place of the window) for the runs (document, place, numbers) of a shard."""
        if not shard or not len(self.table):
            return
        parts = [x for _, _, run in shard for x in (run, [0])]
        index = FMIndex(np.concatenate(parts).astype(np.int64), self.size)
        low, high = index.ranges(self.table)
        found = np.flatnonzero(low < high)
        counts = high[found] - low[found]
        which = np.repeat(found, counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[found], counts)
        places = index.locate(rows)
        begins = np.cumsum([0] + [len(run) + 1 for _, _, run in shard])[:-1]
        owner = np.searchsorted(begins, places, side="right") - 1
        for p, o, at in zip(which.tolist(), owner.tolist(), places.tolist()):
            doc, place, _ = shard[o]
            for item in self.items[p]:
                yield doc, item, int(place + at - begins[o])


def _spans(places: list[int]) -> list[tuple[int, int]]:
    """[start, end) of the windows at ``places``, those that touch or overlap merged."""
    out: list[list[int]] = []
    for p in sorted(set(places)):
        if out and p <= out[-1][1]:
            out[-1][1] = p + LEAST
        else:
            out.append([p, p + LEAST])
    return [(a, b) for a, b in out]


class _Shard:
    """The runs of some documents that one block of items may occur in, up to SHARD_WORDS of them."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.runs, self.keys, self.total = phrases, [], [], 0

    def add(self, key: int, words: list[str]) -> Iterator[list[tuple[int, int, int, int]]]:
        for k, (place, run) in enumerate(self.phrases.runs(words)):
            if not k or not self.keys:
                self.keys.append(key)
            self.runs.append((len(self.keys) - 1, place, run))
            self.total += len(run) + 1
            if self.total >= SHARD_WORDS:
                yield self.flush()

    def flush(self) -> list[tuple[int, int, int, int]]:
        """(document, item, start, end) of the spans of the shard, which is then empty."""
        at: dict[tuple[int, int], list[int]] = {}
        for d, item, place in self.phrases.hits(self.runs):
            at.setdefault((d, item), []).append(place)
        found = [(self.keys[d], item, a, b) for (d, item), places in at.items() for a, b in _spans(places)]
        self.runs, self.keys, self.total = [], [], 0
        return found


def _search(blocks: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [_Shard(b.value) for b in blocks]

        def spans() -> Iterator[list[tuple[int, int, int, int]]]:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    words = text_words(text.as_py())
                    for shard in shards:
                        yield from shard.add(key, words)
            for shard in shards:
                yield shard.flush()

        for found in spans():
            if found:
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start_word", "end_word"])

    return run


def item_blocks(items: DataFrame, key: str, column: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The held-out items in blocks of at most ITEM_WORDS words (one longer item is a block), read row by row."""
    block, n = [], 0
    for r in items.select(F.col(key).alias("k"), F.col(column).alias("t")).where("k IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        words = text_words(r["t"])
        if len(words) < LEAST:
            continue
        if block and n + len(words) > ITEM_WORDS:
            yield block
            block, n = [], 0
        block.append((r["k"], words))
        n += len(words)
    if block:
        yield block


def leaked_spans(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, end_word): the merged spans of each document that repeat LEAST or more consecutive words of an item.

    Words are maximal runs of letters and digits, lower-cased; places count words from 0. Null, empty and short texts give no row,
    neither do null keys of items; repeated document rows give their spans once. The items reach the executors in blocks of
    a fixed size; BLOCKS_A_SCAN of them are searched in one scan of all documents.
    """
    found = _found_spans(docs, items, doc_key, text, item_key, item_text)
    # spans of one passage may come from two shards; a document has few spans of an item, so these groups are small
    order = W.partitionBy("doc_id", "item_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = found.withColumn("fresh", (F.col("start_word") > F.coalesce(before, F.lit(-1))).cast("int"))
    merged = marked.withColumn("span", F.sum("fresh").over(order)).groupBy("doc_id", "item_id", "span").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    return merged.select("doc_id", "item_id", "start_word", "end_word")


def _found_spans(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    spark: SparkSession = docs.sparkSession
    kind = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint"
    read = docs.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out, blocks = spark.createDataFrame([], kind), item_blocks(items, item_key, item_text)
    while some := [spark.sparkContext.broadcast(Phrases(b)) for b in islice(blocks, BLOCKS_A_SCAN)]:  # of ITEM_WORDS words each
        out = out.unionByName(read.mapInArrow(_search(some), kind))
    return out


def leaked_pairs(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """(doc_id, item_id), once each, for the items that a document leaks."""
    return _found_spans(docs, items, **names).select("doc_id", "item_id").distinct()
