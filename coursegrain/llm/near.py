"""Near-duplicate records with small edits, by the generalised pigeonhole principle over word bits.

A record is the set of its words, seen as a vector of bits. For sets of a and b words, a Jaccard similarity of t or more means a
Hamming distance of at most (1 - t) / (1 + t) * (a + b). The bits are divided into partitions; with thresholds t_i >= -1 whose
sum of (t_i + 1) is the distance + 1, two records within the distance have some partition within its t_i of each other.

* Correlated bits go together: words that are frequent and occur with each other (the words of sentence patterns) share partition
  0, so that the other partitions, over which the remaining words are hashed, hold the bits that tell records apart. Only the
  speed depends on this.
* Thresholds are unequal and chosen for each record by dynamic programming over the candidates that each partition would give,
  from the measured share of every frequent key, else estimated from the share of records that hold each word. t_i = -1 skips a partition, 0 probes its exact bits, 1 also those
  with one word more or less. Sets too large for four partitions of t_i <= 1 use 8, 16, 32 ... of them.
* Frequent keys are known before any record asks: each task counts its own keys and tells those that reach half of HEAVY_SHARE in it,
  so every key of that share is told by some task. A record whose key is frequent is thus planned on its other partitions; what
  still asks on a frequent key does so apart, against blocks of the records that hold it.
* Candidates share a key and pass a 64-bit parity sketch whose distance never exceeds the true one; survivors are verified on
  their words.

Equal sets become one class before that and are expanded at the end in blocks, within a class and between near classes, so that all
copies of one text never meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursegrain.functions.text import words
from coursegrain.sources.tables import stored

SIMILARITY, MIN_WORDS = 0.75, 6
#: Shares of records from which a word's own share is known, and from which it may be a correlated bit, and the most words that
#: the driver and the executors hold for either (the most frequent). They steer which keys are probed; the pairs found are the
#: same without them.
KNOWN_SHARE, FREQUENT_SHARE = 0.001, 0.02
KNOWN_WORDS, FREQUENT_WORDS = 20_000, 400
CORRELATED = 0.1
#: Content partitions of the smallest sets.
PARTITIONS = 4
#: A key that more than this share of records holds is frequent: it is avoided, and probed apart by those records alone that need it. There
#: are at most (keys of a record) / HEAVY_SHARE * 2 of them, which is what driver and executors hold.
HEAVY_SHARE = 2.5e-4
#: Keys that a task holds while it counts; beyond it the rarest go, each count losing as much as the largest that went.
HELD_KEYS = 1 << 22
#: Members of one class that meet in one task, and records of one frequent key.
BLOCK, KEY_BLOCK = 1000, 4096


def records(df: DataFrame, name: str, key: str, text: str) -> DataFrame:
    """(tab, id, k): the sorted distinct words of each text of MIN_WORDS or more of them, as one string."""
    w = F.array_sort(F.array_distinct(words(text)))
    return df.select(F.lit(name).alias("tab"), F.col(key).cast("bigint").alias("id"), w.alias("w")).where(f"size(w) >= {MIN_WORDS} AND id IS NOT NULL").select("tab", "id", F.array_join("w", " ").alias("k"))


def _hashes() -> F.Column:
    return F.transform(F.split("k", " "), lambda x: F.xxhash64(x))


class Shares:
    """Known shares of words, the correlated ones among them, and the frequent keys: what the executors need to plan."""

    def __init__(self, known: dict[int, int], n: int, correlated: set[int]):
        self.n = n
        self.heavy, self.heavy_shares = np.zeros(0, np.int64), np.zeros(0)
        self.words = np.array(sorted(known), np.int64)
        self.logs = np.log(np.array([known[w] for w in sorted(known)], np.float64) / max(1, n))
        self.correlated = np.array(sorted(correlated), np.int64)

    def log_share(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), math.log(KNOWN_SHARE / 4))
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            out = np.where(self.words[at] == h, self.logs[at], out)
        return out

    def with_heavy(self, counts: dict[int, int]) -> Shares:
        self.heavy = np.array(sorted(counts), np.int64)
        self.heavy_shares = np.array([counts[k] for k in sorted(counts)], np.float64) / max(1, self.n)
        return self

    def key_share(self, keys: np.ndarray) -> np.ndarray:
        """The measured share of each frequent key, 0 for others."""
        if not len(self.heavy):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.heavy, keys), len(self.heavy) - 1)
        return np.where(self.heavy[at] == keys, self.heavy_shares[at], 0.0)

    def is_correlated(self, h: np.ndarray) -> np.ndarray:
        return np.isin(h, self.correlated)


def _batch_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.values.to_numpy(zero_copy_only=False).astype(np.int64)[offsets[0] : offsets[-1]]


def learn(reps: DataFrame) -> Shares:
    """Shares of words over all classes, and which frequent words are correlated (phi of CORRELATED or more with another)."""
    n = reps.count()
    counted = reps.select(F.explode(_hashes()).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, KNOWN_SHARE * n))
    # at most (words of a record) / KNOWN_SHARE of them
    known = {r["h"]: r["n"] for r in sorted(counted.collect(), key=lambda r: (-r["n"], r["h"]))[:KNOWN_WORDS]}
    frequent = np.array(sorted(sorted((h for h, c in known.items() if c >= FREQUENT_SHARE * n), key=lambda h: (-known[h], h))[:FREQUENT_WORDS]), np.int64)
    correlated: set[int] = set()
    if len(frequent) > 1:

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = np.zeros((len(frequent), len(frequent)))
            for batch in batches:
                offsets, h = _batch_lists(batch.column(0))
                rec = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                hit = frequent[at] == h
                x = np.zeros((len(offsets) - 1, len(frequent)), np.float32)
                x[rec[hit], at[hit]] = 1
                both += x.T @ x
            i, j = np.nonzero(np.triu(both, 1))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both[i, j].astype(np.int64))], ["i", "j", "n"])

        pairs = reps.select(_hashes().alias("h")).mapInArrow(together, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
        for r in pairs:
            a, b = known[int(frequent[r["i"]])], known[int(frequent[r["j"]])]
            spread = math.sqrt(a * (n - a) * b * (n - b))
            if spread and (n * r["n"] - a * b) / spread >= CORRELATED:
                correlated |= {int(frequent[r["i"]]), int(frequent[r["j"]])}
            elif not spread:  # in every record: tells nothing apart
                correlated |= {int(frequent[r[x]]) for x, c in (("i", a), ("j", b)) if c == n}
    return Shares(known, n, correlated)


def _most(a: np.ndarray) -> np.ndarray:
    """The largest distance that a record of a words probes for: that of an equally large partner."""
    return np.floor((1 - SIMILARITY) / (1 + SIMILARITY) * 2 * a + 1e-9).astype(np.int64)


def _level(most: np.ndarray) -> np.ndarray:
    """Content partitions: the least of 4, 8, 16 ... that, with t_i <= 1 each and 0 for partition 0, reach most + 1."""
    c = np.full(len(most), PARTITIONS, np.int64)
    while (low := 2 * c < most).any():
        c = np.where(low, 2 * c, c)
    return c


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def thresholds(exact: np.ndarray, loose: np.ndarray, need: np.ndarray) -> np.ndarray:
    """t_i in {-1, 0, 1} for each record and partition, of least total cost with a sum of (t_i + 1) of at least ``need``.

    ``exact`` and ``loose`` are the costs of t_i = 0 and 1, an infinite one rules it out.
    """
    n, parts = exact.shape
    top = int(need.max(initial=0))
    best = np.full((n, top + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((parts, n, top + 1), np.int8)
    less = lambda k: np.maximum(np.arange(top + 1) - k, 0)
    for i in range(parts):
        options = np.stack([best, best[:, less(1)] + exact[:, i : i + 1], best[:, less(2)] + loose[:, i : i + 1]])
        choice[i] = options.argmin(0)
        best = options.min(0)
    out, left, rows = np.full((n, parts), -1, np.int8), need.copy(), np.arange(n)
    for i in reversed(range(parts)):
        c = choice[i, rows, left]
        out[:, i] = c - 1
        left = np.maximum(left - c, 0)
    return out


#: What a key row is: bits of its meta number beside the size.
EXACT, LOOSE = 0, 1


def key_rows(ids: np.ndarray, tab: np.ndarray, offsets: np.ndarray, h: np.ndarray, shares: Shares) -> dict[str, np.ndarray]:
    """key, id, meta, sig (the parity sketch) and share (measured, 0 unless frequent) of every key of the records.

    meta, from the high bits down: the size, probe (2 bits), kind (1) and tab (4).
    probe is 0 for a key that only answers, 1 for one that asks for exact bits, 2 for one that also asks for a word more or less.
    """
    sizes = np.diff(offsets)
    n = len(sizes)
    logs, correlated, mixed = shares.log_share(h), shares.is_correlated(h), _mix(h)
    rec = np.repeat(np.arange(n), sizes)
    sig = np.bitwise_xor.reduceat(np.uint64(1) << (mixed >> np.uint64(58)), offsets[:-1]) if n else np.zeros(0, np.uint64)
    own = _level(_most(sizes))
    last = _level(_most(np.floor(sizes / SIMILARITY + 1e-9).astype(np.int64)))
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("key", "id", "meta", "sig", "share")}

    def add(key, r, probe, kind, share):
        out["key"].append(key)
        out["id"].append(ids[r])
        out["meta"].append(((sizes[r] << 2 | probe) << 1 | kind) << 4 | tab[r])
        out["sig"].append(sig[r].view(np.int64))
        out["share"].append(share)

    for c in sorted({*own.tolist(), *last.tolist()}):
        chosen = np.flatnonzero((own == c) | (last == c))
        step = max(1, 2_000_000 // ((c + 1) * (2 * c + 3)))
        for k in range(0, len(chosen), step):
            some = chosen[k : k + step]
            place = np.full(n, -1, np.int64)
            place[some] = np.arange(len(some))
            at = np.flatnonzero(place[rec] >= 0)
            r, hm, lg = place[rec[at]], mixed[at], logs[at]
            part = np.where(correlated[at], 0, 1 + (_mix(hm + np.uint64(c)) % np.uint64(c)).astype(np.int64))
            cells = len(some) * (c + 1)
            cell = r * (c + 1) + part
            order = np.argsort(cell, kind="stable")
            count = np.bincount(cell, minlength=cells)
            begins = (np.cumsum(count) - count)[count > 0]
            total = np.zeros(cells, np.uint64)
            if len(begins):
                total[count > 0] = np.add.reduceat(hm[order], begins)
            sumlog = np.bincount(cell, weights=lg, minlength=cells)
            # of the record alone, not of its batch: every pass over the records must plan each of them alike
            per = count.reshape(-1, c + 1)
            mean = np.concatenate([per[:, :1], np.repeat(per[:, 1:].sum(1, keepdims=True) / c, c, axis=1)], axis=1)
            salt = _mix((np.uint64(c) << np.uint64(32)) + np.arange(c + 1, dtype=np.uint64) * np.uint64(2))
            salts = (salt[None, :] + tab[some].astype(np.uint64)[:, None]).reshape(-1)
            whole = _mix(total + salts).view(np.int64)
            d = np.flatnonzero(part > 0)
            less = _mix(total[cell[d]] - hm[d] + salts[cell[d]]).view(np.int64)
            of_whole, of_less = shares.key_share(whole), shares.key_share(less)
            chance = np.exp(np.maximum(sumlog, -600) - mean.reshape(-1))
            # a key that is not known as frequent has at most HEAVY_SHARE, whatever its words promise
            exact = np.where(of_whole > 0, of_whole, np.minimum(chance, HEAVY_SHARE))
            each = np.where(of_less > 0, of_less, np.minimum(chance[cell[d]] * np.exp(-lg[d]), HEAVY_SHARE))
            loose = (exact * (1 + mean.reshape(-1)) + np.bincount(cell[d], weights=each, minlength=cells)).reshape(-1, c + 1)
            exact = exact.reshape(-1, c + 1)
            loose[:, 0] = np.inf
            t = thresholds(exact + 1e-12, loose + 2e-12, _most(sizes[some]) + 1)
            t[own[some] != c] = -1  # these only answer larger records at this level
            ask = (t + 1).reshape(-1).astype(np.int64)
            add(whole, np.repeat(some, c + 1), ask, EXACT, of_whole)
            add(less, some[r[d]], np.where(ask[cell[d]] == 2, 2, 0), LOOSE, of_less)
    kinds = {"key": np.int64, "id": np.int64, "meta": np.int64, "sig": np.int64, "share": np.float64}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in out.items()}


def _planned(reps: DataFrame, names: list[str]) -> DataFrame:
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("tab")) - 1
    return reps.select("rep", number.alias("tab"), _hashes().alias("h"))


def _rows_of(batches: Iterator[pa.RecordBatch], shares: Shares) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            offsets, h = _batch_lists(batch.column(2))
            yield key_rows(batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), offsets, h, shares)


def heavy_keys(reps: DataFrame, names: list[str], shares: Shares) -> dict[int, int]:
    """Every key that HEAVY_SHARE of the records hold or more, and none that less than half of it do, with its records."""
    known = reps.sparkSession.sparkContext.broadcast(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, lost, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        parts, held = [], 0

        def merged():
            k, at = np.unique(np.concatenate([keys, *parts]), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([counts, *[np.ones(len(p)) for p in parts]]), minlength=len(k)).astype(np.int64)
            gone = 0
            if len(k) > HELD_KEYS // 2:
                gone = int(np.partition(c, -HELD_KEYS // 2)[-HELD_KEYS // 2])
                k, c = k[c > gone], c[c > gone] - gone
            return k, c, gone

        def counted(source):
            nonlocal seen
            for batch in source:
                seen += batch.num_rows
                yield batch

        for rows in _rows_of(counted(batches), known.value):
            parts.append(rows["key"])
            held += len(rows["key"])
            if held > HELD_KEYS:
                keys, counts, gone = merged()
                lost, parts, held = lost + gone, [], 0
        keys, counts, gone = merged()
        lost += gone
        told = counts + lost >= max(2, HEAVY_SHARE / 2 * seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys[told], pa.int64()), pa.array(counts[told] + lost, pa.int64())], ["key", "n"])

    told = _planned(reps, names).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2.0, HEAVY_SHARE / 2 * shares.n))
    return {r["key"]: r["n"] for r in told.collect()}


def _keys(reps: DataFrame, shares: Shares, names: list[str], heavy: bool, asking: bool = False) -> DataFrame:
    """key, id, meta, sig of the keys that are frequent, or of the others; the blocks of a frequent key are keys of their own.

    A record answers in one block of the key and asks in all of them.
    """
    known = reps.sparkSession.sparkContext.broadcast(shares)  # bounded by KNOWN_WORDS and HEAVY_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows_of(batches, known.value):
            keep = (rows["share"] > 0) == heavy
            if asking:
                keep &= (rows["meta"] >> 5 & 3) > 0
            some = {k: rows[k][keep] for k in ("key", "id", "meta", "sig")}
            if heavy:
                blocks = np.ceil(rows["share"][keep] * known.value.n / KEY_BLOCK).astype(np.int64)
                if asking:
                    at = np.repeat(np.arange(len(blocks)), blocks)
                    some = {k: v[at] for k, v in some.items()}
                    block = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                else:
                    block = (_mix(some["id"].view(np.uint64)) >> np.uint64(1)).astype(np.int64) % np.maximum(blocks, 1)
                some["key"] = _mix(some["key"].view(np.uint64) + block.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(some[k], pa.int64()) for k in ("key", "id", "meta", "sig")], ["key", "id", "meta", "sig"])

    return _planned(reps, names).mapInArrow(run, "key bigint, id bigint, meta bigint, sig bigint")


def _candidates(asking: DataFrame, answering: DataFrame) -> DataFrame:
    """(tab, a, b) of records that share a key as the asking one's thresholds want it, and pass the sketch; a may exceed b."""
    l, r = asking.alias("l"), answering.alias("r")
    field = lambda x: tuple(F.expr(e) for e in (f"shiftright({x}.meta, 7)", f"shiftright({x}.meta, 5) & 3", f"shiftright({x}.meta, 4) & 1", f"{x}.meta & 15"))
    (la, lp, lk, lt), (rb, _, rk, rt) = field("l"), field("r")
    fits = (
        (lp > 0) & (lt == rt) & ((lk == EXACT) | (rk == EXACT)) & ((lp == 2) | (rk == EXACT))
        & ((la > rb) | ((la == rb) & (F.col("l.id") < F.col("r.id")))) & (rb >= SIMILARITY * la)
    )
    near = F.expr("bit_count(l.sig ^ r.sig)") * (1 + SIMILARITY) <= (1 - SIMILARITY) * (la + rb)
    # one condition on both sides, so that nothing of it moves below the exchange that the two sides share; the sketch comes first
    return l.join(r, (F.col("l.key") == F.col("r.key")) & F.when(near, fits).otherwise(False)).select(lt.alias("tab"), F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def classes(recs: DataFrame) -> DataFrame:
    """(tab, k, rep, n): each distinct word set, its smallest id and its number of records."""
    return recs.groupBy("tab", "k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))


def near_classes(reps: DataFrame, names: list[str], shares: Shares) -> DataFrame:
    """(tab, a, b, na, nb), a < b: the smallest ids of classes of different word sets that are near, and their records."""
    fine = _keys(reps, shares, names, False)
    found = _candidates(fine, fine).unionByName(_candidates(_keys(reps, shares, names, True, asking=True), _keys(reps, shares, names, True))).distinct()
    table = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("tab") + 1).cast("int"))
    named = found.select(table.alias("tab"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    side = lambda x: reps.select("tab", F.col("rep").alias(x), F.col("k").alias(f"k{x}"), F.col("n").alias(f"n{x}"))
    # strings are shuffled, and split only after the joins
    both = named.join(side("a"), ["tab", "a"]).join(side("b"), ["tab", "b"]).withColumn("wa", F.split("ka", " ")).withColumn("wb", F.split("kb", " "))
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.where(shared >= SIMILARITY * (F.size("wa") + F.size("wb") - shared)).select("tab", "a", "b", "na", "nb")


def learned(reps: DataFrame, names: list[str]) -> Shares:
    shares = learn(reps)
    return shares.with_heavy(heavy_keys(reps, names, shares))


def near_pairs(recs: DataFrame, names: list[str]) -> DataFrame:
    """(tab, id_a, id_b), id_a < id_b: all pairs of records of one table whose word sets are near or equal.

    Records of fewer than MIN_WORDS distinct words, and null texts, are in no pair. Rows repeated with the same id make no pair
    with themselves, and no pair comes twice.
    """
    reps = stored(classes(recs))
    copies = reps.where("n > 1").select("tab", "k", "rep", "n")
    digest = [F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2")]
    members = recs.select("tab", "id", *digest).join(copies.select("tab", *digest, "rep", "n"), ["tab", "h1", "h2"]).select("tab", "rep", "n", "id").distinct()
    # blocks of members meet each other, within a class and between two; a class of one block is one group
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    mine = members.withColumn("blocks", blocks("n")).withColumn("m", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    near = near_classes(reps, names, learned(reps, names))
    parts = near.withColumn("i", F.explode(F.sequence(F.lit(0), blocks("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), blocks("nb") - 1)))
    left = mine.select("tab", F.col("rep").alias("a"), F.col("m").alias("i"), F.col("id").alias("x"))
    right = mine.select("tab", F.col("rep").alias("b"), F.col("m").alias("j"), F.col("id").alias("y"))
    # a class of one record has no members here, and is its own; a block of a larger one may be empty
    met = parts.join(left, ["tab", "a", "i"], "left").where("na = 1 OR x IS NOT NULL").join(right, ["tab", "b", "j"], "left").where("nb = 1 OR y IS NOT NULL")
    across = met.select("tab", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    one = mine.select("tab", "rep", F.col("m").alias("i"), F.explode(F.expr("sequence(m, blocks - 1)")).alias("j"), F.col("id").alias("x"))
    other = mine.select("tab", "rep", F.explode(F.expr("sequence(0, m)")).alias("i"), F.col("m").alias("j"), F.col("id").alias("y"))
    within = one.join(other, ["tab", "rep", "i", "j"]).where("x <> y AND (i < j OR x < y)").select("tab", "x", "y")
    return across.unionByName(within).select("tab", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_groups(recs: DataFrame, names: list[str]) -> DataFrame:
    """(tab, id, class_id, links): each record, the smallest id with its word set, and the number of other near classes."""
    reps = stored(classes(recs))
    near = near_classes(reps, names, learned(reps, names))
    ends = near.select("tab", F.col("a").alias("rep")).unionAll(near.select("tab", F.col("b").alias("rep"))).groupBy("tab", "rep").agg(F.count(F.lit(1)).alias("links"))
    digest = [F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2")]
    of = reps.select("tab", *digest, "rep").join(ends, ["tab", "rep"], "left")
    return recs.select("tab", "id", *digest).join(of, ["tab", "h1", "h2"]).select("tab", "id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
