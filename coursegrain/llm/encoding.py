"""Encoding by byte-level BPE as a streaming transducer with bounded lookahead, and incremental decoding.

Applying merge rules in order to a text w and to w + v, let B be the right-most place up to which both have the same tokens. B
moves left by the length of x only when a rule (x, y) merges across it in one of the two, and the next such rule must come later
in the list and have a right side that begins with x (x lies on the left spine of its y). The longest chain of such rules, by
the bytes of their left sides, is therefore a *sufficient lookahead*: a token that ends that many bytes before the end of what
has been read is final, whatever follows. Tokenising again from a token's end gives the rest of the same tokens, as no merge
crossed it.

Every text is read block by block. A splitter gives out words, or the part of a long word that has come in, once nothing that
follows can change them, and holds the rest; the words run through the merges, where tokens are given out once they are stable.
So beside its ids a text of any length takes a block and a lookahead of memory.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: What parts a text before the merges; fixed by the vocabulary.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Words up to so many bytes are kept with their ids, and so many of them at most.
MEMO_BYTES, MEMO_WORDS = 48, 1 << 17
#: Characters of a text that are read at once.
BLOCK = 4096
#: Characters at the end of what has been read that may still change the words before them (a contraction has three).
OPEN = 3
#: How a word goes on that began in an earlier block, by its last character.
_GOES_ON = [regex.compile(x) for x in (r"\p{L}*", r"\p{N}*", r"\p{White_Space}*", r"[^\p{White_Space}\p{L}\p{N}]*")]


def split_words(blocks: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """(part, ends) of the words of a text that comes in blocks; a word that fits into a block comes in one part."""
    held, on = "", None  # on: the pattern of a word of which parts have been given out
    for block in blocks:
        held += block
        if on is not None:
            run = len(on.match(held)[0])
            if run > len(held) - OPEN:
                if run > OPEN:
                    yield held[: run - OPEN], False
                    held = held[run - OPEN :]
                continue
            # the last of white space goes with what follows
            run -= on is _GOES_ON[2]
            yield held[:run], True
            held, on = held[run:], None
        found, at = SPLIT.findall(held), len(held)
        while found and at > len(held) - OPEN:
            at -= len(found.pop())
        for word in found:
            yield word, True
        held = held[at:]
        if len(held) >= BLOCK:
            first = len(SPLIT.match(held)[0])
            if first >= max(len(held) - OPEN, OPEN + 2):  # more than a blank before a word
                yield held[: first - OPEN], False
                last = held[first - OPEN - 1]
                held = held[first - OPEN :]
                on = next(p for p in _GOES_ON if p.match(last)[0])
    if on is not None:
        run = len(on.match(held)[0])
        run -= on is _GOES_ON[2] and run < len(held)
        yield held[:run], True
        held = held[run:]
    for word in SPLIT.findall(held):
        yield word, True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _letters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable Latin-1 for itself, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        byte = _letters()
        self.bytes_of = {i: bytes(byte[c] for c in t) for t, i in vocabulary.items() if all(c in byte for c in t)}
        self.start = [0] * 256
        for c, b in byte.items():
            self.start[b] = vocabulary[c]
        self.rule = {(vocabulary[a], vocabulary[b]): (k, vocabulary[a + b]) for k, (a, b) in enumerate(merges)}
        self.lookahead = self._sufficient_lookahead([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges])
        self.memo: dict[str, tuple[int, ...]] = {}

    def _sufficient_lookahead(self, rules: list[tuple[int, int, int]]) -> int:
        known, left = set(self.start), {}
        for a, b, ab in rules:
            if a not in known or b not in known:
                raise ValueError("a rule uses a token that no earlier rule makes")
            known.add(ab)
            left.setdefault(ab, a)
        reach: dict[int, int] = {}  # token -> longest chain of later rules whose right side begins with it
        longest = 1
        for a, b, _ in reversed(rules):
            d = len(self.bytes_of[a]) + reach.get(a, 0)
            longest = max(longest, d)
            t: int | None = b
            while t is not None:
                if reach.get(t, 0) < d:
                    reach[t] = d
                t = left.get(t)
        return longest

    def _merged(self, data: bytes) -> list[int]:
        """The tokens of one word by its lowest rule first, leftmost first."""
        ids = [self.start[b] for b in data]
        rule = self.rule
        if len(ids) <= 40:
            while len(ids) > 1:
                best = min((rule.get(p, (1 << 30, 0))[0], k) for k, p in enumerate(zip(ids, ids[1:])))
                if best[0] == 1 << 30:
                    break
                k = best[1]
                ids[k : k + 2] = [rule[ids[k], ids[k + 1]][1]]
            return ids
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rule[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in rule]
        heapq.heapify(heap)
        while heap:
            _, k, p = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or (ids[k], ids[j]) != p:
                continue
            ids[k], alive[j], after[k] = rule[p][1], False, after[j]
            if after[k] < n:
                before[after[k]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] < n and (q := (ids[i], ids[after[i]])) in rule:
                    heapq.heappush(heap, (rule[q][0], i, q))
        return [x for x, a in zip(ids, alive) if a]

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one word that arrives in blocks; each is given out as soon as nothing to come can change it."""
        held = b""
        for block in blocks:
            held += block
            if len(held) <= 2 * self.lookahead:
                continue
            end, done = len(held) - self.lookahead, 0
            for t in self._merged(held):
                if done + len(self.bytes_of[t]) > end:
                    break
                done += len(self.bytes_of[t])
                yield t
            held = held[done:]
        yield from self._merged(held)

    def words(self, parts: Iterator[tuple[str, bool]]) -> Iterator[tuple[int, ...]]:
        """The ids of each word, or of what is stable of it so far. Words in one part are remembered."""
        memo = self.memo
        for part, ends in parts:
            if ends:
                ids = memo.get(part)
                if ids is None:
                    ids = tuple(self.stream((part.encode(),)))
                    if len(part) <= MEMO_BYTES:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        memo[part] = ids
                yield ids
                continue

            def rest(first: str = part) -> Iterator[bytes]:
                yield first.encode()
                for more, last in parts:
                    yield more.encode()
                    if last:
                        return

            yield from ((t,) for t in self.stream(rest()))

    def encode(self, text: str | None) -> array:
        out = array("i")
        if text:
            for ids in self.words(split_words(text[k : k + BLOCK] for k in range(0, len(text), BLOCK))):
                out.extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, by a UTF-8 state machine that is fed one token at a time; broken bytes become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        return "".join(machine.decode(self.bytes_of.get(i, b"")) for i in ids) + machine.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return Transducer(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])


def encoded(docs: DataFrame, key: str, column: str, vocabulary: str | None = None, name: str = "ids") -> DataFrame:
    """(key, ids): every row's text as token ids without special tokens; null and empty texts have the empty list.

    One narrow pass, no shuffle. Special tokens' strings in a text are ordinary text. ``vocabulary`` is the path of the
    vocabulary file on the executors. Repeated rows are encoded each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary or default_vocabulary())
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column(1):
                flat.extend(t.encode(text.as_py()))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, name])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, column).mapInArrow(run, f"`{key}` {kind}, `{name}` array<int>")


def decoded(ids: DataFrame, key: str, column: str, vocabulary: str | None = None, name: str = "text") -> DataFrame:
    """(key, text) of token ids; null gives null, ids outside the vocabulary are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary or default_vocabulary())
        for batch in batches:
            texts = [None if x is None else t.decode(i for i in x if i is not None) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, name])

    kind = ids.schema[key].dataType.simpleString()
    return ids.select(key, column).mapInArrow(run, f"`{key}` {kind}, `{name}` string")
