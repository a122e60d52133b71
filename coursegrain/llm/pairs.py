"""Defective question and answer pairs, each with the kind of its defect.

Copies are measured by running an answer through the suffix automaton of its question; refusals by an Aho-Corasick automaton of
refusal phrases; other languages by votes of stop words and scripts; breaks by a stack of open delimiters, by what the text ends
with, and by the words of the whole table: an answer without a final mark is broken off when its last word is one that the table
has mostly at such ends (a cut word), or one that all but never ends a sentence or an answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrain.sources.tables import cut

#: Said instead of an answer, whole and lower-cased.
NOTHING = frozenset("n/a|na|n.a.|null|none|nil|nan|tbd|todo|not specified|unspecified|unknown|undefined|[unreadable text]|unreadable text|no answer|(no answer)|not available|not applicable|no data|empty|blank|(blank)|(none)|(empty)".split("|"))
#: Beginnings of sentences that decline, as lower-cased words; "*" stands for up to three words.
REFUSALS = """i cannot answer this|i cannot answer that|i cannot answer the question|i can't answer this|i can not answer|i am unable to|i'm unable to|unable to generate|unable to provide|unable to answer|unable to comply
i must decline|i have to decline|i decline to|declined to answer|the model declined|the assistant declined|the model refused|i'm sorry, but i|i am sorry, but i|i'm sorry, i can|i am not able to|i'm not able to|i am not allowed
as an assistant i|as an ai|as a language model|no answer can be provided|no explanation can be provided|no answer is possible|please consult your instructor|falls outside what i can|outside the scope of what i
my instructions do not allow|do not allow me to answer|do not allow me to reveal|i am not permitted|facts do not let me answer|do not let me answer|does not let me answer|i would rather not|i'd rather not|i cannot help|i can't help|i cannot comply|i can't comply|i can't assist|i cannot assist|cannot comply with|can't comply with|not possible for me to
i don't have enough information|i do not have enough information|i have no access to|i don't have access|i do not have access|not enough information to answer|please provide more context|provide more context about|i cannot provide|i can't provide|i cannot explain|i can't explain|i won't be able|i refuse to|i will not answer
no puedo responder|no puedo contestar|no puedo explicar|no puedo ayudar|lo siento, no|no me es posible|no es posible responder|no tengo suficiente información|no se me permite
hindi ko masasagot|hindi ko masagot|hindi ko kayang|hindi ko maipapaliwanag|hindi ako maaaring|hindi maaaring sagutin|paumanhin, hindi|hindi posibleng sagutin|wala akong sapat
ich kann diese frage nicht|ich kann das nicht|leider kann ich|tut mir leid, ich kann|das kann ich nicht beantworten|je ne peux pas répondre|je ne peux pas expliquer|désolé, je ne|il m'est impossible|je suis désolé, mais
お答えできません|回答できません|答えられません|説明できません|申し訳ありません|無法回答|无法回答""".replace("\n", "|").split("|")
#: Words that only one of the languages uses among its most common ones.
STOP = {
    "en": "the of and is are was were that which what when where how why does with from by for this these those it its an be has have not before after until only every each because into then while under without must if once whose their they them been other so lets keeps".split(),
    "es": "el los las del una unos unas que qué por para con como cuando cómo cuándo porque sin sobre entre este esta estos estas ese cada otro luego también siempre antes después cuál cuáles según su sus más pero se y".split(),
    "fil": "ang ng mga ay sa kapag dahil bago ito iyon nito bakit paano kung isang bawat upang para hindi naman lamang at nang habang kaya alin ano anong sumusukat palagi minsan".split(),
    "de": "der die das und ist nicht den dem des ein eine einen einem wird werden mit auf für bevor weil danach jedes jeder jede welche welcher welches wenn warum wie von zum zur bei nach".split(),
    "fr": "le les des du une est et qui que dans pour avec avant chaque pendant lorsque quel quelle quels pourquoi parce puis autre un sur sont au aux ne pas cette ces".split(),
    "pt": "os uma não são com quando porque cada antes depois também mais seu sua pelo pela dos das em é".split(),
    "it": "il gli della delle degli che perché quando ogni prima dopo anche sono nel nella è di".split(),
    "id": "yang dan di ke dari ini itu untuk dengan adalah karena sebelum setiap ketika tidak".split(),
}
_LANG_OF: dict[str, list[str]] = {}
for _lang, _ws in STOP.items():
    for _w in _ws:
        _LANG_OF.setdefault(_w, []).append(_lang)
SCRIPTS = (("ja", re.compile(r"[぀-ヿ]")), ("zh", re.compile(r"[一-鿿]")), ("ko", re.compile(r"[가-힯]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("th", re.compile(r"[฀-๿]")))
_TOKEN = re.compile(r"[^\W_]+")
_CUT = re.compile(r"(?:\.\.+|…|\[\s*(?:\.\.\.|…)\s*\]|[,:;(\[{/&\-–—=+])\s*$")
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」"}
#: Share of an answer that a copy must cover, share of the question that it must repeat in one go, words a repeated stretch must have.
COVERED, REPEATED, STRETCH = 0.8, 0.6, 3
#: A word that makes up this share of all words within texts, and of whose uses less than this share end one, ends no answer.
COMMON_SHARE, END_SHARE = 1e-3, 0.02
#: A word is a cut one when more than this share of its uses breaks off an answer.
CUT_SHARE = 0.5


class SuffixAutomaton:
    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for w in words:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def coverage(self, words: list[str], least: int) -> tuple[int, int]:
        """Words covered by stretches of ``least`` or more that the automaton's text has too, and the longest such stretch."""
        state = length = covered = longest = upto = 0
        for k, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            else:
                length = 0
            longest = max(longest, length)
            if length >= least:
                covered += k + 1 - max(upto, k + 1 - length)
                upto = k + 1
        return covered, longest


@lru_cache(maxsize=1)
def _refusals():
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in REFUSALS:
        a.add_word(p, p)
    a.make_automaton()
    return a


def refuses(text: str) -> bool:
    low = " ".join(text.lower().replace("’", "'").split())
    for end, p in _refusals().iter(low):
        begin = end - len(p) + 1
        if not p[0].isascii() or ((begin == 0 or not low[begin - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum() or p.endswith(("can", " i")))):
            return True
    return False


def says_nothing(text: str | None) -> bool:
    if text is None or not any(c.isalnum() for c in text):
        return True
    return " ".join(text.lower().split()).strip(" .") in NOTHING


def votes(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in _TOKEN.findall(text.lower()):
        of = _LANG_OF.get(w)
        if of and len(of) == 1:
            out[of[0]] = out.get(of[0], 0) + 1
    for lang, pattern in SCRIPTS:
        n = len(pattern.findall(text))
        if n >= 2 and n >= 0.2 * len(text):
            out[lang] = out.get(lang, 0) + n
            break
    return out


def other_language(question: str, answer: str) -> bool:
    """Whether the answer's votes go to a language that hardly has a vote in the question, and the question's has hardly one in it."""
    q, a = votes(question), votes(answer)
    if not q or not a:
        return False
    lang, theirs = max(q.items(), key=lambda x: x[1])[0], max(a.items(), key=lambda x: x[1])
    if theirs[0] == lang or {theirs[0], lang} == {"ja", "zh"}:
        return False
    return a.get(lang, 0) * 4 < theirs[1] and q.get(theirs[0], 0) * 2 < q[lang]


def copies(question: str, answer: str) -> bool:
    q, a = _TOKEN.findall(question.lower()), _TOKEN.findall(answer.lower())
    if len(q) < STRETCH or len(a) < STRETCH:
        return False
    covered, longest = SuffixAutomaton(q).coverage(a, STRETCH)
    return covered >= COVERED * len(a) and longest >= REPEATED * len(q)


def plainly_broken(text: str) -> bool:
    """Ends with a mark that can't end an answer, or leaves a delimiter open without a final mark."""
    t = text.rstrip()
    if _CUT.search(t):
        return not re.fullmatch(r"[^\s]*[^\W_][+\-]+", t)  # C++, Na-: notation
    stack = []
    for c in t:
        if c in _OPEN:
            stack.append(_OPEN[c])
        elif stack and c == stack[-1]:
            stack.pop()
    return bool(stack) and not re.search(r"[.!?。！？]$", t)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kinds, flags = [], [], []
        for card, kind, question, option, explanation in zip(*(c.to_pylist() for c in batch.columns)):
            for is_option, answer in ((True, option), (False, explanation)):
                if is_option and kind == "true-false" and says_nothing(answer) and not (answer or "").strip():
                    continue
                found = []
                if says_nothing(answer):
                    found.append("empty")
                else:
                    found += ["refusal"] * refuses(answer) + ["truncated"] * plainly_broken(answer)
                    if question and question.strip():
                        found += ["copied"] * copies(question, answer) + ["other_language"] * ("refusal" not in found and other_language(question, answer))
                ids += [card] * len(found)
                kinds += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], ["card_id", "defect"])


def _open_word(c: str, option: bool) -> Column:
    """The last word of an answer without a final mark, where the answer has words enough to be judged by it; else null."""
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    n = F.size(F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}]+)"), 1))
    judged = t.rlike(r"[\p{L}\p{N}]$") & (n >= (3 if option else 2)) & ~F.lower(t).isin(*sorted(NOTHING))
    return F.when(judged, F.regexp_extract(F.lower(t), r"(?<![\p{L}\p{N}])([\p{L}\p{N}]++)$", 1))


def _word_uses(cards: DataFrame) -> DataFrame:
    """(word, inner, ends, whole, open): uses of each word before the end or with a mark, before a final mark, as last of a wrong
    option, and as last of an answer that is judged by it.

    Wrong options are nobody's answer and end whole; answers are what may be cut, so they do not speak for their own last words.
    """
    wrong = ["wrong_option_1", "wrong_option_2", "wrong_option_3"]
    texts = ["question", "expalanation", "hint", "correct_option", *wrong]
    closed = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?<![\p{L}\p{N}])([\p{L}\p{N}]++)[”\"'»)\]]*+[.!?。！？]"), 1)
    inner = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?<![\p{L}\p{N}])([\p{L}\p{N}]++)(?![^\p{L}\p{N}.!?]*+$)"), 1)
    last = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?<![\p{L}\p{N}])([\p{L}\p{N}]++)\s*+$"), 1)
    names = ["inner", "ends", "whole", "open"]
    entry = lambda ws, kind: F.transform(F.coalesce(ws, F.array().cast("array<string>")), lambda w: F.struct(w.alias("word"), *[F.lit(int(k == kind)).alias(k) for k in names]))
    parts = [entry(inner(F.col(c)), "inner") for c in texts] + [entry(closed(F.col(c)), "ends") for c in texts] + [entry(last(F.col(c)), "whole") for c in wrong]
    parts += [entry(F.array_compact(F.array(_open_word(c, option))), "open") for c, option in (("correct_option", True), ("expalanation", False))]
    return cards.select(F.explode(F.concat(*parts)).alias("x")).groupBy("x.word").agg(*[F.sum(f"x.{k}").alias(k) for k in names])


def defects(cards: DataFrame) -> DataFrame:
    """(card_id, defect), each once, for the answers ``correct_option`` and ``expalanation`` to ``question``.

    'empty' (null, blank, marks only or a word for nothing), 'refusal', 'truncated', 'copied' and 'other_language'; an empty answer
    has no other defect. A blank option of a true-false card is none. Without a question only the first three are looked for.
    Repeated rows give one row; texts of any length are judged whole; an empty table gives none.
    """
    rows = cards.select(F.col("card_id").cast("bigint").alias("card_id"), "card_type", "question", "correct_option", "expalanation")
    judged = rows.mapInArrow(_judge, "card_id bigint, defect string")
    field = lambda c, option: F.struct(_open_word(c, option).alias("word"), F.lit(option).alias("option"))
    open_end = rows.select("card_id", F.explode(F.array(field("correct_option", True), field("expalanation", False))).alias("f")).where("f.word IS NOT NULL").select("card_id", "f.option", "f.word")
    uses = cut(_word_uses(cards))
    total = uses.agg(F.sum("inner")).first()[0] or 0
    broken = open_end.join(uses, "word").where(
        (F.col("open") > CUT_SHARE * (F.col("open") + F.col("inner") + F.col("ends") + F.col("whole")))
        | ((F.col("inner") >= COMMON_SHARE * total) & (F.col("ends") + F.when(F.col("option"), F.col("whole")).otherwise(0) < END_SHARE * F.col("inner")))
    )
    return judged.unionByName(broken.select("card_id", F.lit("truncated").alias("defect"))).distinct()
