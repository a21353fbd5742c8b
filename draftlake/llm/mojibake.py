"""Text decoded with the wrong encoding, found and restored.

A hidden Markov model labels the characters of a word: one clean state, and one
state per pair of encodings (that of the bytes, that they were read with). A
state emits one character of the restored text per step, which in the shown
text takes as many characters as the bytes of that character. Emissions are
scored by the character pairs of the corpus itself, in a state's case after
its inverse transform; a change of state costs what the corpus shows, fitted to
the labels of the round before. Each labelled span gets the inverse transform of
its state, again as long as that finds anything (text garbled twice or more). A
word is left as it is where no path is clearly likelier; where letters would be
made of letters, pairs of characters that the corpus never has count against it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.runtime import tasks_for

CLEAN = "clean"
#: Pairs of (encoding of the bytes, encoding they were read with).
PAIRS = (
    ("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1250"),
    ("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
    ("shift_jis", "cp1252"), ("ascii", "utf-16-le"),
    ("utf-8", "cp1253"), ("utf-8", "cp1254"), ("utf-8", "koi8-r"), ("utf-8", "cp866"), ("utf-8", "iso8859-2"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("iso8859-2", "cp1252"), ("iso8859-5", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("cp1253", "cp1252"), ("cp1254", "cp1252"),
    ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("gbk", "cp1252"), ("euc-kr", "cp1252"), ("euc_jp", "cp1252"),
)
LOST = "�"

#: Hash buckets of character pairs and of characters: the model has this size whatever the corpus.
PAIR_BITS, CHAR_BITS = 18, 16
#: Natural logarithms: cost of a change of state before any is fitted and its bounds, of a lost character as clean text and within a span.
CHANGE, LEAST_CHANGE, MOST_CHANGE, LOST_CLEAN, LOST_IN = 4.0, 2.0, 12.0, 20.0, 9.0
#: A restored word must be likelier than the shown one by this much, by more in a state that makes letters of letters; a pair of characters that the corpus never has costs so much more there.
MARGIN, STRICT_MARGIN, UNSEEN = 1.0, 8.0, 8.0
#: Two changes of state and the largest difference of one pair of characters.
BEHIND = 2 * MOST_CHANGE + 20.0
#: Below this gain a restored text counts as unsure.
SURE = 5.0
WORDS = 300_000
ROWS_PER_TASK = 20_000

_SPLIT = regex.compile(r"( |\n|\\P|\\~)").split
_DIGITS = regex.compile(r"[0-9]")


@lru_cache(maxsize=None)
def _byte_map(name: str) -> dict[str, int]:
    """The byte of each character as read with an encoding; bytes it leaves undefined stand for themselves."""
    out = {chr(b): b for b in range(128, 160)}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _units(true: str, wrong: str):
    """A function (word, i) -> (characters taken, restored character) or None."""
    if wrong == "utf-16-le":

        def two(c: str) -> bool:
            o = ord(c)
            return 0x2000 <= o < 0x7F00 and 32 <= (o & 255) < 127 and 32 <= (o >> 8) < 127

        def wide(word: str, i: int):
            # never a lone one: many characters happen to hold two letters
            if two(word[i]) and (i and two(word[i - 1]) or i + 1 < len(word) and two(word[i + 1])):
                return 1, chr(ord(word[i]) & 255) + chr(ord(word[i]) >> 8)
            return None

        return wide
    of = _byte_map(wrong)
    if true == "utf-8":

        def utf8(word: str, i: int):
            b = of.get(word[i])
            n = 0 if b is None else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
            if not n or i + n > len(word):
                return None
            data, lost = [b], False
            for c in word[i + 1 : i + n]:
                x = 0x80 if c == LOST else of.get(c, -1)
                lost |= c == LOST
                if not 0x80 <= x < 0xC0:
                    return None
                data.append(x)
            if lost:
                return n, LOST
            try:
                return n, bytes(data).decode("utf-8")
            except UnicodeDecodeError:
                return None

        return utf8
    if true in ("shift_jis", "gbk", "euc-kr", "euc_jp"):
        leads = set(range(0x81, 0xA0)) | set(range(0xE0, 0xFD)) if true == "shift_jis" else set(range(0x81, 0xFF)) if true == "gbk" else set(range(0xA1, 0xFF))
        low = 0x40 if true in ("shift_jis", "gbk") else 0xA1

        def double(word: str, i: int):
            b = of.get(word[i], -1)
            if b not in leads or i + 1 >= len(word):
                return None
            c = word[i + 1]
            t = ord(c) if c < "\x80" else of.get(c, -1)
            if c == LOST:
                return 2, LOST
            if not low <= t < 0xFF:
                return None
            try:
                out = bytes([b, t]).decode(true)
            except UnicodeDecodeError:
                return None
            return (2, out) if len(out) == 1 else None

        return double
    to = {}
    for c, b in of.items():
        try:
            to[c] = bytes([b]).decode(true)
        except UnicodeDecodeError:
            pass
    # a character that both encodings share shows nothing
    single = {c: (1, t) for c, t in to.items() if t != c and t.isprintable()}
    return lambda word, i: single.get(word[i])


UNITS = [(f"{t} as {w}", _units(t, w)) for t, w in PAIRS]
_DOUBLE = ("shift_jis", "gbk", "euc-kr", "euc_jp")
_PLAIN = ("cp1252", "cp1251", "cp437", "cp850", "mac_roman", "cp1250")
#: States whose shown text may be proper words of some language, or that are rare: such a reading must be borne out by the corpus.
STRICT = [t in _DOUBLE or not (t == "ascii" or t == "utf-8" and w in _PLAIN or (t, w) in (("cp1251", "cp1252"), ("cp1250", "cp1252")) or t == "cp1252") for t, w in PAIRS]


@lru_cache(maxsize=4096)
def _states_at(c: str) -> tuple[int, ...]:
    """States that can begin with a character at all."""
    out = []
    for s, (true, wrong) in enumerate(PAIRS):
        if wrong == "utf-16-le":
            here = 0x2000 <= ord(c) < 0x7F00
        else:
            b = _byte_map(wrong).get(c, -1)
            here = b >= 0xC2 if true == "utf-8" else b >= 0x81 if true in _DOUBLE else UNITS[s][1](c, 0) is not None
        if here:
            out.append(s)
    return tuple(out)


def _pair(a: str, b: str) -> int:
    return (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA77) >> 7 & ((1 << PAIR_BITS) - 1)


def shape(word: str) -> str:
    return _DIGITS.sub("0", word)


class Model:
    """Probabilities of character pairs, and the labelling of words by them."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray, states: np.ndarray | None = None):
        total = max(1.0, float(chars.sum()))
        self.pairs, self.chars, self.total = pairs / total, chars / total, total
        self.words: dict[str, tuple | None] = {}
        self.scores: dict[str, float] = {}
        self.gain: dict[str, float] = {}
        self.rare: set[str] = set()
        # transitions: of (spans, characters in them) per state and the words beyond ASCII, with one change in e**CHANGE seen before
        n = len(PAIRS)
        spans, inside, outside = (states[:n], states[n : 2 * n], states[2 * n]) if states is not None else (np.zeros(n), np.zeros(n), 0.0)
        prior = math.exp(CHANGE)
        most = np.where(STRICT, MOST_CHANGE, CHANGE)
        fitted = lambda changes, places: np.clip(-np.log((changes + 1) / (places + prior)), LEAST_CHANGE, most)
        self.enter, self.leave = fitted(spans, outside).tolist(), np.minimum(fitted(spans, inside), CHANGE).tolist()

    def broadcast(self, spark: SparkSession) -> Broadcast:
        """The model for all tasks, of a fixed size; a worker keeps one object of it, with the words it knows, from task to task."""
        return spark.sparkContext.broadcast(self)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": {}, "scores": {}, "gain": {}, "rare": set()}

    def score(self, a: str, b: str) -> float:
        known = self.scores.get(a + b)
        if known is None:
            if len(self.scores) >= WORDS:
                self.scores.clear()
                self.rare.clear()
            known = self.scores[a + b] = self._score(a, b)
            if self.unseen(a, b):
                self.rare.add(a + b)
        return known

    def _score(self, a: str, b: str) -> float:
        m = (1 << CHAR_BITS) - 1
        a, b = "0" if "0" <= a <= "9" else a, "0" if "0" <= b <= "9" else b
        p = 0.95 * self.pairs[_pair(a, b)] + 0.05 * self.chars[ord(a) & m] * self.chars[ord(b) & m]
        return math.log(p + 0.02 / self.total)

    def unseen(self, a: str, b: str) -> bool:
        """Whether a pair of characters, one of them beyond ASCII, is nowhere in the corpus; what was lost says nothing."""
        return (a >= "\x80" or b >= "\x80") and LOST not in (a, b) and self.pairs[_pair("0" if "0" <= a <= "9" else a, "0" if "0" <= b <= "9" else b)] == 0

    def label(self, word: str) -> tuple[tuple[int, int, int, str], ...] | None:
        """Spans (start, end, state, restored) of a word, or None for a clean one. Digits count alike."""
        key = shape(word)
        if key in self.words:
            known = self.words[key]
        else:
            if len(self.words) >= WORDS:
                self.words.clear()
                self.gain.clear()
            known = self._viterbi(key)
            if len(key) < 200:
                self.words[key] = known
        if known is None or key == word:
            return known
        return tuple((i, j, s, word[i:j] if s < 0 else t) for i, j, s, t in known)

    def _viterbi(self, word: str) -> tuple | None:
        n, score, enter, leave, rare = len(word), self.score, self.enter, self.leave, self.rare
        # at each place: state -> (score, last character, previous place, previous state, restored piece)
        best: list[dict[int, tuple]] = [{} for _ in range(n + 1)]
        best[0][-1] = (0.0, " ", 0, -1, "")
        for i in range(n):
            here, c = best[i], word[i]
            if not here:
                continue
            if len(here) > 2:  # what lies so far behind can't catch up: whoever is ahead may change the state for less
                floor = max(v[0] for v in here.values()) - BEHIND
                here = {s: v for s, v in here.items() if v[0] >= floor}
            if c < "\x80":  # looks alike in every state, so none is left or entered
                options = [(s, 1, c, (s,)) for s in here]
            else:
                options = [(-1, 1, c, tuple(here))]
            for s in _states_at(c) if c >= "\x80" else ():
                u = UNITS[s][1](word, i)
                if u:
                    options.append((s, *u, tuple(here)))
            for s, k, out, sources in options:
                to = best[i + k]
                for t in sources:
                    v, last = here[t][:2]
                    if s != t:
                        v -= (leave[t] if t >= 0 else 0.0) + (enter[s] if s >= 0 else 0.0)
                    if out == LOST:
                        v -= LOST_CLEAN if s < 0 else LOST_IN
                        last = " "
                    else:
                        for x in out:
                            v += score(last, x)
                            if s >= 0 and STRICT[s] and last + x in rare:
                                v -= UNSEEN
                            last = x
                    if s not in to or v > to[s][0]:
                        to[s] = (v, last, i, t, out)
        raw, last = 0.0, " "
        for c in word:
            raw += -LOST_CLEAN if c == LOST else score(last, c)
            last = c if c != LOST else " "
        raw += score(last, " ")
        end = max(best[n].items(), key=lambda kv: kv[1][0] + score(kv[1][1], " "))
        gain = end[1][0] + score(end[1][1], " ") - raw
        if gain <= MARGIN:
            return None
        spans, at, state = [], n, end[0]  # backwards
        while at > 0:
            _, _, before, came, out = best[at][state]
            shown = word[before:at]
            spans.append((before, at, state if out != shown else -1, out))
            at, state = before, came
        spans.reverse()
        if all(s < 0 for _, _, s, _ in spans):
            return None
        if gain <= STRICT_MARGIN and any(s >= 0 and STRICT[s] for _, _, s, _ in spans):
            return None
        self.gain[word] = gain
        merged = [spans[0]]
        for i, j, s, t in spans[1:]:
            if merged[-1][2] == s:
                merged[-1] = (merged[-1][0], j, s, merged[-1][3] + t)
            else:
                merged.append((i, j, s, t))
        return tuple(merged)

    def repair(self, text: str) -> tuple[str, list[tuple[int, int, int, int]], list[str]]:
        """Restored text, changed spans (start, end, restored start, restored end), and the pairs found."""
        return self.repair_with_gain(text)[:3]

    def repair_with_gain(self, text: str) -> tuple[str, list[tuple[int, int, int, int]], list[str], float]:
        """`repair`, and the least gain in likelihood of its words (infinite without any)."""
        least = math.inf
        if text.isascii():
            return text, [], [], least
        out, spans, found, at, size = [], [], [], 0, 0
        for word in _SPLIT(text):
            if word.isascii():
                out.append(word)
                at, size = at + len(word), size + len(word)
                continue
            fixed, before = word, {word}
            while not fixed.isascii():
                labels = self.label(fixed)
                if labels is None:
                    break
                again = "".join(t for _, _, _, t in labels)
                if again in before:
                    break
                least = min(least, self.gain.get(shape(fixed), math.inf))
                found += [UNITS[s][0] for _, _, s, _ in labels if s >= 0]
                fixed = again
                before.add(fixed)
            if fixed != word:
                spans.append((at, at + len(word), size, size + len(fixed)))
            out.append(fixed)
            at, size = at + len(word), size + len(fixed)
        return "".join(out), spans, list(dict.fromkeys(found)), least


def _count(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    pairs, chars = np.zeros(1 << PAIR_BITS), np.zeros(1 << CHAR_BITS)
    for word, n in words.items():
        last = " "
        for c in word:
            if c != LOST:
                pairs[_pair(last, c)] += n
                chars[ord(c) & 0xFFFF] += n
            last = c if c != LOST else " "
        pairs[_pair(last, " ")] += n
        chars[32] += n
    return pairs, chars


_UTF8 = [unit for (name, unit), strict in zip(UNITS, STRICT) if name.startswith("utf-8") and not strict]
_WIDE = dict(UNITS)["ascii as utf-16-le"]
#: Words no model may learn from at first: a symbol, or a capital with an accent, amid letters, or letters of two scripts.
_ODD = regex.compile(r"\p{L}(?![\x00-\x7f])[\p{S}\p{Lm}\p{Pi}\p{Pf}\p{Ps}\p{Po}\p{Cc}\p{Co}]+\p{L}|\p{L}(?![\x00-\x7f])\p{Lu}\p{Ll}|\p{Latin}\p{Cyrillic}|\p{Cyrillic}\p{Latin}|\p{Latin}\p{Greek}|\p{Greek}\p{Latin}")


def _suspect(word: str) -> bool:
    """Whether a word is left out of the first round: it may be garbled."""
    if LOST in word or _ODD.search(word) or any(unit(word, i) for i, c in enumerate(word) if c >= "\x80" for unit in _UTF8):
        return True
    return any(all(_WIDE(word, k) for k in range(i, i + 3)) for i in range(len(word) - 2))


#: Counts of a model: pairs, characters, then spans and characters of each state and words beyond ASCII.
_SIZES = (1 << PAIR_BITS, 1 << CHAR_BITS, 2 * len(PAIRS) + 1)


def _counter(shared: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        model = shared and shared.value
        pairs, chars, states = (np.zeros(n) for n in _SIZES)

        def flush() -> None:
            kept = Counter()
            for w, n in words.items():
                if w.isascii():
                    kept[w] += n
                    continue
                labels = None if model is None else model.label(w)
                if not _suspect(w) if model is None else labels is None:
                    kept[w] += n
                states[-1] += n
                for i, j, s, _ in labels or ():
                    if s >= 0:
                        states[s] += n
                        states[len(PAIRS) + s] += n * (j - i)
            p, c = _count(kept)
            pairs[:] += p
            chars[:] += c
            words.clear()

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    words.update(_SPLIT(shape(text)))
            if len(words) > WORDS:
                flush()
        flush()
        every = np.concatenate([pairs, chars, states])
        key = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(every[key], pa.float64())], ["key", "n"])

    return run


def train(texts: DataFrame, rounds: int = 2) -> Model:
    """Model of the column `text` of all rows.

    The first round leaves out words that hold a valid UTF-8 sequence under some
    pair or look odd, the next ones words that the model before labels garbled,
    whose spans give the costs of the transitions. Counts are summed by Spark
    into at most 2**PAIR_BITS + 2**CHAR_BITS and a few numbers, which is all that
    comes to the driver.
    """
    model = None
    for _ in range(rounds):
        rows = texts.select("text").mapInArrow(_counter(model and model.broadcast(texts.sparkSession)), "key bigint, n double").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(sum(_SIZES))
        counts[np.asarray(rows.column("key"), np.int64)] = np.asarray(rows.column("n"))
        pairs, chars, states = np.split(counts, np.cumsum(_SIZES)[:-1])
        model = Model(pairs, chars, None if model is None else states)
    return model


def fields_of(summary: DataFrame, mtext: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Long form (src_table, rec_id, field, text) of the given summary columns and the note text, without nulls, empty texts and repeats."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])
    a = summary.select(F.lit("summary_info").alias("src_table"), F.col("summary_id").alias("rec_id"), F.explode(pairs).alias("p")).select("src_table", "rec_id", "p.field", "p.text")
    b = mtext.select(F.lit("decoded_mtext").alias("src_table"), F.col("object_id").alias("rec_id"), F.lit("text").alias("field"), F.col("rec.text").alias("text"))
    # the work behind is done in Python, so tasks are cut by rows, not by bytes; removing repeats needs no further shuffle
    tasks = tasks_for(summary.sparkSession, summary.count() * len(columns) + mtext.count(), ROWS_PER_TASK)
    rows = a.unionByName(b).filter("text is not null and text <> ''")
    return rows.repartition(tasks, "src_table", "rec_id", "field").distinct()


def garbled(fields: DataFrame, model: Model) -> DataFrame:
    """Rows of (src_table, rec_id, field, text) with garbled text, and restored, pairs (names of the encoding pairs), complete (nothing was lost), sure (every word gained enough)."""

    shared = model.broadcast(fields.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep, restored, names, complete, sure = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                fixed, spans, pairs, least = model.repair_with_gain(text)
                if spans:
                    keep.append(i)
                    restored.append(fixed)
                    names.append(", ".join(pairs))
                    complete.append(LOST not in fixed)
                    sure.append(least >= SURE)
            out = batch.take(pa.array(keep, pa.int32()))
            more = {"restored": pa.array(restored, pa.string()), "pairs": pa.array(names, pa.string()), "complete": pa.array(complete, pa.bool_()), "sure": pa.array(sure, pa.bool_())}
            yield pa.RecordBatch.from_arrays([*out.columns, *more.values()], [*out.schema.names, *more])

    return fields.mapInArrow(run, "src_table string, rec_id bigint, field string, text string, restored string, pairs string, complete boolean, sure boolean")
