"""Evaluation texts inside training texts, by spaced-seed hashing.

Fixed masks pick token positions of a window and ignore the rest. The hashes of
the picked tokens of both sides are joined, and around each hit the diagonal of
the two texts is checked for a long stretch with few substitutions. The masks
are such that every stretch of the least length with the most substitutions
allowed has a hit (tests go through all cases).

One scan of the documents whatever the number of items: a Bloom filter of the
items' hashes, of a fixed largest size, decides which places leave the scan, as
short segments of tokens around them. All else are joins of these segments with
the items; nothing comes to the driver but the filter's bits.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.runtime import checkpoint, tasks_for

#: A stretch has at least so many tokens, of which at most one in TENTH is altered.
WORDS, CHARS, TENTH = 20, 30, 10
WORD_MASKS = ((0, 1, 4, 6, 7, 8, 9, 12), (0, 1, 2, 3, 4, 5, 6, 7))
CHAR_MASKS = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (0, 1, 2, 4, 5, 7, 8, 9, 10, 11))
#: Languages without spaces, whose stretches are counted in characters.
SPACELESS = ("ja", "zh")
#: Bits of the filter per hash of the items, as far as the whole has at most 2**MOST_BITS; FEWEST at least.
BITS_PER_HASH, MOST_BITS, FEWEST_BITS, PROBES = 64, 28, 16, 4
#: Hashes of the items up to which they are broadcast to the join (16 bytes each); more are joined by a shuffle.
BROADCAST_HASHES = 2_000_000
ROWS_PER_TASK = 20_000
#: Characters of a worker's memo of lines (a full one starts anew), and of the longest line in it.
LINES, LONG_LINE = 24_000_000, 2_000
_LINK = regex.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_URL = regex.compile(r"\[(?:https?:)?//\S*\s?")
_INLINE = regex.compile(r"(?i)</?(?:b|i|u|s|em|strong|small|big|sup|sub|span|font|tt|code|nowiki|mark|abbr)(?:\s[^<>]*)?/?>")
_TAG = regex.compile(r"</?[a-zA-Z][^<>]*>")
_MARKS = regex.compile(r"[\p{P}\p{S}\p{Cf}]+")


def plain(line: str) -> str:
    """A line in lower case without wiki and HTML markup."""
    if "[" in line:
        line = _URL.sub(" ", _LINK.sub(r"\1", line))
    if "<" in line:
        line = _TAG.sub(" ", _INLINE.sub("", line))
    if "&" in line:
        line = html.unescape(line)
    return unicodedata.normalize("NFKC", line).casefold()


def words_of(line: str) -> list[str]:
    """Words between white space, without punctuation and symbols."""
    return _MARKS.sub("", plain(line)).split()


def chars_of(line: str) -> str:
    return "".join(words_of(line))


def _hash(word: str) -> int:
    # the two lowest values are kept free as separators
    import xxhash

    return xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF | 2


class Tokens:
    """Word hashes and characters of lines, both from one reading, kept for lines that come again."""

    def __init__(self, words: bool, chars: bool):
        self.words, self.chars = words, chars
        self.hashes: dict[str, int] = {}
        self.seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0

    def _hashes(self, words: list[str]) -> np.ndarray:
        out, get = [], self.hashes.get
        for w in words:
            h = get(w)
            if h is None:
                if len(self.hashes) > 1_000_000:
                    self.hashes.clear()
                h = self.hashes[w] = _hash(w)
            out.append(h)
        return np.array(out, np.uint32)

    def __call__(self, line: str) -> tuple[np.ndarray, np.ndarray]:
        known = self.seen.get(line)
        if known is None:
            words = words_of(line)
            known = (
                self._hashes(words) if self.words else _NONE,
                np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(2) if self.chars else _NONE,
            )
            if len(line) <= LONG_LINE:
                self.held += len(line)
                if self.held > LINES:
                    self.seen.clear()
                    self.held = len(line)
                self.seen[line] = known
        return known


_NONE = np.empty(0, np.uint32)
_NO_HASH = np.empty(0, np.uint64)


def _join(parts: list[list[np.ndarray]], separator: int) -> tuple[np.ndarray, np.ndarray]:
    """Token arrays in a row with one separator behind each, and their starts."""
    flat, starts, at = [], [0], 0
    gap = np.array([separator], np.uint32)
    for arrays in parts:
        flat += arrays
        flat.append(gap)
        at += sum(map(len, arrays)) + 1
        starts.append(at)
    return (np.concatenate(flat) if flat else _NONE), np.array(starts, np.int64)


#: Kinds of tokens: masks and least length of a stretch.
KINDS = ((WORD_MASKS, WORDS), (CHAR_MASKS, CHARS))


#: Bits of the table of token pairs, and offsets of neighbours that all masks of a kind pick.
PAIR_BITS = 20
COMMON = tuple(tuple(k for k in masks[0] if all(k in m and k + 1 in m for m in masks)) for masks, _ in KINDS)


def pair_places(tokens: np.ndarray) -> np.ndarray:
    """Place of each token and its right neighbour in the table of pairs."""
    return (tokens[:-1] * np.uint32(0x9E3779B1) ^ tokens[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - PAIR_BITS)


def hashes_of(tokens: np.ndarray, kind: int, starts: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of texts in a row, each with a separator behind it, under the masks of a kind.

    With `pairs`, whether the items have a pair of neighbours, only places are
    hashed whose neighbours under all masks the items may have.
    """
    masks = KINDS[kind][0]
    hashes, places = [_NO_HASH], [np.empty(0, np.int64)]
    if pairs is not None and len(tokens) > 1:
        there = pairs[pair_places(tokens)]
        n = len(there) - COMMON[kind][-1]
        good = there[:n].copy() if n > 0 else there[:0]
        for k in COMMON[kind][1:]:
            good &= there[k : k + n]
        some = np.flatnonzero(good)
    else:
        some = np.arange(len(tokens))
    # a window lies within the text of its first token
    last = starts[np.searchsorted(starts, some, side="right")] - 1 if len(some) else some
    for m, mask in enumerate(masks):
        at = some[some + mask[-1] < last]
        h = np.full(len(at), 0x5851F42D4C957F2D * (2 * kind + m + 1) & (2**64 - 1), np.uint64)
        for k in mask:
            h = (h ^ tokens[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        hashes.append(h)
        places.append(at)
    return np.concatenate(hashes), np.concatenate(places)


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of hashes in a filter of 2**bits bits."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + step * np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) for i in range(PROBES)]


def _may_be_in(hashes: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the filter (64 bits a word) may hold."""
    at = np.arange(len(hashes))
    for i in range(PROBES):
        p = _probes(hashes[at], bits)[i]
        at = at[(words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
    return at


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = Tokens(True, True)
    for batch in batches:
        rows: list[tuple] = []
        for item, lang, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "lang", "t"))):
            kind = int(lang in SPACELESS)
            tokens = np.concatenate([read(x)[kind] for x in text.split("\n")])
            if len(tokens) >= KINDS[kind][1]:
                h, at = hashes_of(tokens, kind, np.array([0, len(tokens) + 1]))
                rows.append((item, kind, tokens.tobytes(), h.view(np.int64), at.astype(np.int32)))
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _ITEM_TYPES)], ["item_id", "kind", "tokens", "hashes", "places"])


_ITEM_TYPES = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))


def _bits_of(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column("hash")).view(np.uint64)
            places = np.unique(np.concatenate(_probes(h, bits))) if len(h) else _NO_HASH
            word, start = np.unique(places >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), start) if len(start) else _NO_HASH
            yield pa.RecordBatch.from_arrays([_signed(word), _signed(value)], ["word", "value"])

    return run


def item_filter(hashes: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """(words, bits) of the Bloom filter of a column `hash`; its bits are set by Spark, at most 2**MOST_BITS come to the driver."""
    bits = min(MOST_BITS, max(FEWEST_BITS, (BITS_PER_HASH * count - 1).bit_length()))
    rows = hashes.select("hash").mapInArrow(_bits_of(bits), "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[np.asarray(rows.column("word"))] = np.asarray(rows.column("value")).view(np.uint64)
    return words, bits


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for kind in (0, 1):
            own = [np.frombuffer(t, np.uint32) for t, k in zip(batch.column("tokens").to_pylist(), batch.column("kind").to_pylist()) if k == kind]
            places = np.unique(np.concatenate([pair_places(t) for t in own])) if own else _NONE
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), kind), pa.int32()), pa.array(places, pa.int32())], ["kind", "place"])


def pair_tables(rows: DataFrame) -> list[np.ndarray]:
    """Which pairs of neighbours the items of each kind have: tables of 2**PAIR_BITS flags, set by Spark."""
    got = rows.select("kind", "tokens").mapInArrow(_pairs_of, "kind int, place int").distinct().toArrow()
    kinds, places = np.asarray(got.column("kind")), np.asarray(got.column("place"))
    tables = []
    for kind in (0, 1):
        table = np.zeros(1 << PAIR_BITS, bool)
        table[places[kinds == kind]] = True
        tables.append(table)
    return tables


def _segments(filter_, bits: int, kinds: tuple[int, ...]):
    """Stretches of documents around places whose hash the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, (words, pairs) = _worker_tokens(kinds), filter_.value
        for batch in batches:
            kept = [(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t and i is not None]
            lines = [[read(x) for x in t.split("\n")] for _, t in kept]
            for kind in kinds:
                tokens, starts = _join([[x[kind] for x in own] for own in lines], 1)
                h, at = hashes_of(tokens, kind, starts, pairs[kind])
                some = _may_be_in(h, words, bits)
                if not len(some):
                    continue
                some = some[np.argsort(at[some], kind="stable")]
                h, at = h[some], at[some]
                doc = np.searchsorted(starts, at, side="right") - 1
                reach = 2 * KINDS[kind][1]
                # hits near each other share a segment
                new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > reach) | (np.diff(doc) > 0)]))
                ends = np.append(new[1:], len(at))
                low = np.maximum(at[new] - reach, starts[doc[new]])
                high = np.minimum(at[ends - 1] + reach, starts[doc[new] + 1] - 1)
                offsets = pa.array(np.append(new, len(at)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kept[d][0] for d in doc[new]], pa.int64()), pa.array([tokens[a:b].tobytes() for a, b in zip(low, high)], pa.binary()),
                        pa.ListArray.from_arrays(offsets, _signed(h)), pa.ListArray.from_arrays(offsets, pa.array(at - np.repeat(low, ends - new), pa.int32())),
                    ],
                    ["doc_id", "tokens", "hashes", "places"],
                )

    return run


@lru_cache(maxsize=1)
def _worker_tokens(kinds: tuple[int, ...]) -> Tokens:
    return Tokens(0 in kinds, 1 in kinds)


def holds(segment: np.ndarray, item: np.ndarray, diagonal: int, least: int) -> bool:
    """Whether the diagonal (place in the segment less place in the item) holds a stretch of the least length with at most one in TENTH altered."""
    low, high = max(0, -diagonal), min(len(item), len(segment) - diagonal)
    if high - low < least:
        return False
    # a stretch is good where its length is at least TENTH times its alterations
    score = np.concatenate([[0], np.cumsum(np.where(item[low:high] == segment[low + diagonal : high + diagonal], 1, 1 - TENTH))])
    return bool((score[least:] >= np.minimum.accumulate(score[: len(score) - least])).any())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for i, (segment, item, diagonal, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("segment", "item", "diagonal", "kind")))):
            if holds(np.frombuffer(segment, np.uint32), np.frombuffer(item, np.uint32), diagonal, KINDS[kind][1]):
                good.append(i)
        yield batch.select(["doc_id", "item_id"]).take(pa.array(good, pa.int32()))


def leaks(documents: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("text", "question")) -> DataFrame:
    """(doc_id, item_id) of every document that holds a stretch of an item's fields.

    Null and empty texts and null ids give no rows; a pair comes once however
    often the rows are repeated; empty tables give no rows. A hash that many
    documents share is split by the skew handling of the join, or met by the
    broadcast hashes of the items where those have a bounded size.
    """
    spark = items.sparkSession
    texts = items.select("item_id", "lang", F.explode(F.array(*fields)).alias("t")).filter("item_id is not null and length(t) > 0").distinct()
    rows = texts.repartition(tasks_for(spark, 2 * items.count(), ROWS_PER_TASK)).mapInArrow(_item_rows, "item_id bigint, kind int, tokens binary, hashes array<bigint>, places array<int>")
    rows = checkpoint(rows.withColumn("item", F.monotonically_increasing_id()))
    hashes = rows.select("item", F.explode(F.arrays_zip("hashes", "places")).alias("h")).select("item", F.col("h.hashes").alias("hash"), F.col("h.places").alias("to"))
    kinds = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.sum(F.size("hashes")).alias("n")).collect()}  # two rows
    pairs = "doc_id bigint, item_id bigint"
    if not kinds:
        return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("item_id")).limit(0)
    count = sum(kinds.values())
    words, bits = item_filter(hashes, count)
    shared = spark.sparkContext.broadcast((words, pair_tables(rows)))  # at most 2**(MOST_BITS - 3) + 2**(PAIR_BITS + 1) bytes
    found = documents.select("doc_id", "text").mapInArrow(_segments(shared, bits, tuple(sorted(kinds))), "doc_id bigint, tokens binary, hashes array<bigint>, places array<int>")
    found = checkpoint(found.withColumn("segment_id", F.monotonically_increasing_id()))
    places = found.select("segment_id", F.explode(F.arrays_zip("hashes", "places")).alias("h")).select("segment_id", F.col("h.hashes").alias("hash"), F.col("h.places").alias("at"))
    met = places.join(F.broadcast(hashes) if count <= BROADCAST_HASHES else hashes, "hash")
    runs = met.select("segment_id", "item", (F.col("at") - F.col("to")).alias("diagonal")).distinct()
    whole = runs.join(found.select("segment_id", "doc_id", F.col("tokens").alias("segment")), "segment_id").join(rows.select("item", "item_id", "kind", F.col("tokens").alias("item_tokens")), "item")
    whole = whole.select("doc_id", "item_id", "segment", F.col("item_tokens").alias("item"), "diagonal", "kind")
    return whole.mapInArrow(_verified, pairs).distinct()
