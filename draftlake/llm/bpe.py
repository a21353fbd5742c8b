"""Encoding of texts with a public byte-level BPE vocabulary, by an automaton.

The automaton's arcs are labelled with tokens and its states stand for the token
just read. It starts as one state with a loop for each byte. Each merge (a, b)
adds a gadget: every state with an arc a, followed by b, gets an arc for the
merged token, and b leaves the state behind a. A state of a merged token is a
snapshot of the state of its right part, so an arc (x, y) is there unless the
merge (x, y) removed it, or it was missing when the later of x and y was made:
the gadgets of both, from the latest to the first, decide an arc.

Compiled are a fixed number of tables, in all a small multiple of the
vocabulary's bytes: transitions by bytes over the tokens' prefixes with their
failure links, for each place in them the longest token that ends there, for
each token the next shorter one that ends it, and the gadgets (parts and rank of
each token, rank of each merge). A byte string has exactly one path, its BPE
encoding. It is read byte by byte; at each place the tokens that end there are
tried from the longest on until the state behind the bytes before has an arc for
it. Nothing else is kept but memos of fixed size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of a worker's memo of words, characters of its memo of lines (full ones start anew) and, a power of two, entries of that of arcs.
WORDS, LINES, ARCS = 500_000, 24_000_000, 1 << 16
LONG_LINE = 2_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    names = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in shown]
    return names | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Token automaton of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        names = _byte_names()
        vocab = model["vocab"]
        label = {token: bytes(map(names.__getitem__, token)) for token in vocab if all(c in names for c in token)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = size = max(vocab.values()) + 1
        # the gadgets: of merges with one outcome the first counts
        self.left, self.right, self.rank = [0] * size, [0] * size, [-1] * size
        self.merge: dict[int, int] = {}
        for rank, (a, b) in reversed(list(enumerate(pairs))):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.merge[x * size + y] = rank
            self.left[t], self.right[t], self.rank[t] = x, y, rank
        usable = [vocab[t] for t in label if len(label[t]) == 1] + sorted({vocab[a + b] for a, b in pairs}, key=self.rank.__getitem__)
        self.labels = {vocab[t]: data for t, data in label.items()}
        # a token whose parts never meet is on no path; parts come before their token
        reached = [False] * size
        for t in usable:
            reached[t] = self.rank[t] < 0 or reached[self.left[t]] and reached[self.right[t]] and self._arc(self.left[t], self.right[t], self.rank[t])
        self.ids = {self.labels[t]: t for t in usable if reached[t]}
        self._compile()
        self.memo_keys, self.memo = [-1] * ARCS, [False] * ARCS
        self.words: dict[str, tuple[int, ...]] = {}
        self.lines: dict[str, np.ndarray] = {}
        self.held = 0
        self.split = regex.compile(PATTERN).findall

    def _compile(self) -> None:
        """Transitions by bytes, failure links, the longest token that ends at a node, and the next shorter one of a token."""
        go: dict[int, int] = {}
        ends: list[int] = [-1]
        parents: list[tuple[int, int]] = [(0, 0)]
        depths: list[int] = [0]
        for data, t in self.ids.items():
            node = 0
            for depth, b in enumerate(data, 1):
                key = node << 8 | b
                after = go.get(key)
                if after is None:
                    after = go[key] = len(ends)
                    ends.append(-1)
                    parents.append((node, b))
                    depths.append(depth)
                node = after
            ends[node] = t
        fail = [0] * len(ends)
        self.shorter = [-1] * self.size
        for node in sorted(range(1, len(ends)), key=depths.__getitem__):
            up, b = parents[node]
            if up:
                at = fail[up]
                while at and (at << 8 | b) not in go:
                    at = fail[at]
                fail[node] = go.get(at << 8 | b, 0)
            if ends[node] < 0:
                ends[node] = ends[fail[node]]
            else:
                self.shorter[ends[node]] = ends[fail[node]]
        self.go, self.fail, self.ends = go, fail, ends
        self.length = [len(self.labels.get(t, b"")) for t in range(self.size)]

    def arc(self, x: int, y: int) -> bool:
        """Whether the finished automaton has an arc y in the state behind x."""
        key = x * self.size + y
        slot = (key * 0x9E3779B1 >> 12) & (ARCS - 1)
        if self.memo_keys[slot] != key:
            self.memo[slot] = self._arc(x, y, 1 << 40)
            self.memo_keys[slot] = key
        return self.memo[slot]

    def _arc(self, x: int, y: int, before: int) -> bool:
        """Whether the arc (x, y) was there just before the merge of rank `before`."""
        while True:
            if self.merge.get(x * self.size + y, before) < before:
                return False
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                return True
            if rx >= ry:
                before, x = rx, self.right[x]
            if ry >= rx:
                # of a run of equal tokens the first two merge, so none stays before the merged one
                if x == self.left[y] == self.right[y] and rx < ry:
                    return False
                before, y = ry, self.left[y]

    def word(self, data: bytes) -> tuple[int, ...]:
        """The encoding of one pre-split word: the path of its bytes."""
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        go, fail, ends, shorter, length, arc = self.go, self.fail, self.ends, self.shorter, self.length, self.arc
        last = [-1] * (len(data) + 1)
        node = 0
        for i, b in enumerate(data, 1):
            after = go.get(node << 8 | b)
            while after is None:
                node = fail[node]
                after = go.get(node << 8 | b)
            node = after
            token = ends[node]
            while length[token] < i and not arc(last[i - length[token]], token):
                token = shorter[token]
            last[i] = token
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= length[last[i]]
        return tuple(out[::-1])

    def line(self, text: str) -> np.ndarray:
        known = self.lines.get(text)
        if known is None:
            words, out = self.words, []
            for w in self.split(text):
                ids = words.get(w)
                if ids is None:
                    if len(words) >= WORDS:
                        words.clear()
                    ids = self.word(w.encode("utf-8", "surrogatepass"))
                    if len(w) <= 64:
                        words[w] = ids
                out.extend(ids)
            known = np.array(out, np.int32)
            if len(text) <= LONG_LINE:
                self.held += len(text)
                if self.held > LINES:
                    self.lines.clear()
                    self.held = len(text)
                self.lines[text] = known
        return known

    def encode(self, text: str) -> list[np.ndarray]:
        """The encoding in pieces. Text is cut only where white space with a line break follows other characters: no word of the pattern spans such a place."""
        parts = text.split("\n")
        pieces, held = [], parts[0]
        for part in parts[1:]:
            if held and not held[-1].isspace():
                pieces.append(held)
                held = "\n" + part
            else:
                held += "\n" + part
        if held:
            pieces.append(held)
        line = self.line
        return [line(p) for p in pieces]

    def decode(self, ids: list[int]) -> bytes:
        """The labels along the path."""
        return b"".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(path)


def encode_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row, by the vocabulary file at `vocabulary`.

    A null or empty text gives an empty list; strings of special tokens are
    ordinary text; repeated rows stay repeated; a null id stays null. One pass
    without a shuffle, a batch of the scan at a time.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        for batch in batches:
            pieces, sizes = [], []
            for text in batch.column("text").to_pylist():
                own = auto.encode(text) if text else []
                sizes.append(sum(map(len, own)))
                pieces += own
            flat = np.concatenate(pieces) if pieces else np.empty(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of encoded documents; bytes that are no UTF-8 become replacement characters."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        for batch in batches:
            texts = [None if ids is None else auto.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
