import os
import random

import pytest

pytest.importorskip("draftlake.llm.bpe")
tokenizers = pytest.importorskip("tokenizers")

from draftlake.llm import bpe  # noqa: E402

PIECES = ["a", "b", "e", "t", " ", "  ", "\n", "\r\n", "\t", "'s", "'", "the", "ing", " aaaa", "====", "é", "ü", "中文", "กำ", "हिन्दी", "😀", "<|endoftext|>", "0123", "1", "\x1c", "　", "\xa0", "er", "00000000", " ", "\x85"]


@pytest.fixture(scope="module")
def both():
    ref = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    ref.encode_special_tokens = True
    return bpe.automaton(bpe.default_vocabulary()), ref


def ids(auto, text):
    return [int(i) for part in auto.encode(text) for i in part]


def test_equals_the_library(both):
    auto, ref = both
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += ["a" * 3001, "=" * 2999, " " * 3000 + "x", "ab" * 1500, "\n" * 999, "ก" * 700, "x\n" * 500, ""]
    for t in texts:
        own = ids(auto, t)
        assert own == ref.encode(t, add_special_tokens=False).ids, repr(t)
        assert auto.decode(own).decode() == t


def test_every_token_is_its_own_encoding_or_splits_the_same(both):
    auto, ref = both
    for token, label in list(auto.labels.items())[::37]:
        own = auto.word(label)
        assert b"".join(auto.labels[t] for t in own) == label
        assert (own == (token,)) == (auto.ids.get(label) == token)


def test_tables_stay_as_compiled(both):
    """Unlike words fill memos of a fixed size only."""
    auto, _ = both
    sizes = [len(t) for t in (auto.go, auto.fail, auto.ends, auto.shorter, auto.merge, auto.memo, auto.memo_keys)]
    rng = random.Random(2)
    for _ in range(300):
        auto.encode("".join(chr(rng.choice([rng.randrange(97, 123), rng.randrange(0x400, 0x500), rng.randrange(0x4E00, 0x9000)])) for _ in range(400)))
    assert [len(t) for t in (auto.go, auto.fail, auto.ends, auto.shorter, auto.merge, auto.memo, auto.memo_keys)] == sizes and len(auto.memo) == bpe.ARCS


def test_documents(spark):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "é" * 10_000, "x"), (1, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode_documents(df).collect()]
    assert len(got) == 5 and (2, []) in got and (3, []) in got and got.count((1, [15496, 995])) == 2
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(df)).collect()}
    assert back == {1: "Hello world", 2: "", 3: "", 4: "é" * 10_000}
    assert bpe.encode_documents(df.limit(0)).count() == 0
    assert os.path.exists(bpe.default_vocabulary())


def test_memo_of_lines_is_bounded(both, monkeypatch):
    auto, _ = both
    monkeypatch.setattr(bpe, "LINES", 500)
    for k in range(100):
        auto.encode(f"line {k} of unlike text")
        assert sum(map(len, auto.lines)) <= 500
