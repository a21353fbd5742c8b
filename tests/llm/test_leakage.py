import itertools
import random

import pytest

pytest.importorskip("draftlake.llm.leakage")

from draftlake.llm import leakage as L  # noqa: E402


def always_hit(masks, length, altered):
    placed = [sum(1 << (s + k) for k in m) for m in masks for s in range(length - m[-1])]
    return all(any(not p & sum(1 << x for x in bad) for p in placed) for bad in itertools.combinations(range(length), altered))


def test_masks_miss_nothing():
    assert always_hit(L.WORD_MASKS, 20, 2) and always_hit(L.WORD_MASKS, 30, 3)
    assert always_hit(L.CHAR_MASKS, 30, 3)


WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ara", "elo", "ino", "uta", "oke")]


def brute(doc, item, least):
    for d in range(len(doc) - least + 1):
        for e in range(len(item) - least + 1):
            bad = 0
            for k in range(min(len(doc) - d, len(item) - e)):
                bad += doc[d + k] != item[e + k]
                if k + 1 >= least and bad * 10 <= k + 1:
                    return True
    return False


def test_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(i, "en", " ".join(rng.choice(WORDS) for _ in range(rng.choice([15, 20, 40, 60]))), " ".join(rng.choice(WORDS) for _ in range(25))) for i in range(25)]
    docs = []
    for i in range(250):
        item = rng.choice(items)
        words = (item[2] if rng.random() < 0.7 else item[3]).split()
        start = rng.randrange(max(1, len(words) - 18))
        part = words[start : start + rng.choice([18, 19, 20, 21, 30, 60])]
        for k in range(len(part)):
            if rng.random() < rng.choice([0.0, 0.06, 0.12]):
                part[k] = "zzz"
        around = [rng.choice(WORDS) for _ in range(10)]
        docs.append((i, around + part + around))
    ddl = "doc_id bigint, text string, item_id string"
    got = {(r["doc_id"], r["item_id"]) for r in L.leaks(spark.createDataFrame([(i, " ".join(w), "x") for i, w in docs], ddl), spark.createDataFrame(items, "item_id bigint, lang string, text string, question string")).collect()}
    want = {(i, item[0]) for i, w in docs for item in items if brute(w, item[2].split(), 20) or brute(w, item[3].split(), 20)}
    assert got == want and len(want) > 50


PASSAGE = "the quick brown fox jumps over the lazy dog while seven grey cats watch from behind an old wooden garden fence today"


@pytest.mark.parametrize(
    "text,leaks",
    [
        (PASSAGE.upper().replace(" ", ",\n* "), True), (PASSAGE.replace("fox", "[[Fox (animal)|fox]]").replace("dog", "'''dog'''").replace("cats", "<b>cats</b>"), True), (PASSAGE.replace(" ", "&nbsp;"), True),
        ("<!-- " + PASSAGE + " -->", True), ("{{quote|" + PASSAGE + "}}", True), ("| " + PASSAGE.replace(" seven", " || seven"), True), (" ".join(PASSAGE.split()[:19]), False), (" ".join(PASSAGE.split()[::-1]), False), ("", False), (None, False),
        (PASSAGE.replace("fox", "a").replace("lazy", "b"), True), (PASSAGE.replace("fox", "a").replace("lazy", "b").replace("watch", "c"), False),
    ],
)
def test_markup_and_alterations(spark, text, leaks):
    items = spark.createDataFrame([(7, "en", PASSAGE, None), (8, "en", None, ""), (None, "en", PASSAGE, None)], "item_id bigint, lang string, text string, question string")
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id bigint, text string")
    assert [tuple(r) for r in L.leaks(docs, items).collect()] == ([(1, 7)] if leaks else [])


JA = "川の水先案内人の会は、静かな風の帳簿が春の三度目の雪解けのあとで夜ごとに九つの銀の錘を少しずつ溶かし続ける。"
ITEMS = "item_id bigint, lang string, text string, question string"


def test_characters_and_small_filters(spark, monkeypatch):
    items = spark.createDataFrame([(1, "ja", JA, None), (2, "zh", "两代耐心的测量员否认，带纹的纸渡船因为没有人向下游山谷征税在渡口旁从不丈量过冬的存粮，随后又偶尔借用第二层薄膜。", None)], ITEMS)
    docs = spark.createDataFrame([(1, "前" + JA[3:40].replace("風", "火").replace("、", "\n") + "後"), (2, JA[:24]), (3, "x " + JA[:20] + "[[" + JA[20:] + "]]"), (4, " ".join(JA[2:50]))], "doc_id bigint, text string")
    whole = {tuple(r) for r in L.leaks(docs, items).collect()}
    assert whole == {(1, 1), (3, 1), (4, 1)}
    # a filter that lets nearly everything pass, and hashes joined by a shuffle, change nothing
    monkeypatch.setattr(L, "MOST_BITS", 7)
    monkeypatch.setattr(L, "FEWEST_BITS", 7)
    monkeypatch.setattr(L, "BROADCAST_HASHES", 0)
    assert {tuple(r) for r in L.leaks(docs, items).collect()} == whole
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0


def test_many_items_and_shared_passages(spark):
    """An item's passage in a third of all documents, and several items with the same words."""
    rng = random.Random(5)
    items = [(i, "en", " ".join(rng.choice(WORDS) for _ in range(40)), None) for i in range(400)] + [(900 + i, "en", PASSAGE, None) for i in range(3)] + [(950, "ja", JA, PASSAGE)]
    docs = [(i, (PASSAGE if i % 3 == 0 else items[i][2] if i % 3 == 1 else "nothing at all") + f" tail {i}") for i in range(300)]
    got = {tuple(r) for r in L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(i, 900 + k) for i in range(0, 300, 3) for k in (0, 1, 2, 50)} | {(i, i) for i in range(1, 300, 3)}
