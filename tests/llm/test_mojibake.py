import random

import pytest

pytest.importorskip("draftlake.llm.mojibake")

from draftlake.llm import mojibake as M  # noqa: E402

SENTENCES = [
    "Größe der Öffnung 12 × 34", "Prüfstatik für Träger", "Câble enterré à 5 m, réseau électrique", "Détail façade côté cour", "Señalización provisional", "Żelbetowa ściana grubości", "Łazienka – płytki ścienne", "Přístupová cesta k čerpací stanici",
    "Отметка чистого пола", "Сечение колонны по расчёту", "配管図 第3号", "寸法は現場で確認すること", "ELEVAÇÃO PRINCIPAL – REVISÃO", "Nivå för källargolv", "├─ branch 39 └─ end", "Tolerance ±0.3, hole Ø17", "Anchor bolts @ 9 c/c", "Room – floor finish",
]


def garble(text, true, wrong):
    return text.encode(true).decode(wrong)


CASES = [
    ("Größe der Öffnung 77 × 8", "utf-8", "latin-1"), ("réseau électrique", "utf-8", "cp1252"), ("Prüfstatik für Träger", "utf-8", "cp1251"), ("Câble enterré à 9 m", "utf-8", "cp437"), ("Señalización provisional", "utf-8", "cp850"),
    ("réseau électrique", "cp1252", "cp1251"), ("Prüfstatik für Träger", "cp1252", "cp437"), ("façade côté cour", "cp1252", "mac_roman"), ("Сечение колонны по расчёту", "cp1251", "cp1252"), ("grubości płytki ściana", "cp1250", "cp1252"),
    ("Отметка чистого пола", "utf-8", "cp1252"), ("配管図 第3号", "utf-8", "cp437"), ("寸法は現場で確認すること", "utf-8", "latin-1"),
]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    texts = [rng.choice(SENTENCES) for _ in range(3000)] + [garble(t, a, b.replace("cp1252", "latin-1") if a == "utf-8" else b) for t, a, b in CASES] * 5
    rows = [(1, t) for t in texts] + [(2, ""), (3, None)]
    return M.train(spark.createDataFrame(rows, "k int, text string"))


@pytest.mark.parametrize("text,true,wrong", CASES)
def test_restores(model, text, true, wrong):
    shown = "".join(c.encode(true).decode(wrong) if wrong != "cp1252" or true != "utf-8" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in c.encode()) for c in text) if true != "utf-8" or wrong in ("cp1252",) else garble(text, true, wrong)
    fixed, spans, pairs = model.repair(shown)
    assert fixed == text and spans and pairs
    mixed, spans, _ = model.repair("Anchor bolts @ 9 c/c " + shown)
    assert mixed == "Anchor bolts @ 9 c/c " + text


def test_twice_and_wide(model):
    twice = garble(garble("réseau électrique", "utf-8", "latin-1"), "utf-8", "latin-1")
    assert model.repair(twice)[0] == "réseau électrique"
    assert model.repair("Room floor finish ".encode().decode("utf-16-le"))[0].strip() == "Room floor finish"


@pytest.mark.parametrize("text", SENTENCES + ["", " ", "plain", "\\A1;{\\C3;Größe}\\PØ5 – ±2"])
def test_leaves_proper_text(model, text):
    assert model.repair(text) == (text, [], [])


def test_rows(spark, model):
    s = spark.createDataFrame([(1, garble("Prüfstatik", "utf-8", "latin-1"), None, "x"), (1, garble("Prüfstatik", "utf-8", "latin-1"), None, "x"), (2, "", None, "x"), (3, "Prüfstatik", None, "x")], "summary_id bigint, title string, author string, restored string")
    m = spark.createDataFrame([(1, (None,)), (2, ("ok",)), (3, None)], "object_id bigint, rec struct<text:string>")
    rows = M.garbled(M.fields_of(s, m, ("title", "author")), model).collect()
    assert [(r["src_table"], r["rec_id"], r["field"], r["restored"], r["complete"]) for r in rows] == [("summary_info", 1, "title", "Prüfstatik", True)]
    empty = M.fields_of(s.limit(0), m.limit(0), ("title",))
    assert M.garbled(empty, M.train(empty)).count() == 0


RARE = [(t, a, b) for t in ("Сечение колонны по расчёту", "Отметка чистого пола", "Größe der Öffnung", "réseau électrique", "配管図 第3号", "寸法は現場で確認すること", "Müller Straße", "Przekrój słupa", "Ώρα λειτουργίας") for a, b in M.PAIRS[14:] + (("iso8859-7", "cp1252"), ("hz", "cp1252"))]


def test_rare_pairs_are_restored_or_left(model):
    """Texts garbled by pairs that the corpus doesn't hold come back whole, or stay; no word becomes another text."""
    restored = tried = wrong = 0
    for text, true, read in RARE:
        try:
            shown = text.encode(true).decode(read)
        except UnicodeError:
            continue
        if shown == text or not shown.isprintable():
            continue
        fixed = model.repair(shown)[0]
        tried += 1
        for was, now, meant in zip(shown.split(" "), fixed.split(" "), text.split(" ")):
            restored += now == meant != was
            wrong += now not in (was, meant)
    assert tried > 20 and restored > 25 and wrong <= restored // 20, (tried, restored, wrong)


def test_garbled_many_times(model):
    shown = "réseau électrique"
    for _ in range(5):
        shown = garble(shown, "utf-8", "latin-1")
    assert model.repair(shown)[0] == "réseau électrique"


def test_states_are_fitted(model):
    usual, rare = [n for n, _ in M.UNITS].index("utf-8 as cp1252"), [n for n, _ in M.UNITS].index("cp866 as cp1251")
    assert model.enter[usual] < model.enter[rare] and M.STRICT[rare] and not M.STRICT[usual]
