import pytest

pytest.importorskip("draftlake.llm.pii")

from pyspark.sql import functions as F  # noqa: E402

from draftlake.llm import mojibake, pii  # noqa: E402

GIVEN = {"greta", "sören", "élodie", "вера", "ivo"}
LEX = pii.Lexicon(GIVEN, set(), {"lnd", "röm", "und", "ück", "rez", "мов", "ist"}, {"anchor", "bolts", "street", "light", "verify", "tube"})


@pytest.mark.parametrize(
    "text,types",
    [
        ("drawn by Greta Halelund", ["NAME"]), ("Halelund, Greta", ["NAME"]), ("G. Halelund", ["NAME"]), ("SÖREN M. HALELUND-BREZ", ["NAME"]), ("Вера Тумамов", ["NAME"]), ("Greta van Halelund a validé", ["NAME"]), ("rev B. Anchor bolts M4", []),
        ("Ivo\nHalelund", ["NAME"]), ("Greta", []), ("ghalelund", []), ("GH", []), ("Halvor Basin Works", []), ("Greta Anchor", []), ("greta.halelund@example.org", ["EMAIL"]), ("Greta Halelund <g@example.org>", ["NAME", "EMAIL"]),
        ("a (at) b.example", ["EMAIL"]), ("mailto:a+b[at]c[dot]d[dot]com", ["EMAIL"]), ("x @ mail.example.com", ["EMAIL"]), ("bolts M87 @ 311 c/c. Tube", []), ("tray @ level 391. Datum", []), ("john at mail dot example dot org", ["EMAIL"]),
        ("tel. +44 (0)20 7946 0152", ["PHONE"]), ("+12345550172 x37", ["PHONE"]), ("01.99.00.77.03", ["PHONE"]), ("(812) 555-0145", ["PHONE"]), ("540.555.0121", ["PHONE"]), ("0049 30 23125 946", ["PHONE"]), ("030/23125-988", ["PHONE"]), ("020\xa07946\xa00798", ["PHONE"]),
        ("Drawing no. 339-555-80 rev B", []), ("Ref. 020-49-187 per schedule", []), ("Datum +285.250 at bench mark", []), ("Отметка +342,150", []), ("25° angle", []),
        ("SSN 666-49-9732", ["ID_NUMBER"]), ("NI AB 12 34 56 C", ["ID_NUMBER"]), ("passport no 123456789", ["ID_NUMBER"]), ("PESEL 44051401359", ["ID_NUMBER"]), ("8 (495) 123-45-67", ["PHONE"]), ("GB29 NWBK 6016 1331 9268 19", []), ("item GB 12 34 56 C", []),
        ("123 Main Boulevard", ["ADDRESS"]), ("12 Oak Court", ["ADDRESS"]), ("via Roma 12", ["ADDRESS"]), ("ул. Ленина 5", ["ADDRESS"]), ("проспект Мира, д. 7", ["ADDRESS"]), ("Greta Ivo Halelund", ["NAME"]), ("via hole 12", []), ("court 12", []), ("soc. sec. no. 000 57 5425", ["ID_NUMBER"]), ("NI number QQ 14 61 06 C", ["ID_NUMBER"]), ("passport ZZ0097337", ["ID_NUMBER"]), ("DNI 00054004-G", ["ID_NUMBER"]), ("Steuer-ID 00 998 792 221", ["ID_NUMBER"]),
        ("Ausweis-Nr. L00X78234T", ["ID_NUMBER"]), ("licence no. DL-59616-XX-675", ["ID_NUMBER"]), ("ID: 000743087", ["ID_NUMBER"]),
        ("33 Orben Lane, Brennick", ["ADDRESS"]), ("ul. Brzezowa 90/11", ["ADDRESS"]), ("Calle del Olmo Seco 275, 2º B", ["ADDRESS"]), ("225, rue des Tanneurs-Bleus, Brennick", ["ADDRESS"]), ("Orbenstraße\n242, 00242 Villarén", ["ADDRESS"]),
        ("289 QUILLON AVENUE APT 20", ["ADDRESS"]), ("Flat 28, Culver Dene House, Minor Road, Quellstadt", ["ADDRESS"]), ("Grid line 332 / lane 2", []), ("Street light type 184, pole 384", []), ("", []), (" ", []),
    ],
)
def test_forms(text, types):
    assert [k for _, _, k in pii.find(text, LEX)] == types


@pytest.mark.parametrize(
    "text,types",
    [
        ("Mirte Unbekannt", ["NAME"]), ("Unbekannt, Mirte <m@example.org>", ["NAME", "EMAIL"]), ("£. Zeliström", ["NAME"]), ("Dr. Mirte van Unbekannt / 030/23125-988", ["NAME", "PHONE"]), ("Halvor Basin Works", []), ("CAD Team 3", []),
        ("Survey Dept.", []), ("Orben Ingenieure GmbH", []), ("Bureau d'études Vé-Nord", []), ("Plotter room", []), ("Administrator", []), ("mlv", []), ("MLV", []), ("-", []), ("Steel Works", []),
    ],
)
def test_name_fields(text, types):
    assert [k for _, _, k in pii.find(text, LEX, True)] == types


def test_positions_lead_back_to_the_stored_text():
    stored = "{\\fArial|b0;see \\LGreta Halelund\\l}\\Pcall 020 7946 0798 %%d \\U+00D8"
    view = pii.View(stored, None)
    cut = [stored[slice(*view.stored(a, b))] for a, b, _ in pii.find(view.text, LEX)]
    assert cut == ["Greta Halelund", "020 7946 0798"] and view.text.endswith("° Ø")
    broken = pii.View("by Greta\\PHalelund.", None)
    (a, b, kind), = pii.find(broken.text, LEX)
    assert kind == "NAME" and "by Greta\\PHalelund."[slice(*broken.stored(a, b))] == "Greta\\PHalelund"


def test_redaction(spark):
    names = [f"{g} {f}" for g in ("Greta", "Sören", "Élodie", "Ivo") for f in ("Halelund", "Brenelund", "Kesalund", "Wexelund", "Tavolund", "Morelund")]
    garbled = "Sören Halelund".encode().decode("latin-1")
    summary = [(i, n, None, None, T) for i, n in enumerate(names * 3)] + [(900, garbled, "admin", f"drawn by {names[0]}; tel. 020 7946 0798; mail greta@example.org", T), (901, None, "", " ", T), (902, "MAV", "x" * 5000, names[0].replace(" ", "\xa0"), T)]
    s = spark.createDataFrame(summary + summary[:3], "summary_id bigint, author string, last_saved_by string, comments string, shown string")
    m = spark.createDataFrame([(1, ("Contact Ivo Halelund\\Pfor access, Ivo Halelund",)), (2, None), (3, ("nothing",))], "object_id bigint, rec struct<text:string>")
    fields = mojibake.fields_of(s, m, ("author", "last_saved_by", "comments"))
    model = mojibake.train(fields)
    is_name = F.col("field").isin("author", "last_saved_by")
    lexicon = pii.learn(fields.filter(is_name), fields.filter(~is_name), model)
    assert lexicon.given == {"greta", "sören", "élodie", "ivo"}
    found = pii.entities(fields, lexicon, model).cache()
    kinds = {(r["src_table"], r["rec_id"], r["field"], r["pii_type"]) for r in found.collect()}
    assert {("summary_info", 900, "comments", k) for k in ("NAME", "PHONE", "EMAIL")} <= kinds and ("summary_info", 900, "author", "NAME") in kinds and ("summary_info", 902, "comments", "NAME") in kinds
    assert not any(r[1] == 902 and r[2] != "comments" or r[1] == 901 for r in kinds)
    out = {(r["rec_id"], r["field"]): r for r in pii.redact(fields, found, b"key").collect()}
    comment = out[900, "comments"]["placeholders"]
    assert comment.startswith("drawn by [NAME_") and "; tel. [PHONE_" in comment and comment.count("[") == 3
    # one person, one replacement; different people, different ones
    assert out[0, "author"]["surrogates"] == out[len(names), "author"]["surrogates"] and len({out[i, "author"]["surrogates"] for i in range(len(names))}) == len(names)
    assert out[0, "author"]["placeholders"] in comment
    note = out[1, "text"]["surrogates"]
    assert note.startswith("Contact ") and "\\Pfor access, " in note and "Halelund" not in note and note.split("\\P")[0][8:] == note.split("access, ")[1]
    phone = out[900, "comments"]["surrogates"].split("tel. ")[1][:13]
    assert [c.isdigit() for c in phone] == [c.isdigit() for c in "020 7946 0798"] and phone != "020 7946 0798"
    empty = fields.limit(0)
    assert pii.redact(empty, pii.entities(empty, lexicon, model), b"key").count() == 0
    assert pii.learn(empty, empty, model).given == set()


def corpus(spark, authors, comments):
    """NAMEs found in comments, by comment."""
    rows = [("summary_info", i, "author", a) for i, a in enumerate(authors)] + [("summary_info", i, "comments", c) for i, c in enumerate(comments)]
    fields = spark.createDataFrame(rows, "src_table string, rec_id bigint, field string, text string").repartition(4)
    model = mojibake.train(fields)
    lexicon = pii.learn(fields.filter("field = 'author'"), fields.filter("field = 'comments'"), model)
    found = pii.entities(fields, lexicon, model).filter("field = 'comments' and pii_type = 'NAME'").collect()
    return {(r["rec_id"], r["shown"]) for r in found}


def test_families_of_rare_endings_are_known(spark):
    authors = [f"{g} {f}" for g in ("Greta", "Ivo") for f in ("Quiblox", "Zandvurm", "Teakhop")]
    comments = ["checked by G. Quiblox", "see I. Zandvurm-Teakhop", "see I. Unheard", "bolts by B. Anchor", "Gr\ufffdta Zandvurm", ""]
    assert corpus(spark, authors, comments) == {(0, "G. Quiblox"), (1, "I. Zandvurm-Teakhop"), (4, "Gr\ufffdta Zandvurm")}


def test_frequent_names_are_no_ordinary_words(spark):
    authors = [f"{g} {f}" for g in ("Greta", "Ivo") for f in ("Halelund", "Brenelund")]
    comments = [f"checked by Greta Zylstra, plan {k}" for k in range(20)] + [f"verify anchor {k}" for k in range(20)] + ["Greta Anchor", "Ivo Rundeck"]
    assert corpus(spark, authors, comments) == {(k, "Greta Zylstra") for k in range(20)} | {(41, "Ivo Rundeck")}


def test_a_word_that_mostly_stands_alone_gives_way():
    lexicon = pii.Lexicon({"greta"}, {"halelund"}, set(), set(), {"tolerance"})
    assert pii.find("Halelund, Greta Tolerance 5", lexicon) == [(0, 15, "NAME")] and pii.find("Greta Tolerance", lexicon) == [(0, 15, "NAME")]


FORMS = "pii_type string, canonical string, shown string"


def replaced(spark, shown):
    rows = [("NAME", pii.canonical("NAME", s), s) for s in shown]
    return {r["shown"]: r["surrogate"] for r in pii.replacements(spark.createDataFrame(rows, FORMS), b"k").collect()}


def test_collisions_draw_again(spark, monkeypatch):
    real = pii.word_surrogate
    monkeypatch.setattr(pii, "word_surrogate", lambda key, role, word, attempt: "same" if attempt == 0 else real(key, role, word, attempt))
    got = replaced(spark, ["Ann Lund", "Bob Lund", "Cid Berg", "ANN LUND"])
    assert len({v.casefold() for v in got.values()}) == 3 and got["Ann Lund"].upper() == got["ANN LUND"]


def test_persons_stay_the_same_and_distinct(spark):
    shown = ["John Smith", "J. Smith", "Smith, John", "JOHN SMITH", "Mary Smith", "John Jones", "J. Jones", "Mary Ann Smith-Jones", "Вера Иванова", "В. Иванова", "Νίκος Πάππος", "Anna Kowalska", "van Smith, John", "S\ufffdren Smith"]
    got = replaced(spark, shown)
    words = {s: pii._WORDS_OF.findall(v) for s, v in got.items()}
    family, given = words["John Smith"][1], words["John Smith"][0]
    assert words["J. Smith"] == [given[0], family] and words["Smith, John"] == [family, given] and words["JOHN SMITH"] == [given.upper(), family.upper()]
    assert words["Mary Smith"][1] == family and words["John Jones"][0] == given and words["John Jones"][1] != family and words["Mary Ann Smith-Jones"] == [words["Mary Smith"][0], words["Mary Ann Smith-Jones"][1], family, words["John Jones"][1]]
    assert words["van Smith, John"] == ["van", family, given]
    assert pii._script(got["Вера Иванова"]) == "Cyrillic" and words["Вера Иванова"][1].endswith("ова") and words["В. Иванова"][1] == words["Вера Иванова"][1] and words["В. Иванова"][0] == words["Вера Иванова"][0][0]
    assert pii._script(got["Νίκος Πάππος"]) == "Greek" and words["Anna Kowalska"][1].endswith("ska")
    real = {w.casefold() for s in shown for w in pii._WORDS_OF.findall(s) if len(w) > 1} - {"van"}
    assert not real & {w.casefold() for ws in words.values() for w in ws}
    assert len({v.casefold() for v in got.values()}) == len(shown) - 1


@pytest.mark.parametrize("kind,shown,form", [("PHONE", "+44 (0)20 7946 0152", r"\+44 \(\d\)\d\d \d{4} \d{4}"), ("PHONE", "0049 30 23125 946", r"0049 \d\d \d{5} \d{3}"), ("PHONE", "+12345550172", r"\+1\d{10}"), ("ID_NUMBER", "SSN", "[A-Z][a-z]*|.*"), ("EMAIL", "a.b@mail.example.org", r"\w+\.\w+@\w+\.\w+\.\w+"), ("ADDRESS", "33 Orben Lane, Brennick", r"\d\d \w+ Lane, \w+")])
def test_forms_are_kept(kind, shown, form):
    import regex

    new = pii.surrogate(b"k", kind, shown, pii.canonical(kind, shown), 0)
    assert regex.fullmatch(form, new) and new != shown
    number = pii.surrogate(b"k", "ID_NUMBER", "00054004-G", "00054004g", 0)
    assert pii.DNI[int(number[:8]) % 23] == number[-1]


def test_surrogates_are_distinct_over_all_rounds(spark):
    numbers = [str(n) for n in range(100, 400)]
    got = pii.replacements(spark.createDataFrame([("PHONE", n, n) for n in numbers], "pii_type string, canonical string, shown string"), b"k").collect()
    new = [r["surrogate"] for r in got]
    assert len(new) == len(set(new)) == 300 and not set(new) & set(numbers)


@pytest.mark.parametrize("turned,straight", [("Draoski, Soren", "Soren Draoski"), ("DRAOSKI-LIND, Soren M.", "Soren M. Draoski-Lind"), ("van Draoski, Soren", "Soren van Draoski")])
def test_turned_names_are_one_person(spark, turned, straight):
    canon = pii.canonical("NAME", straight)
    assert pii.canonical("NAME", turned) == canon
    got = replaced(spark, [turned, straight])
    assert "," in got[turned] and pii.canonical("NAME", got[turned]) == pii.canonical("NAME", got[straight]) != canon


T = "x"
