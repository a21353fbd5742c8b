"""Personal information in free text, found and replaced.

Emails, phone numbers, identity numbers and street addresses are found by their
forms, names by lexicons that the corpus itself yields: a given name stands
before many different words in the author fields, a family name behind given
names. Text is searched with its drawing codes resolved and wrong encodings
undone, and every find is mapped back to the stored text.

Each entity gets a keyed replacement of its type: a placeholder with a keyed
tag, and a surrogate of the same script, gender and format. Entities are
compared across the whole corpus, so that one entity is always replaced by the
same surrogate and two never by one.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.mojibake import LOST, Model
from draftlake.runtime import checkpoint

#: Fields that are there for a person's name.
NAME_FIELDS = ("author", "last_saved_by")
TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

#: A given name is followed by at least so many different family names, or by one that ends as many do.
PARTNERS = 2
#: A family name ends as at least so many others do, in this many letters.
FAMILIES, SUFFIX = 5, 3

# Words in names of firms, departments and machines.
ORGANISATION = frozenset(
    "ab ag admin administrator agency and architects architekten associates basin bureau büro cad co company consultants contractor contractors council department dept design division draughting drafting engineering engineers gmbh "
    "group guest inc ingenieure institute kg lab laboratory llc ltd municipality office operator partners plot plotter plt printer project room sa sarl scanner server service services studio survey surveyors system team technical "
    "the university unknown user utilities water works workstation".split()
)

_CODES = regex.compile(r"\\U\+([0-9A-Fa-f]{4})|%%([dcpDCP])|(\\[P~])|\\[ACcFfHhQTWSp][^;\\{}\n]*;|\\[LlOoKkNX]|(\\[\\{}])|[{}]")
_SYMBOL = {"d": "°", "c": "⌀", "p": "±"}

_EMAIL = regex.compile(
    r"(?ix)(?:mailto:\s*)?(?<![\w.+-])[\p{L}\p{N}_][\p{L}\p{N}_.+%-]*"
    r"(?:\s{0,2}@\s{0,2}|\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+(?=[\w-]+\s+dot\s))"
    r"[\p{L}\p{N}-]+(?:(?:\.|\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+)[\p{L}\p{N}-]+)*(?:\.|\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+)\p{L}{2,}(?![\p{L}\p{N}])"
)
_PHONE = regex.compile(
    r"(?x)(?<![\p{L}\p{N}+.,/-]) (?:"
    r"\+\d{9,15}"
    r"|\+33\s\d(?:\s\d{2}){4}|\+44\s\(0\)\d{2}\s\d{4}\s\d{4}|\+1\s\d{3}\s\d{3}\s\d{4}|0049\s\d{2}\s\d{5}\s\d{3}"
    r"|\+\d{1,3}[^\S\n]?(?:\(\d{1,4}\)[^\S\n]?)?\d{1,4}(?:[.\-]\d{2,5}|[^\S\n]\d{2,5}){1,6}"
    r"|00\d{2}[^\S\n]\d{1,4}(?:[^\S\n]\d{2,6}){1,4}"
    r"|\(\d{3}\)\s?\d{3}[\s.-]\d{4}"
    r"|8[\s-]?\(\d{3}\)\s?\d{3}-\d{2}-\d{2}"
    r"|\d{3}\.\d{3}\.\d{4}|[2-9]\d{2}-\d{3}-\d{4}"
    r"|0\d(?:[\s.]\d{2}){4}"
    r"|0\d{2,4}[\s/]\d{3,6}[\s-]\d{3,5}"
    r")(?:\s?(?:x|ext\.?)\s?\d{1,5})?(?![\p{L}\p{N}]|[.,-]\d)"
)
#: Identity numbers by their form alone, and those that follow a word; a text without any of the words needs no look for the latter.
_ID_BARE = regex.compile(
    r"(?x)(?<![\p{L}\p{N}-]) (?:"
    r"\d{3}-\d{2}-\d{4}"
    r"|(?:QQ|(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z])\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]"
    r"|\d{8}-\p{Lu}|L\d{2}X\w{5,7}|DL-\d{4,6}-[A-Z]{2}-\d{2,4}"
    r")(?![\p{L}\p{N}])"
)
_ID_WORDS = ("soc", "ssn", "passport", "pesel", "dni", "nie", "steuer", "tax", "ausweis", "identity", "licen", "id:")
_ID_NAMED = regex.compile(
    r"(?x)(?<![\p{L}\p{N}-]) (?:"
    r"(?<=soc\.\s?sec\.\s?no\.\s{1,3}|SSN:?\s{1,3})\d{3}\s?-?\d{2}\s?-?\d{4}"
    r"|(?<=(?i:passport(?:\sno\.?|\snumber)?:?)\s{1,3})\p{Lu}{0,2}\s?\d{6,9}"
    r"|(?<=PESEL:?\s{1,3})\d{11}"
    r"|(?<=(?i:DNI|NIE):?\s{1,3})[XYZ]?\d{7,8}-?\p{Lu}"
    r"|(?<=(?i:Steuer-ID|Steuernummer|tax\sID)(?:\sNr\.?)?:?\s{1,3})\d{2}(?:\s?\d{3}){3}"
    r"|(?<=(?i:Ausweis(?:-?Nr\.?|nummer)|identity\scard(?:\sno\.?)?):?\s{1,3})[A-Z0-9]{8,12}"
    r"|(?<=(?i:licen[cs]e(?:\sno\.?|\snumber)?):?\s{1,3})[A-Z]{1,3}-?\d{3,}[\w-]*"
    r"|(?<=(?-i:ID):\s{0,3})\d{8,12}"
    r")(?![\p{L}\p{N}])"
)
#: Parts of a text one of which every form of an address holds, in lower case.
_STREETS = (
    "lane street road avenue drive close way boulevard blvd court terrace crescent gardens grove mews parkway st. rd. ave strasse str. weg gasse platz allee calle avda plaza rue place ul. al. via piazza corso ул пр. проспект пер. наб.".split()
)
_W = r"\p{Lu}[\p{L}'’-]*"
_TOWN = rf"(?:,\s+(?:\d{{4,5}}\s+)?{_W}(?:\s(?:Cross|Green|Heath|Hill|Bay|Bridge|Park))?)?"
_ADDRESS = regex.compile(
    rf"(?x)(?<![\p{{L}}\p{{N}}]) (?:"
    rf"Flat\s+\d+[a-zA-Z]?,\s+(?:{_W}\s+){{1,3}}House,\s+(?:{_W}\s+){{1,3}}(?:Road|Street|Lane|Avenue){_TOWN}"
    rf"|\d{{1,5}}\s?[a-zA-Z]?\s+(?:{_W}\s+){{1,3}}(?:(?:Lane|Street|Road|Avenue|Drive|Close|Way|Boulevard|Court|Terrace|Crescent|Gardens|Grove|Mews|Parkway|LANE|STREET|ROAD|AVENUE|Ave)(?![\p{{L}}])|St\.|ST\.|Rd\.|Ave\.|Blvd\.)(?:\s+(?:APT|Apt|Flat|Unit)\.?\s+\d+)?{_TOWN}"
    rf"|(?:\p{{L}}+(?:straße|strasse|STRASSE|str\.|weg|gasse|platz|allee))\s+\d{{1,4}}\s?[a-zA-Z]?(?![\p{{L}}\p{{N}}]){_TOWN}"
    rf"|(?:Calle|Avda\.|Avenida|Plaza|CALLE)\s+(?:(?:del|de|la|las|los|DEL|DE)\s+)*{_W}(?:\s+{_W})*\s+\d{{1,4}}(?:,\s+\d+\s?º\s+[A-Z])?"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|RUE)\s+(?:(?:des|de|du|la|le|les|DES)\s+|d')*{_W}{_TOWN}"
    rf"|(?:via|viale|Via|Viale|Piazza|Corso)\s+{_W}(?:\s+{_W}){{0,2}},?\s+\d{{1,4}}(?![\p{{L}}\p{{N}}])"
    rf"|(?:ул\.|улица|пр\.|проспект|пер\.|наб\.)\s+{_W}(?:\s+{_W})?,?\s+(?:д\.\s*)?\d{{1,4}}(?![\p{{L}}\p{{N}}])"
    rf"|(?:ul\.|al\.|UL\.)\s+{_W}(?:\s+{_W})?\s+\d{{1,4}}(?:/\d{{1,4}})?"
    rf")"
)
_DIGIT = regex.compile(r"\d")
_PARTICLE = r"(?:(?:van|von|de|der|den|del|di|da|la|le|ter|VAN|VON|DE)\s+){0,2}"
_NW = r"[\p{Lu}" + LOST + r"][\p{L}\p{M}'’" + LOST + r"]+"
_FULL = regex.compile(rf"(?<![\p{{L}}\p{{N}}@._+-])({_NW})\s+((?:\p{{Lu}}\.\s*){{0,2}})({_PARTICLE})({_NW}(?:-{_NW})?)(?![\p{{L}}\p{{N}}@_])")
_TURNED = regex.compile(rf"(?<![\p{{L}}\p{{N}}@._+-])({_PARTICLE})({_NW}(?:-{_NW})?),\s+({_NW})(?:\s+\p{{Lu}}\.)?(?![\p{{L}}\p{{N}}@_])")
#: Two given names before the family.
_DOUBLE = regex.compile(rf"(?<![\p{{L}}\p{{N}}@._+-])({_NW}\s+{_NW})\s+({_PARTICLE})({_NW}(?:-{_NW})?)(?![\p{{L}}\p{{N}}@_])")
#: What a part of a bank account number stands behind.
_ACCOUNT = regex.compile(r"(?r)(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4})*\s?$")
_INITIAL = regex.compile(rf"(?<![\p{{L}}\p{{N}}@._+-])(?:[\p{{Lu}}{LOST}]\.\s*){{1,3}}({_PARTICLE})({_NW}(?:-{_NW})?)(?![\p{{L}}\p{{N}}@_])")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)*")
#: What stands before a letter with a full stop that is no initial.
_NO_INITIAL = regex.compile(r"(?:\brev|\bNr|\bno|º|\d|[-/])\s*$")


class View:
    """Text with drawing codes resolved and encodings undone, and the way back to stored positions."""

    def __init__(self, stored: str, model: Model | None):
        text, spans, _ = model.repair(stored) if model else (stored, [], [])
        out, steps, at, size = [], [], 0, 0
        for m in _CODES.finditer(text):
            out.append(text[at : m.start()])
            size += m.start() - at
            code, symbol, gap, literal = m.groups()
            new = chr(int(code, 16)) if code else _SYMBOL[symbol.lower()] if symbol else (" " if gap == "\\~" else "\n") if gap else literal[1] if literal else ""
            steps.append((m.start(), m.end(), size, size + len(new)))
            out.append(new)
            size += len(new)
            at = m.end()
        out.append(text[at:])
        self.text, self._maps = "".join(out), (steps, spans)

    def stored(self, start: int, end: int) -> tuple[int, int]:
        for spans in self._maps:
            start, end = self._back(spans, start, False), self._back(spans, end, True)
        return start, end

    @staticmethod
    def _back(spans: list[tuple[int, int, int, int]], pos: int, end: bool) -> int:
        """The place before a change of text; inside a changed piece its start or end."""
        k = bisect.bisect_right(spans, pos if not end else pos - 1, key=lambda s: s[2]) - 1
        # pieces without a length stand before the character at their place
        while k >= 0 and spans[k][2] == spans[k][3]:
            if spans[k][2] < pos or not end:
                return spans[k][1] + pos - spans[k][3]
            k -= 1
        if k < 0:
            return pos
        a, b, c, d = spans[k]
        if pos >= d:
            return b + pos - d
        return b if end else a


class Lexicon:
    """Given names, families, family endings and ordinary words, in lower case: of a corpus, or as far as the words of one text need them."""

    def __init__(self, given: set[str], families: set[str], suffixes: set[str], ordinary: set[str], alone: frozenset[str] | set[str] = frozenset()):
        self.given, self.families, self.suffixes, self.ordinary, self.alone = given, families, suffixes, ordinary, alone
        self._lost: dict[str, bool] = {}

    def is_given(self, word: str) -> bool:
        w = word.casefold()
        if w in self.given:
            return True
        if LOST not in w:
            return False
        if w not in self._lost:
            # a run of lost marks may stand for one letter or several
            shape = regex.compile("".join(".{1,2}" if c == LOST else regex.escape(c) for c in w))
            self._lost[w] = len(w) > 2 * w.count(LOST) and any(shape.fullmatch(g) for g in self.given)
        return self._lost[w]

    def is_family(self, word: str, strict: bool) -> bool:
        parts = word.casefold().split("-")
        for p in parts:
            if p in self.families:
                continue
            if p in self.ordinary or p in self.given:
                return False
            if strict and (p in self.alone or p[-SUFFIX:] not in self.suffixes):
                return False
        return True

    def accepts(self, given: str | None, family: str | None, strict: bool) -> bool:
        """Whether a name's form holds a name; without a family it does anyway."""
        return family is None or (given is None or all(map(self.is_given, given.split()))) and self.is_family(family, strict)


#: What may be an entity: start, end, type, then for names the words that decide.
Candidate = tuple[int, int, str, str | None, str | None, bool]


def names_of(text: str) -> list[Candidate]:
    """Everything in a text that has a name's form."""
    out: list[Candidate] = [(*m.span(), "NAME", m[1], m[4], False) for m in _FULL.finditer(text, overlapped=True)]
    out += [(*m.span(), "NAME", m[1], m[3], False) for m in _DOUBLE.finditer(text, overlapped=True)]
    out += [(*m.span(), "NAME", m[3], m[2], False) for m in _TURNED.finditer(text, overlapped=True)]
    for m in _INITIAL.finditer(text, overlapped=True):
        if not _NO_INITIAL.search(text, max(0, m.start() - 8), m.start()):
            out.append((*m.span(), "NAME", None, m[2], True))
    return out


def candidates(text: str, name_field: bool = False) -> list[Candidate]:
    """What may be an entity of a text, the forms first, then names.

    A field that is there for a name holds one where it has a name's form and no
    word of a firm or department, whether the lexicon knows the name or not.
    """
    out: list[Candidate] = []
    if "@" in text or "at" in text.casefold():
        out += [(*m.span(), "EMAIL", None, None, False) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        low = text.casefold()
        if any(w in low for w in _STREETS):
            out += [(*m.span(), "ADDRESS", None, None, False) for m in _ADDRESS.finditer(text)]
        if any(w in low for w in _ID_WORDS):
            out += [(*m.span(), "ID_NUMBER", None, None, False) for m in _ID_NAMED.finditer(text)]
        out += [(*m.span(), "ID_NUMBER", None, None, False) for m in _ID_BARE.finditer(text)]
        for m in _PHONE.finditer(text):
            if sum(c.isdigit() for c in m[0]) >= 9 and not _ACCOUNT.search(text, 0, m.start()):
                out.append((*m.span(), "PHONE", None, None, False))
    out += names_of(text)
    if name_field:
        for form in (_NAME_FIELD, _TURNED_FIELD, _INITIAL_FIELD):
            m = form.match(text)
            if m and not ORGANISATION.intersection(w.casefold() for w in _WORD.findall(m[0])):
                out.append((m.start("name"), m.end(), "NAME", None, None, False))
                break
    return out


def settle(found: list[Candidate], lexicon: Lexicon) -> list[int]:
    """Places of the candidates that are entities, in the order of the text and without overlaps; longer names go before shorter ones, and those whose family mostly stands alone last."""
    names = [k for k, c in enumerate(found) if c[2] == "NAME" and lexicon.accepts(*c[3:])]
    taken: list[int] = []
    for k in [k for k, c in enumerate(found) if c[2] != "NAME"] + sorted(names, key=lambda k: (not lexicon.alone.isdisjoint((found[k][4] or "").casefold().split("-")), found[k][0] - found[k][1])):
        if all(found[k][1] <= found[t][0] or found[k][0] >= found[t][1] for t in taken):
            taken.append(k)
    return sorted(taken, key=lambda k: found[k][:3])


def find(text: str, lexicon: Lexicon, name_field: bool = False) -> list[tuple[int, int, str]]:
    """Entities (start, end, type) of a text, without overlaps."""
    found = candidates(text, name_field)
    return [found[k][:3] for k in settle(found, lexicon)]


_TITLE = r"^\s*(?:(?:Dr|Prof|Ing|Mr|Mrs|Ms|Mme|Hr|Fr)\.?\s+)*"
_AFTER = r"(?=\s*$|\s*[,(</;])"
_NAME_FIELD = regex.compile(rf"{_TITLE}(?P<name>({_NW})\s+(?:\p{{Lu}}\.\s*){{0,2}}{_PARTICLE}({_NW}(?:-{_NW})?)){_AFTER}")
_TURNED_FIELD = regex.compile(rf"{_TITLE}(?P<name>({_NW}(?:-{_NW})?),\s+({_NW})(?:\s+\p{{Lu}}\.)?){_AFTER}")
_INITIAL_FIELD = regex.compile(rf"{_TITLE}(?P<name>[^\s\p{{N}}]\.\s*(?:\p{{Lu}}\.\s*)?{_PARTICLE}({_NW}(?:-{_NW})?)){_AFTER}")


def _counted(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        model = shared.value
        for batch in batches:
            for is_name, stored in zip(batch.column("is_name").to_pylist(), batch.column("text").to_pylist()):
                text = View(stored, model).text
                if is_name:
                    for form, g, f in ((_NAME_FIELD, 2, 3), (_TURNED_FIELD, 3, 2)):
                        m = form.match(text)
                        if m and LOST not in m[0] and not ORGANISATION.intersection(w.casefold() for w in _WORD.findall(m[0])):
                            for part in m[f].casefold().split("-"):
                                count["pair", m[g].casefold(), part] += 1
                            break
                else:
                    words = {(w.casefold(), w[0].islower()) for whole in _WORD.findall(text) for w in whole.split("-")}
                    for w, low in words:
                        count["low" if low else "capital", w, ""] += 1
                    behind = {((given or "").casefold(), p) for *_, given, family, _ in names_of(text) for p in family.casefold().split("-")}
                    for given, p in behind:
                        count["behind", given.split()[-1] if given else "", p] += 1
                if len(count) > 200_000:
                    yield _batch(count)
                    count.clear()
        yield _batch(count)

    return run


def _batch(count: Counter) -> pa.RecordBatch:
    rows = [(*k, n) for k, n in count.items()]
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(cols[i]), pa.string()) for i in range(3)] + [pa.array(list(cols[3]), pa.int64())], ["kind", "a", "b", "n"])


class WordTable:
    """The lexicon of a corpus as tables, which stay in the cluster: words (word, given, family, ordinary, alone) and endings (ending)."""

    def __init__(self, words: DataFrame, endings: DataFrame):
        self.words, self.endings = words, endings

    @property
    def given(self) -> set[str]:
        """All given names, for a look at small corpora."""
        return {r["word"] for r in self.words.filter("given").collect()}

    def of_rows(self, needed: DataFrame) -> DataFrame:
        """(row, lexicon) for `needed` (row, words): what the tables hold of each row's words."""
        each = needed.select("row", F.explode("words").alias("word")).distinct()
        known = each.join(self.words, "word", "left").withColumn("ending", F.right("word", F.lit(SUFFIX)))
        known = known.join(self.endings.withColumn("usual", F.lit(True)), "ending", "left")
        # a run of lost marks may stand for one letter or several, so names meet by what stands before and behind it
        lost = each.select("word").distinct().filter(F.contains("word", F.lit(LOST))).select("word", F.substring_index("word", LOST, 1).alias("head"), F.substring_index("word", LOST, -1).alias("tail"))
        splits = self.words.filter("given").select(F.col("word").alias("name"), F.explode(F.expr("sequence(0, length(word))")).alias("i")).withColumn("j", F.explode(F.expr("sequence(0, length(name) - i)")))
        splits = splits.select("name", F.expr("left(name, i)").alias("head"), F.expr("right(name, j)").alias("tail"))
        shape = F.concat(F.lit("^"), F.replace("word", F.lit(LOST), F.lit(".{1,2}")), F.lit("$"))
        meant = lost.join(splits, ["head", "tail"]).withColumn("shape", shape).filter("name rlike shape").groupBy("word").agg(F.min("name").alias("name"))
        known = known.unionByName(each.join(meant, "word").select("row", F.col("name").alias("word"), F.lit(True).alias("given")), allowMissingColumns=True)
        flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("given", "family", "ordinary", "alone", "usual")]
        return known.filter("given or family or ordinary or alone or usual").groupBy("row").agg(F.collect_list(F.struct("word", *flags)).alias("lexicon"))


def learn(names: DataFrame, texts: DataFrame, model: Model) -> WordTable:
    """Lexicon of all rows of `names` (column text: author fields) and `texts` (column text: free text).

    Family names are those behind given names; endings come by their letters.
    Words are judged by their use, however many texts hold them: an ordinary
    word stands in lower case in more texts than behind a given name or initial,
    and one that stands alone does so in lower case or with a capital.
    """
    rows = names.select(F.lit(True).alias("is_name"), "text").unionByName(texts.select(F.lit(False).alias("is_name"), "text"))
    counts = checkpoint(rows.mapInArrow(_counted(model.broadcast(rows.sparkSession)), "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    pairs = counts.filter("kind = 'pair'").withColumn("ending", F.expr(f"right(b, {SUFFIX})"))
    endings = checkpoint(pairs.groupBy("ending").agg(F.countDistinct("b").alias("families")).filter(F.col("families") >= FAMILIES).select("ending"))
    usual = F.max(F.coalesce("usual", F.lit(False))).alias("usual")
    first = pairs.join(endings.withColumn("usual", F.lit(True)), "ending", "left").groupBy("a").agg(F.count("*").alias("partners"), usual)
    given = checkpoint(first.filter((F.col("partners") >= PARTNERS) | F.col("usual")).select("a"))
    family = pairs.join(given, "a", "left_semi").select(F.col("b").alias("a")).distinct()
    behind = counts.filter("kind = 'behind'").join(given.withColumn("is_given", F.lit(True)), "a", "left")
    behind = behind.filter("is_given or a = ''").select(F.col("b").alias("a"), F.lit("behind").alias("kind"), "n")
    times = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("low", "capital", "behind")]
    uses = counts.filter("kind in ('low', 'capital')").select("a", "kind", "n").unionByName(behind).groupBy("a").agg(*times)
    uses = uses.join(family, "a", "left_anti").join(given, "a", "left_anti").select("a", (F.col("low") > F.col("behind")).alias("ordinary"), (F.col("low") + F.greatest(F.col("capital") - F.col("behind"), F.lit(0)) > F.col("behind")).alias("alone"))
    each = [df.select(F.col("a").alias("word"), F.lit(name).alias("flag")) for df, name in ((given, "given"), (family, "family"), (uses.filter("ordinary"), "ordinary"), (uses.filter("alone"), "alone"))]
    words = reduce(DataFrame.unionByName, each).groupBy("word").agg(*[F.max(F.col("flag") == name).alias(name) for name in ("given", "family", "ordinary", "alone")])
    return WordTable(checkpoint(words), endings)


_FOUND = "start_pos int, end_pos int, pii_type string, shown string, canonical string"
_CANDIDATE = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("given", pa.string()), ("family", pa.string()), ("strict", pa.bool_()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("shown", pa.string())])


def entities(fields: DataFrame, lexicon: WordTable, model: Model) -> DataFrame:
    """Every entity of (src_table, rec_id, field, text): key columns, start_pos, end_pos (in the stored text), pii_type, shown, canonical.

    Texts are searched once for all that may be an entity; the words of these
    candidates are looked up in the lexicon by joins, then each text is decided.
    """

    shared = model.broadcast(fields.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep, items, words = [], [], []
            for i, (stored, field) in enumerate(zip(batch.column("text").to_pylist(), batch.column("field").to_pylist())):
                view = View(stored, model)
                found = candidates(view.text, field in NAME_FIELDS)
                if not found:
                    continue
                own, needed = [], set()
                for a, b, kind, given, family, strict in found:
                    s, e = view.stored(a, b)
                    own.append({"a": a, "b": b, "kind": kind, "given": given, "family": family, "strict": strict, "start_pos": s, "end_pos": e, "shown": view.text[a:b]})
                    needed.update((given.casefold().split() if given else []) + (family.casefold().split("-") if family else []))
                keep.append(i)
                items.append(own)
                words.append(sorted(needed))
            part = batch.select(["src_table", "rec_id", "field"]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(items, pa.list_(_CANDIDATE)), pa.array(words, pa.list_(pa.string()))], [*part.schema.names, "items", "words"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, (items, known) in enumerate(zip(batch.column("items").to_pylist(), batch.column("lexicon").to_pylist())):
                has = lambda flag: {w["word"] for w in known or [] if w[flag]}  # noqa: B023, E731
                own = Lexicon(has("given"), has("family"), {w[-SUFFIX:] for w in has("usual")}, has("ordinary"), has("alone"))
                for k in settle([(c["a"], c["b"], c["kind"], c["given"], c["family"], c["strict"]) for c in items], own):
                    keep.append(i)
                    c = items[k]
                    out.append(c | {"shown": _SPACE.sub(" ", c["shown"]), "canonical": canonical(c["kind"], c["shown"])})
            part = batch.select(["src_table", "rec_id", "field"]).take(pa.array(keep, pa.int32()))
            cols = [pa.array([c[name] for c in out], kind) for name, kind in (("start_pos", pa.int32()), ("end_pos", pa.int32()), ("kind", pa.string()), ("shown", pa.string()), ("canonical", pa.string()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, "start_pos", "end_pos", "pii_type", "shown", "canonical"])

    item = "struct<a: int, b: int, kind: string, given: string, family: string, strict: boolean, start_pos: int, end_pos: int, shown: string>"
    keys = "src_table string, rec_id bigint, field string"
    rows = fields.mapInArrow(search, f"{keys}, items array<{item}>, words array<string>")
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    known = lexicon.of_rows(rows.select("row", "words"))
    return rows.join(known, "row", "left").select("src_table", "rec_id", "field", "items", "lexicon").mapInArrow(decide, f"{keys}, {_FOUND}")


_SPACE, _MAILTO, _AT, _DOT = regex.compile(r"\s+"), regex.compile(r"^mailto:\s*"), regex.compile(r"\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+|\s*@\s*"), regex.compile(r"\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+")
_MARKS, _COMMA = regex.compile(r"[^\p{L}\p{N}+]"), regex.compile(r"([^,]+), (.+)")


def canonical(kind: str, text: str) -> str:
    """One form for the ways in which an entity is written."""
    t = _SPACE.sub(" ", text).strip().casefold()
    if kind == "EMAIL":
        return _DOT.sub(".", _AT.sub("@", _MAILTO.sub("", t)))
    if kind in ("PHONE", "ID_NUMBER"):
        return _MARKS.sub("", t)
    if kind == "NAME":
        m = _COMMA.fullmatch(t)
        return f"{m[2]} {m[1]}" if m else t
    return t


# Consonants and vowels of invented words, by script, and endings of family names that tell a gender or an origin.
SYLLABLES = {
    "Latin": ("bdfghklmnprstvwz", "aeiou"), "Cyrillic": ("бвгдзклмнпрстфхц", "аеиоу"), "Greek": ("βγδζθκλμνπρστφχψ", "αειου"), "Armenian": ("բգդզթկլմնպրստխհվ", "աեիոէ"), "Hebrew": ("בגדזחטכלמנספקרשת", "אהוי"),
    "Arabic": ("بتجحدرزسشعفقكلمن", "اوي"), "Devanagari": ("कगचजटडतदनपबमयरलस", "ािीुे"), "Thai": ("กขคงจชดตทนบปมรลส", "ะาิีุ"), "Hangul": ("가나다라마바사아자차카타파하고노", "기니디리미"), "Hiragana": ("かきさしたちなにはまやらわみとの", "あいうえお"),
    "Katakana": ("カキサシタチナニハマヤラワミトノ", "アイウエオ"), "Han": ("安白陈丁方高何江林马平秦沈田王周", "文明华英子"),
}
FAMILY_ENDINGS = ("овский", "овская", "ский", "ская", "ова", "ева", "ина", "ов", "ев", "ин", "owska", "owski", "ska", "ski", "ova", "eva", "ov", "ev", "dóttir", "sson", "sen")
_SCRIPTS = [(name, regex.compile(rf"\p{{{name}}}")) for name in SYLLABLES]
# Words of addresses, emails and names that stay, country codes of two digits, and letters of Spanish numbers.
KEPT = frozenset("lane st road rd avenue ave street drive close way boulevard blvd court terrace crescent gardens grove mews parkway flat house apt unit rue des de du la le del calle plaza avda avenida ul al ул улица пр проспект пер наб д via viale piazza corso place bis ter at dot mailto x ext dl qq van von der den di da".split())
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def _stream(key: bytes, *parts: object) -> Iterator[int]:
    k = 0
    while True:
        yield from hmac.new(key, "\x1f".join(map(str, (*parts, k))).encode(), hashlib.sha256).digest()
        k += 1


def _script(word: str) -> str:
    return next((name for name, form in _SCRIPTS if form.search(word)), "Latin")


def _cased(new: str, like: str) -> str:
    return new.upper() if like.isupper() and len(like) > 1 else new.capitalize() if like[:1].isupper() else new


def _initial(key: bytes, letter: str) -> str:
    """The first letter of the replacements of all given names with a first letter: a keyed permutation of the script's consonants as far as they go."""
    letters = SYLLABLES[_script(letter)][0]
    order = sorted(letters, key=lambda c: hmac.new(key, f"initial|{c}".encode(), hashlib.sha256).digest())
    plain = sorted(set(letters))
    return order[plain.index(letter) if letter in plain else ord(letter) % len(order)]


def word_surrogate(key: bytes, role: str, word: str, attempt: int) -> str:
    """A replacement of one word of a name ('given' or 'family', in lower case), in its script.

    A given name begins as all with its first letter do, so that initials agree,
    and ends in a vowel or a consonant as it did; a family name keeps an ending
    that tells a gender. Every four attempts make it a syllable longer, so there
    is always another.
    """
    draw = _stream(key, role, word, attempt)
    consonants, vowels = SYLLABLES[_script(word)]
    tail = next((e for e in FAMILY_ENDINGS if role == "family" and word.endswith(e) and len(word) > len(e) + 1), "")
    size = max(2, (len(word) - len(tail) + 1) // 2) + attempt // 4
    out = "".join(consonants[next(draw) % len(consonants)] + vowels[next(draw) % len(vowels)] for _ in range(size))
    if role == "given":
        out = _initial(key, word[0]) + out[1:]
    if not tail and word[-1] not in vowels and word[-1].casefold() not in "aeiouyáéíóúëяаеиоуыэю":
        out += consonants[next(draw) % len(consonants)]
    return out + tail


_WORDS_OF = regex.compile(r"[\p{L}\p{M}" + LOST + r"]+")


def name_parts(shown: str) -> list[tuple[int, int, str, str]]:
    """(start, end, role, word) of the words of a name: 'given', 'family' or 'initial'; particles stay."""
    comma = shown.find(",")
    found = [m for m in _WORDS_OF.finditer(shown) if m[0].casefold() not in KEPT]
    # hyphens join the words of one family name
    last = next((i for i in range(len(found) - 1, -1, -1) if len(found[i][0]) > 1), -1)
    first = last
    while first > 0 and shown[found[first].start() - 1] == "-" and found[first - 1].end() == found[first].start() - 1:
        first -= 1
    out = []
    for i, m in enumerate(found):
        role = "initial" if len(m[0]) == 1 else "family" if (m.start() < comma if comma >= 0 else first <= i <= last) else "given"
        out.append((m.start(), m.end(), role, m[0].casefold()))
    return out


def surrogate(key: bytes, kind: str, shown: str, canon: str, attempt: int) -> str:
    """A replacement in the form of `shown` for what is no name, from the keyed hash of `canon`.

    Digits become digits and words invented words of the same script, case and
    length class; country codes, marks, kinds of streets and separators stay, and
    the letter of a Spanish identity number fits its digits. Every four attempts
    make words a syllable longer.
    """
    draw = _stream(key, kind, canon, attempt)
    code = regex.match(r"(?:\+|00)(\d{1,3})", shown) if kind == "PHONE" else None
    keep = 0
    if code:
        keep = code.start(1) + (1 if code[1][0] in "17" else 2 if code[1][:2] in TWO_DIGITS else 3)

    def piece(m) -> str:
        w = m[0]
        if w[0].isdigit():
            stay = max(0, min(len(w), keep - m.start()))
            return w[:stay] + "".join(str(next(draw) % 10) for _ in w[stay:])
        if w.casefold() in KEPT:
            return w
        if len(w) == 1:
            return chr(65 + next(draw) % 26) if w.isascii() and w.isupper() else w
        tail = next((w[-len(e) :] for e in ("straße", "strasse") if w.casefold().endswith(e) and len(w) > len(e)), "")
        consonants, vowels = SYLLABLES[_script(w)]
        new = "".join(consonants[next(draw) % len(consonants)] + vowels[next(draw) % len(vowels)] for _ in range(max(2, (len(w) - len(tail) + 1) // 2) + attempt // 4))
        return _cased(new, w) + tail

    out = regex.sub(r"\d+|[\p{L}\p{M}" + LOST + r"]+", piece, shown)
    dni = regex.fullmatch(r"(\d{8})(-?)[A-Z]", out) if kind == "ID_NUMBER" else None
    return f"{dni[1]}{dni[2]}{DNI[int(dni[1]) % 23]}" if dni else out


def _tag(key: bytes, kind: str, canon: str) -> str:
    return hmac.new(key, f"{kind}|{canon}".encode(), hashlib.sha256).hexdigest()[:12]


def _drawn(key: bytes, attempt: int, names: bool):
    """(kind, canonical, new) of (kind, canonical, shown): words of names by their role, else the first form of an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, canon, shown = (batch.column(c).to_pylist() for c in ("kind", "canonical", "shown"))
            new = [word_surrogate(key, k, c, attempt) if names else canonical(k, surrogate(key, k, s, c, attempt)) for k, c, s in zip(kinds, canon, shown)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("canonical"), batch.column("shown"), pa.array(new, pa.string())], ["kind", "canonical", "shown", "new"])

    return run


#: Rounds after which a form without a free replacement is an error; no known form comes near.
MOST_ROUNDS = 64


def _distinct(entities: DataFrame, key: bytes, names: bool) -> DataFrame:
    """(kind, canonical, attempt): the first attempt of each whose replacement no other has, and that is nothing real.

    entities: kind, canonical (a row each), shown. Of those that draw one
    replacement in the same round the smallest keeps it. What is taken stays
    taken in all later rounds.
    """
    scope = F.lit("") if names else F.col("kind")
    taken = entities.select(scope.alias("scope"), F.col("canonical").alias("new")).distinct()
    todo, done = entities, None
    for attempt in range(MOST_ROUNDS):
        drawn = checkpoint(todo.mapInArrow(_drawn(key, attempt, names), "kind string, canonical string, shown string, new string").withColumn("scope", scope))
        free = drawn.groupBy("scope", "new").agg(F.min(F.struct("kind", "canonical")).alias("first")).join(taken, ["scope", "new"], "left_anti")
        good = checkpoint(free.select(F.col("first.kind").alias("kind"), F.col("first.canonical").alias("canonical"), "scope", "new"))
        own = good.select("kind", "canonical", F.lit(attempt).alias("attempt"))
        done = own if done is None else done.unionByName(own)
        taken = taken.unionByName(good.select("scope", "new"))
        todo = drawn.join(good, ["kind", "canonical"], "left_anti").select("kind", "canonical", "shown")
        if todo.isEmpty():
            return done
    raise ValueError(f"no free replacement after {MOST_ROUNDS} rounds")


def _rebuilt(text: Column, parts: str, name: str) -> Column:
    """A text with its parts (sorted structs with start_pos, end_pos and the new text) replaced."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, p: F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, p["start_pos"] - acc["at"]), p[name]).alias("out"), p["end_pos"].alias("at"))
    return F.aggregate(parts, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))


_PARTS = "canonical string, shown string, start_pos int, end_pos int, kind string, word string, form string"


def _split_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(c, s, a, b, role, word, s[a:b]) for c, s in zip(batch.column("canonical").to_pylist(), batch.column("shown").to_pylist()) for a, b, role, word in name_parts(s)]
        cols = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if i in (2, 3) else pa.string()) for i, c in enumerate(cols)], ["canonical", "shown", "start_pos", "end_pos", "kind", "word", "form"])


def _filled(key: bytes, names: bool):
    """The replacement in the case and form of each way of writing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, canon, shown, attempts = (batch.column(c).to_pylist() for c in ("kind", "canonical", "shown", "attempt"))
            if names:
                new = [_initial(key, c).upper() if k == "initial" else _cased(word_surrogate(key, k, c, n), s) for k, c, s, n in zip(kinds, canon, shown, attempts)]
            else:
                new = [surrogate(key, k, s, c, n) for k, c, s, n in zip(kinds, canon, shown, attempts)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("canonical"), batch.column("shown"), pa.array(new, pa.string())], ["kind", "canonical", "shown", "surrogate"])

    return run


_FILLED = "kind string, canonical string, shown string, surrogate string"


def replacements(found: DataFrame, key: bytes) -> DataFrame:
    """(pii_type, canonical, shown, surrogate, tag) of all entities of a corpus.

    Names are replaced word by word: a given or family name has one replacement
    in the whole corpus, two never the same, and none that is a name itself, so
    persons stay distinct and 'J. Smith', 'Smith, John' and 'John Smith' still
    agree. Other entities are replaced as wholes, in all their ways of writing.
    """
    forms = checkpoint(found.select("pii_type", "canonical", "shown").distinct())

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = [_tag(key, k, c) for k, c in zip(batch.column("pii_type").to_pylist(), batch.column("canonical").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags, pa.string())], [*batch.schema.names, "tag"])

    other = forms.filter("pii_type <> 'NAME'").withColumnRenamed("pii_type", "kind")
    attempts = _distinct(other.groupBy("kind", "canonical").agg(F.min("shown").alias("shown")), key, False)
    plain = other.join(attempts, ["kind", "canonical"]).select("kind", "canonical", "shown", "attempt").mapInArrow(_filled(key, False), _FILLED)
    parts = checkpoint(forms.filter("pii_type = 'NAME'").select("canonical", "shown").mapInArrow(_split_names, _PARTS))
    words = parts.filter("kind <> 'initial'").groupBy("kind", F.col("word").alias("canonical")).agg(F.min("form").alias("shown"))
    attempts = _distinct(words, key, True)
    written = parts.select("kind", F.col("word").alias("canonical"), F.col("form").alias("shown")).distinct().join(attempts, ["kind", "canonical"], "left").select("kind", "canonical", "shown", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    written = written.mapInArrow(_filled(key, True), _FILLED).select("kind", F.col("canonical").alias("word"), F.col("shown").alias("form"), "surrogate")
    each = parts.join(written, ["kind", "word", "form"]).groupBy("canonical", "shown").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "surrogate"))).alias("parts"))
    names = each.select(F.lit("NAME").alias("kind"), "canonical", "shown", _rebuilt(F.col("shown"), "parts", "surrogate").alias("surrogate"))
    return plain.unionByName(names).select(F.col("kind").alias("pii_type"), "canonical", "shown", "surrogate").mapInArrow(tagged, "pii_type string, canonical string, shown string, surrogate string, tag string")


def redact(fields: DataFrame, found: DataFrame, key: bytes) -> DataFrame:
    """(src_table, rec_id, field, placeholders, surrogates) of every field that holds an entity.

    `found` is the checkpointed result of `entities`. Placeholders look like
    [NAME_0123456789ab]; text around the entities stays as stored.
    """
    ids = ["src_table", "rec_id", "field"]
    map_ = replacements(found, key)
    parts = (
        found.join(map_, ["pii_type", "canonical", "shown"])
        .withColumn("placeholder", F.concat(F.lit("["), "pii_type", F.lit("_"), "tag", F.lit("]")))
        .groupBy(*ids)
        .agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "placeholder", "surrogate"))).alias("parts"))
    )
    text = F.col("text")
    return fields.join(parts, ids).select(*ids, _rebuilt(text, "parts", "placeholder").alias("placeholders"), _rebuilt(text, "parts", "surrogate").alias("surrogates"))
