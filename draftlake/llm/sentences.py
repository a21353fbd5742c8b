"""Sentences of texts in many languages and scripts.

Each line is taken for itself. Its gaps, the places behind a mark that may end
a sentence, form a lattice whose paths are the ways of cutting it; the cheapest
path wins. In spaced scripts the terminator and its neighbours price a gap:
abbreviations, initials, ordinals and numbers before it, the opening word
behind it. In spaceless scripts a dictionary word lattice segments the text on
both sides of a gap, and the final particle before and the opening word behind
price it. Its dictionary is the closed classes below and what the corpus itself
yields: pieces of up to four characters, how often they stand anywhere, at a
sure beginning and at a sure end, in tables of a fixed size. A cut inside a
quotation is dear where the sentence goes on behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.runtime import checkpoint

#: Characters of a worker's memo of lines (a full one starts anew), and of the longest line in it.
LINES, LONG_LINE = 24_000_000, 4_000

# What a line without sentences begins with.
NO_SENTENCE = frozenset("={|}!*#:;<_-")

# Abbreviations that are followed by what they belong to.
BOUND = frozenset(
    # titles
    "mr mrs ms mx messrs mlles mmes sres dr prof ph.d adm attn lic cmdr maj brig supt pres sir mt ft st sta sto hr fr frau mme mlle mgr sr sra srta dña ing rev gen col capt lt sgt hon gov sen rep dipl dres "
    "проф д-р гр г-н г-жа акад им ул пл св пос дер с ст обл р-н о оз "
    "डॉ श्री श्रीमती प्रो पं "
    # references and measures
    "vol vols no nos nr nrn p pp pg pág págs bd bde s ss t tt ch chap cap fig figs eq sec sect art ed eds hg hrsg vgl cf cp siehe ebd anm aufl abb tab kap zit "
    "см ср т тт с стр гл рис табл изд № вып кн ч "
    # approximations, dates, relations
    "ca circa c approx aprox env b d r fl geb gest vs bzw resp sog inkl exkl bspw z u i e g d.h z.b u.a v q ok около прибл ок род ум "
    "jan feb mar apr jun jul aug sept sep oct nov dec jän okt dez janv févr avr juil ene abr ago dic "
    "n n.º nº núm no.º suiv av apr "
    "lt hab inh einw".split()
)
# Abbreviations that may end a sentence.
FREE = frozenset("etc usw ff f al p.m a.m pm am co inc ltd corp jr snr bros dept u.s u.k u.s.a e.v gmbh ca.d д др пр г гг в вв руб тыс млн км м кв н.э с.ш в.д s.a s.l c.v suiv sgg ecc m km ha kg a.d b.c av.j.-c j.-c म".split())
#: Of these, those that need more than a capital behind them: an opening word.
NAMED = frozenset("co inc ltd corp jr snr bros dept u.s u.k u.s.a gmbh e.v s.a г в".split())

# Words that open sentences.
OPENERS = frozenset(
    "the a an it he she they we i in on at of this that these those there here was were is are did does do what when where who why how several some many most no nobody none see according "
    "after before during while although however but and or for from with by under its his her their one two three once since until today later both each every all as if so then thus yet only even "
    "der die das ein eine es er sie wir ich im in am an auf bei mit nach vor seit von zu zur zum ist war wird was wer wie wo warum wann niemand vgl siehe hr frau dort dann als wenn aber und oder auch nur den dem des einige viele man "
    "le la les l un une il elle ils elles on en au aux du de des dans sur par pour avec personne qui que quoi quel quelle quels quelles voir est était mme m ce cette ces son sa ses après avant depuis mais et ou où "
    "el los las una uno unos él ella ellos en al del de por para con nadie quién qué cuándo dónde véase mide tenía hay fue era su sus este esta estos tras desde pero y o según "
    "в на с со к о об от до по из за при для у и а но или он она оно они мы я это этот эта там тут здесь кто что какой какая какое как где когда почему никто см площадь после до перед его её их".split()
)
# Opening words of Arabic, and reporting verbs of languages without capitals.
AR_OPENERS = frozenset("هل لا لم لن يا قال قالت كتب كتبت سأل سألت زار زارت تبلغ يبلغ كان كانت تقع يقع في من إلى على بني بنيت بيع بيعت هجر هُجرت هجرت شيد شيدت وقد كما بعد قبل انظر راجع أعيد وسع وسعت ما متى أين كيف هدمت هدم رمم رممت".split())
HI_REPORT = ("लिखा", "पूछा", "कहा", "बताया", "बोला", "बोली", "चिल्लाया")
AR_REPORT = ("كتب", "كتبت", "قال", "قالت", "سأل", "سألت", "تساءل", "تساءلت", "أضاف", "صرخ", "هتف", "يقول", "تقول")
ZH_REPORT = ("写道", "说道", "问道", "答道", "喊道", "说", "问", "道", "答", "写", "表示", "回答", "喊", "认为", "指出", "感叹")
ZH_OPENERS = ("位于", "该", "这", "那", "在", "从", "于", "他", "她", "它", "我", "没有", "谁", "为什么", "何时", "如今", "后来", "此后", "其", "据", "参见", "多么")
#: Particles by which a Japanese sentence goes on behind a quotation.
JA_LINKS = ("という", "といった", "として", "とは", "とも", "との", "って", "と", "は", "が", "を", "に", "の", "で", "も", "へ", "や", "など", "から", "より", "まで", "だ", "である", "です", "、")
JA_FINAL = ("である", "であった", "でした", "ました", "ません", "だろう", "です", "ます", "だった", "された", "れた", "した", "った", "いた", "いる", "ない", "だ", "た", "る", "か", "ね", "よ", "な", "ぞ", "さ", "の")
JA_OPENERS = ("なんと", "この", "その", "あの", "ここ", "そこ", "彼", "また", "しかし", "ただし", "なお", "さらに", "そして", "現在", "誰", "いつ", "なぜ")

_CLOSERS = "\"'”’»›」』）)］]｝}〉》】“‘"
_OPENING = "\"'“‘„‚«‹「『（([¿¡《〈【'*—–-"
_REF = r"<ref(?:\s[^<>]*)?/>|<ref(?:\s[^<>]*)?>.*?</ref>"
_TEMPLATE = r"\{\{(?:[^{}]|\{[^{]|\}[^}]|\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\})*\}\}"
_PROTECTED = regex.compile(rf"{_REF}|{_TEMPLATE}|(?:https?://|www\.)[^\s<>\"]*[\p{{L}}\p{{N}}/]|[\w.+-]+@[\w-]+\.[\w.]*\w|<[^<>]*>|\[\[[^\[\]]*\]\]|\[(?:https?:)?//[^\]]*\]")
_TRAIL = regex.compile(rf"(?:{_REF}|{_TEMPLATE})")
_MARK = regex.compile(r"[.!?…]+|[。！？．｡؟।॥]+(?:[.!?…。！？]*)|[։។៕။]+")
_CLOSE = regex.compile(rf"(?:''+|[{regex.escape(_CLOSERS)}]|[\s  ](?=[»›]))+")
_THAI = regex.compile(r"(?<=[\p{Thai}--[\p{N}ฯๆ฿]])[ \t  ]+(?=[\p{Thai}--[\p{N}ฯๆ฿]])", flags=regex.V1)
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_NEXT = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[.'’-][\p{L}\p{M}\p{N}]+)*")
_LAST = regex.compile(r"(?r)(?:[\p{L}\p{M}\p{N}º№]+(?:[.\-'’][\p{L}\p{M}\p{N}º]+)*)$")

_DEVANAGARI = regex.compile(r"\p{Devanagari}")
_ARABIC = regex.compile(r"\p{Arabic}")
_THAI_CHAR = regex.compile(r"\p{Thai}")
_CAMEL = regex.compile(r"\p{Ll}{1,2}\p{Lu}")
_BRACKETS = regex.compile(r"[)\]]+")
_INITIAL = regex.compile(r"\p{Lu}")
_LETTERS = regex.compile(r"(?:\p{Lu}\.)+\p{Lu}")
_YEAR = regex.compile(r"(?r)\d\s*$")
_SPACED = regex.compile(r"(?r)(\p{L}+\.)\s(\p{L}{1,2})$")
_QUOTED = regex.compile(r"[」』”’\"»]")
_CLAUSE = regex.compile(r"[，。！？,!?：:“]")
_INTRODUCED = regex.compile(r"[：:][“「『\"][^“「『]*$")
_SURE = "。！？｡"
_RUN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]+")
_MARKS_OF_PAIRS = regex.compile(r"[„“”«»‹›「」『』（）()《》\"]")
_APOSTROPHE = regex.compile(r"['’]")

TAKE, NEVER = 0.0, 9.0


#: Longest piece that is counted, and the size of a table of counts, as a power of two.
PIECE, TABLE_BITS = 4, 18
#: A piece that goes on with the same character in more than this part of its places is no word there.
BOUND_TO = 0.9
#: The least cohesion of a word: how much more often its parts meet than by chance.
COHESION = 30.0
_FACTOR, _MIX = 0x01000193, 0x9E3779B1


def _slot(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * _FACTOR + ord(c)) & 0xFFFFFFFF
    return (h * _MIX & 0xFFFFFFFF) >> (32 - TABLE_BITS)


class Dictionary:
    """Counts of pieces (anywhere, at a sure beginning, at a sure end) in hashed tables of a fixed size, and the lattice over them."""

    def __init__(self, anywhere: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        self.anywhere, self.begins, self.ends = anywhere, begins, ends
        self.total, self.n_begins, self.n_ends = (max(1.0, float(t.sum()) / PIECE) for t in (anywhere, begins, ends))

    @classmethod
    def empty(cls) -> Dictionary:
        return cls(*(np.zeros(1 << TABLE_BITS, np.float32) for _ in range(3)))

    def count(self, piece: str) -> float:
        return float(self.anywhere[_slot(piece)])

    def _is_word(self, line: str, i: int, j: int) -> bool:
        """Whether the piece at i to j is a word there: its parts belong together, and neither side is bound to the character beyond."""
        piece = line[i:j]
        n = self.count(piece)
        if n < 2 or any(n * self.total < COHESION * self.count(piece[:k]) * self.count(piece[k:]) for k in range(1, j - i)):
            return False
        tail, head = piece[1 - PIECE :], piece[: PIECE - 1]
        return not (_RUN.match(line, j) and self.count(tail + line[j]) > BOUND_TO * self.count(tail) or i and _RUN.match(line, i - 1) and self.count(line[i - 1] + head) > BOUND_TO * self.count(head))

    def cut(self, line: str, start: int, stop: int, closed: frozenset[str]) -> list[str]:
        """The cheapest segmentation of a stretch of a line: words of closed classes cost the less the longer, learned words more, other characters most."""
        n = stop - start
        cost, back = [0.0] + [1e9] * n, [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - PIECE), i):
                w = line[start + j : start + i]
                price = 1.0 / len(w) if w in closed else 1.5 if i - j == 1 else 1.2 if self._is_word(line, start + j, start + i) else None
                if price is not None and cost[j] + price < cost[i]:
                    cost[i], back[i] = cost[j] + price, j
        out, i = [], n
        while i:
            out.append(line[start + back[i] : start + i])
            i = back[i]
        return out[::-1]

    def _odds(self, word: str, table: np.ndarray, total: float) -> float:
        """Logarithm of how much more often a word stands at a place than by chance, 0 for what was never seen."""
        at = _slot(word[:PIECE] if table is self.begins else word[-PIECE:])
        return max(-4.0, min(4.0, float(np.log((table[at] + 1) / (self.anywhere[at] * total / self.total + 1)))))

    def opens(self, word: str) -> float:
        return self._odds(word, self.begins, self.n_begins)

    def closes(self, word: str) -> float:
        return self._odds(word, self.ends, self.n_ends)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [np.zeros(1 << TABLE_BITS) for _ in range(3)]
    for batch in batches:
        texts = [t for t in batch.column("text").to_pylist() if t and _CJK.search(t)]
        if not texts:
            continue
        chars = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        own = ((chars >= 0x3041) & (chars <= 0x30FF) | (chars >= 0x3400) & (chars <= 0x9FFF) | (chars == 0x3005) | (chars >= 0x20000) & (chars <= 0x323AF)).astype(bool)
        stop = np.isin(chars, [ord(c) for c in _SURE])
        line = chars == 10
        # marks of any kind that end their line are a sure end
        dots, final = np.isin(chars, [ord("…"), ord(".")]), stop | line
        for _ in range(6):
            final = final | dots & np.append(final[1:], False)
        h = np.zeros(len(chars), np.uint32)
        good = np.ones(len(chars), bool)
        for n in range(1, PIECE + 1):
            size = len(chars) - n + 1
            h = h[:size] * np.uint32(_FACTOR) + chars[n - 1 :]
            good = good[:size] & own[n - 1 :]
            at = np.flatnonzero(good)
            slots = (h[at] * np.uint32(_MIX)) >> np.uint32(32 - TABLE_BITS)
            tables[0] += np.bincount(slots, minlength=1 << TABLE_BITS)
            tables[1] += np.bincount(slots[(stop | line)[at - 1]], minlength=1 << TABLE_BITS)
            tables[2] += np.bincount(slots[final[at + n]], minlength=1 << TABLE_BITS)
    key = np.concatenate([(k << TABLE_BITS) + np.flatnonzero(t) for k, t in enumerate(tables)])
    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.concatenate([t[t > 0] for t in tables]), pa.float64())], ["key", "n"])


def learn(documents: DataFrame) -> Dictionary:
    """The dictionary of all documents. What reaches the driver are the sums of three tables of 2**TABLE_BITS counts."""
    rows = documents.select("text").mapInArrow(_counted, "key bigint, n double").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(3 << TABLE_BITS, np.float32)
    counts[np.asarray(rows.column("key"), np.int64)] = np.asarray(rows.column("n"))
    return Dictionary(*counts.reshape(3, -1))


JA_CLOSED = frozenset(w for w in JA_LINKS + JA_FINAL + JA_OPENERS)
ZH_CLOSED = frozenset(w for w in ZH_REPORT + ZH_OPENERS)


_CLOSE_OF = {"„": "“”", "“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "»": "«"}


def _pairs(masked: str) -> list[tuple[int, int]]:
    """Matched quotations and brackets (open, close); marks without a partner are left out."""
    stack: list[tuple[str, int]] = []
    out = []
    for mark in _MARKS_OF_PAIRS.finditer(masked):
        i, c = mark.start(), mark[0]
        if c == '"':
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if at is None:
                stack.append((c, i))
            else:
                out.append((stack[at][1], i))
                del stack[at:]
            continue
        hit = next((k for k in range(len(stack) - 1, -1, -1) if c in _CLOSE_OF.get(stack[k][0], "")), None)
        if hit is not None:
            out.append((stack[hit][1], i))
            del stack[hit:]
        elif c in _CLOSE_OF and c != "»":
            stack.append((c, i))
    return out


def _mask(line: str) -> str:
    """The line with protected pieces blanked by a letter-like filler of equal length."""
    return _PROTECTED.sub(lambda m: "\x00" * len(m[0]), line)


def _price(line: str, masked: str, m, end: int, after: int, words: Dictionary) -> float:
    """Cost of a cut at `end` behind the mark m; `after` is where the next sentence would begin. Below 1 it is taken."""
    mark, nxt = m[0], line[after:]
    if not nxt:
        return TAKE
    quoted = end > m.end() and any(c in _CLOSERS for c in line[m.end() : end])
    head = nxt.lstrip(_OPENING + "'")
    word = _NEXT.match(head)
    first = word[0] if word else ""
    before = line[max(0, m.start() - 80) : m.start()]  # abbreviations, numbers and initials are shorter; nothing else before a mark is asked for
    prev = before[-1:] if before else ""
    if mark[0] in "։។៕။":
        return TAKE
    if mark[0] in "。！？．｡":
        return _spaceless(line, m, end, after, quoted, words)
    if _CJK.match(prev) or _CJK.match(head[:1]) and quoted and _CJK.search(line[max(0, m.start() - 4) : m.start()]):
        if mark[0] in "!?…":
            return _spaceless(line, m, end, after, quoted, words)
        return TAKE if end < after and not _CJK.match(head[:1]) else NEVER
    if end == after:  # spaced scripts put a space behind a sentence
        return NEVER
    if mark[0] == "." and _THAI_CHAR.match(prev):
        return NEVER
    if nxt[0] in ",;:،؛)”»" or nxt[:1] in "—–" and (quoted or not first[:1].isupper()):
        return NEVER
    if _DEVANAGARI.match(head) or _DEVANAGARI.match(prev):
        if mark[0] in "।॥?!":
            return NEVER if quoted and _reports(nxt, HI_REPORT, "।?!") else TAKE
        return (NEVER if _DEVANAGARI.match(prev) else TAKE) if mark[0] in "." else 2.0
    if _ARABIC.match(head):
        if quoted and mark[0] in "؟?!." and (_NEXT.match(head) or [""])[0] in AR_REPORT:
            return NEVER
        if mark == ".":
            last = _LAST.search(before)
            if last and len(last[0]) == 1 and _ARABIC.match(last[0]) and not quoted:
                return TAKE if first in AR_OPENERS else NEVER
        return 2.0 if mark[0] == "…" and first not in AR_OPENERS else TAKE
    if _THAI_CHAR.match(head):
        return TAKE
    last = _LAST.search(before)
    token = last[0] if last else ""
    key = token.lower()
    opener = _APOSTROPHE.split(first)[0].lower() in OPENERS
    if nxt[0] in "¿¡" and key not in BOUND:
        return TAKE
    lower = first[:1].islower()
    if lower and not _CAMEL.match(first):
        # in a text without capitals an opening word behind a whole word begins a sentence
        whole = len(token) > 3 and key not in BOUND and key not in FREE and "." not in key
        return TAKE if opener and whole and not quoted and mark in (".", "?", "!") else NEVER
    if not first:
        return TAKE if mark[0] in "!?" else 0.5
    if mark[0] in "!?" or quoted and not _BRACKETS.fullmatch(line, m.end(), end):
        return TAKE
    if mark[0] == "…" or mark.startswith("..."):
        return NEVER if lower else TAKE
    if token.isdigit():
        words = _NEXT.findall(before[: -len(token)])
        lead = words[-1].lower() if words else ""
        if len(token) <= 2 and first[:1].isupper() and lead in ("im", "am", "der", "die", "das", "dem", "den", "des", "zur", "zum", "vom", "beim", "ins", "seit", "ab", "bis", "ihr", "ihre", "ihrer", "sein", "seine"):
            return NEVER
        return TAKE
    if first[:1].isdigit() and key in BOUND:
        return NEVER
    if _INITIAL.fullmatch(token):  # an initial
        return NEVER
    if key in NAMED:
        if key in ("г", "в") and _YEAR.search(before[: -len(token)]):
            return TAKE
        return TAKE if opener else NEVER
    if key in FREE:
        return TAKE
    if _LETTERS.fullmatch(token):
        return TAKE if opener else NEVER
    spaced = _SPACED.search(before)  # "и т. д", "z. B", "u. a", "i. e"
    if spaced:
        both = f"{spaced[1]} {spaced[2]}".lower()
        if both in ("т. д", "т. п", "н. э", "p. m", "a. m", "u. ä", "o. ä"):
            return TAKE
        if both in ("т. е", "u. a", "z. b", "d. h", "i. e", "e. g", "a. d", "s. o", "v. a", "i. d", "p. ej", "c. à"):
            return NEVER
        if key in BOUND:
            return NEVER
    if key in BOUND:
        return NEVER
    return TAKE


def _reports(nxt: str, verbs: tuple[str, ...], stops: str) -> bool:
    """Whether the clause behind a quotation tells who said it: a doer and the verb, without a comma."""
    clause = regex.split(f"[{regex.escape(stops)}]", nxt, maxsplit=1)[0].strip()
    return "," not in clause and clause.endswith(verbs) and (" ने " in clause or len(clause.split()) <= 3)


def _japanese(line: str) -> bool:
    """Whether the spaceless text of a line is Japanese: one in ten of its characters is kana."""
    kana = len(_KANA.findall(line))
    return kana > 0 and 10 * kana >= len(_CJK.findall(line))


def _first(line: str, at: int, closed: frozenset[str], words: Dictionary) -> str:
    """The first word behind a gap."""
    m = _RUN.match(line, at)
    got = words.cut(line, at, m.end(), closed) if m else []
    return got[0] if got else ""


def _final(line: str, at: int, closed: frozenset[str], words: Dictionary) -> str:
    """The last word before a gap."""
    start = at
    while start and _RUN.match(line, start - 1):
        start -= 1
    got = words.cut(line, start, at, closed) if start < at else []
    return got[-1] if got else ""


def _spaceless(line: str, m, end: int, after: int, quoted: bool, words: Dictionary) -> float:
    """Price of a gap in Chinese or Japanese, by the words of the lattice on both sides."""
    head = line[after:]
    if head[:1] and head[0] in "，、,；;：:）)】":
        return NEVER
    inner = quoted and _QUOTED.search(line, m.end(), end)
    dots = m[0][0] in "…" or m[0].startswith("...")
    if not inner and not dots:
        return TAKE
    if _japanese(line):
        first = _first(line, after, JA_CLOSED, words)
        if first in JA_LINKS or first not in JA_OPENERS and first[:1] in ("と", "、") and words.opens(first) <= 0:
            return NEVER
        if inner:
            return TAKE
        last = _final(line, m.start(), JA_CLOSED, words)
        return TAKE if last in JA_FINAL or words.closes(last) + words.opens(first) > 0 else NEVER
    if inner:
        clause = _CLAUSE.split(head, maxsplit=1)[0]
        # who said it stands before the quotation, or before the next one
        if head[len(clause) :][:1] in ("：", ":") or _INTRODUCED.search(line[: m.start()]):
            return TAKE
        got = words.cut(line, after, after + len(clause), ZH_CLOSED)
        return NEVER if got and got[-1] in ZH_REPORT and got[0] not in ZH_OPENERS else TAKE
    first, last = _first(line, after, ZH_CLOSED, words), _final(line, m.start(), ZH_CLOSED, words)
    if not first:  # a quotation, a number or another script opens
        return TAKE if words.closes(last) > 0 or head[:1] in _OPENING else 2.0
    return TAKE if first in ZH_OPENERS or words.opens(first) + words.closes(last) > 0 else 2.0


def _gaps(line: str, masked: str, words: Dictionary) -> list[tuple[int, int, float, int]]:
    """(end of the sentence before, start of the next, price, place of the mark) of every gap."""
    out = []
    n = len(line)
    for m in _MARK.finditer(masked):
        end = m.end()
        # a mark directly before a digit or letter without a space stays inside
        while True:
            c = _CLOSE.match(masked, end)
            if c and c.end() > end and not (c[0].strip() in ('"', "“", "‘", "'") and _opens(masked, end, c.end())):
                end = c.end()
                continue
            t = _TRAIL.match(line, end)
            if t:
                end = t.end()
                continue
            break
        after = end
        while after < n and line[after].isspace():
            after += 1
        out.append((end, after, _price(line, masked, m, end, after, words), m.start()))
    for t in _THAI.finditer(masked):
        out.append((t.start(), t.end(), TAKE, t.start()))
    return sorted(out)


def _opens(masked: str, start: int, end: int) -> bool:
    """Whether a quote that may open or close opens here: an even number stands before it."""
    q = masked[start:end].strip()
    if q == '"':
        return masked[:start].count('"') % 2 == 0
    if q == "“":
        return masked[:start].rfind("„") <= masked[:start].rfind("“")
    return False


def cut(line: str, words: Dictionary | None = None) -> list[tuple[int, int]]:
    """Sentences (start, end) of one line, without white space around them."""
    start, stop = 0, len(line)
    while start < stop and line[start].isspace():
        start += 1
    while stop > start and line[stop - 1].isspace():
        stop -= 1
    body = line[start:stop]
    if not body or body[0] in NO_SENTENCE or (body.startswith("[[") and body.endswith("]]")):
        return []
    masked = _mask(body)
    found = _gaps(body, masked, words or NOTHING_LEARNED)
    gaps = [g for g in found if g[1] < len(body) and g[0] > 0]
    if not gaps:
        return [(start, stop)]
    # nodes of the lattice: the start, the gaps, the end; price of an edge: that of the gap at its end, of the gaps it
    # leaves out, and of a quotation it cuts though the sentence goes on behind
    best, back = [0.0], [0]
    size = len(gaps)
    broken = [0.0] * size
    for o, c in _pairs(masked):
        if body[o] in "(（" or not any(p < 1 and at < c < e for e, _, p, at in found):
            broken = [x + NEVER * (o < g[0] <= c) for x, g in zip(broken, gaps)]
    for k in range(1, size + 2):
        price, choice = 1e18, 0
        skipped = 0.0
        for i in range(k - 1, -1, -1):
            at_end = gaps[k - 1][2] + broken[k - 1] if k <= size else 0.0
            v = best[i] + at_end + skipped
            if v < price:
                price, choice = v, i
            if i:
                # leaving out a gap costs what is missing to a sure refusal
                skipped += max(0.0, 1.0 - gaps[i - 1][2])
        best.append(price)
        back.append(choice)
    cuts, k = [], size + 1
    while k:
        k = back[k]
        if k:
            cuts.append(k - 1)
    out, at = [], 0
    for k in reversed(cuts):
        e, a = gaps[k][:2]
        if e > at:
            out.append((start + at, start + e))
            at = a
    if at < len(body):
        out.append((start + at, stop))
    return out


NOTHING_LEARNED = Dictionary.empty()


class Cutter:
    """`cut` by a dictionary, with the results of recent lines kept."""

    def __init__(self, words: Dictionary):
        self.words = words
        self.seen: dict[str, np.ndarray] = {}
        self.held = 0

    def __call__(self, line: str) -> np.ndarray:
        known = self.seen.get(line)
        if known is None:
            known = np.array(cut(line, self.words), np.int64).reshape(-1, 2)
            if len(line) <= LONG_LINE:
                self.held += len(line)
                if self.held > LINES:
                    self.seen.clear()
                    self.held = len(line)
                self.seen[line] = known
        return known


_CUTTER: list[Cutter] = []


def cutter_of_worker(words: Dictionary) -> Cutter:
    """The worker's cutter; a broadcast dictionary is one object in a worker, so its lines stay known from task to task."""
    if not _CUTTER or _CUTTER[0].words is not words:
        _CUTTER[:] = [Cutter(words)]
    return _CUTTER[0]


def spans(text: str, cutter: Cutter, found: list[np.ndarray], places: list[int]) -> None:
    """Add the sentences of each line that has any, by places in the line, and the line's place."""
    at = 0
    for line in text.split("\n"):
        if line:
            own = cutter(line)
            if len(own):
                found.append(own)
                places.append(at)
        at += len(line) + 1


def once(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with every id once, the largest text of a repeated one; null ids are left out.

    Repeats are looked for among the ids alone, so texts are moved only where
    there are repeats, and only theirs.
    """
    rows = documents.select("doc_id", "text").filter("doc_id is not null")
    repeated = checkpoint(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, "doc_id", "left_anti").unionByName(rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))


def sentences(documents: DataFrame, words: Dictionary | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence: 0-based code points, end exclusive.

    Null and empty texts, and null ids, give no rows; a doc_id counts once, with
    the largest of its texts. `words` is the dictionary of the corpus; without
    one it is learned from the documents first. Two passes, without a shuffle of
    the texts.
    """
    shared = documents.sparkSession.sparkContext.broadcast(words or learn(documents))  # three tables of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = cutter_of_worker(shared.value)
        for batch in batches:
            docs, lines, found, places = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if doc is None or not text:
                    continue
                before = len(found)
                spans(text, cutter, found, places)
                docs.append(doc)
                lines.append(len(found) - before)
            if found:
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                table = np.concatenate(found) + np.repeat(np.array(places, np.int64), sizes)[:, None]
                ids = np.repeat(np.repeat(np.array(docs, np.int64), lines), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(table[:, 0]), pa.array(table[:, 1])], ["doc_id", "start_pos", "end_pos"])

    return once(documents).mapInArrow(run, "doc_id bigint, start_pos bigint, end_pos bigint")
