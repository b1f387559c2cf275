"""Sentence boundaries across languages and scripts, by cascading segmentation rules.

Each text is cut in three steps:

1. blank lines cut it into blocks; inside a block a line that begins with a list marker
   (bullet, dash, bracketed number or letter) starts a list item, which is one sentence;
2. in the rest of a block every end mark (with the closing marks right after it) and, between
   two Thai characters, every space is a position to decide;
3. a position inside quotation marks or brackets that do not close right there is passed over;
   every other one is decided by the first rule of the cascade whose two regular expressions
   match the text before and after it. The cascade is a list of tables: numbers and addresses,
   then one table per language, then the defaults of each script. A table is tried only at the
   marks it is made for.

Texts are mixed and labels unreliable, so languages are told by the text's own evidence: by script,
and among those in Latin letters by the function words of the block. A table of abbreviations of
another language than the block's loses to a capital that follows. Rules look at the whole text:
what comes before is matched backwards from the mark, or as a whole from the start of the
sentence; no window is cut out. For speed the cascade is indexed by mark, last word and the kind
of the next character: rules that cannot match there are left out, the order of the rest stays.

Defined cases: null, empty and blank texts have no sentence; a text without any end mark is one
sentence per block; repeated documents repeat their rows.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import spread

_LINE = r"(?:\r\n|[\n\r\v\f\x85  ])"
#: A line break, then at least one line of white space only.
_BLANK = re.compile(rf"{_LINE}(?:[^\S\n\r\v\f\x85  ]*{_LINE})+")
_ITEM = re.compile(rf"(?:^|{_LINE})[^\S\n\r\v\f\x85  ]*(?P<item>(?:[•▪▫◦‣⁃●○■□◆▶►✓*·・]|[-–—](?=\s)|[(（](?:[0-9]{{1,3}}|[A-Za-z]|[ivxIVX]{{1,5}})[)）]|(?:[0-9]{{1,2}}|[a-z])\)(?=\s)))")
_CLOSE = "\"'”’»›）)」』\\]】》〉〕｣"
_MARKS = re.compile(rf"(?:\.{{2,}}|…+|[.!?]|[。！？｡．؟۔।॥‼⁇⁈⁉]|[;;])(?:[.!?…。！？｡؟।॥]|(?<=[.!?…])[​­]+(?=[.!?]))*(?:[   ]?[»›]|[{_CLOSE}“])*")
_THAI_SPACE = re.compile(r"(?<=[ก-ฮะ-ฺเ-๎])[​­]*(?P<gap>[ \t 　 -  ]+)(?=[​­]*[ก-ฮะ-ฺเ-๎])")

#: Marks that come in pairs; a straight quotation mark pairs with the next one.
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "〔": "〕", "｢": "｣", "‚": "‘"}
_BRACKETS = "([（【〔"
_PAIRED = re.compile("[\"“”„«»‹›()\\[\\]（）「」『』【】《》〈〉〔〕｢｣‚‘]")
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#[0-9]{1,6});")
_INVISIBLE = re.compile("[​­‌‍⁠﻿‎‏]")
#: What is skipped to see how the text goes on: invisible characters, symbols, markup-like tokens.
_NOISE = re.compile(r"(?:[​­‌‍⁠﻿‎‏️]|\p{So}|\p{Sk}|\p{Cn}|<\|[a-z_]+\|>|<[^<>\s]{1,20}>|&(?:[A-Za-z]{2,8}|#[0-9]{1,6});)(?:\s*(?:[​‍️]|\p{So}|\p{Sk}|<\|[a-z_]+\|>|&(?:[A-Za-z]{2,8}|#[0-9]{1,6});))*")

_L = r"(?<![\p{L}\p{M}\p{N}])"

# ---- Fixed values: abbreviations per language. "inner" ones are never the last word of a
# sentence; "outer" ones may be, and are taken so when a sentence can start after them.
INNER = {
    "en": "Mr Mrs Ms Messrs Dr Prof Rev Hon Gen Col Capt Lt St Mt Ft Fig Figs pp p Vol Ed ed vs v incl excl Approx approx cf viz e.g i.e al Sec Art Par Ch Dept Est Rs Ref c",
    "de": "Dr Prof Hr Fr Nr Abs Art Ziff Kap Bd Mio Mrd Tsd ca bzw vgl inkl exkl ggf evtl z u d o i s a sog einschl lt gem Str z.B d.h u.a i.d.R z.T",
    "fr": "M MM Mme Mlle Dr Pr p pp cf n ch chap Chap Chapitre env t vol éd",
    "es": "Sr Sra Sres Dr Dra D Dña arts Art n núm núms pág págs aprox Cap Cía EE ej vol p pp c",
    "el": "κ κκ κα π π.χ σελ εκατ δισ χιλ άρθ αρ αριθ Κεφ κεφ βλ δηλ παρ Δρ",
    "hi": "डॉ श्री रु लि प्रो नं सं पृ",
    "ar": "د أ م ص ج رقم",
}
OUTER = {
    "en": "Inc Ltd Corp Co Cos LLC Bros Jr Sr etc plc a.m p.m A.M P.M U.S U.K U.N E.U D.C L.P L.L.C N.V S.A B.V S.p.A Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    "de": "usw etc Co AG Jan Feb Apr Aug Sept Okt Nov Dez",
    "fr": "S.A S.A.S S.A.R.L etc",
    "es": "UU S.A S.L C.V etc",
    "el": "Α.Ε Ε.Ε Ο.Ε κ.λπ κλπ χ Ε",
}
#: Words of their own too: abbreviations only where a number follows.
NUMBERED = {"en": "No Nos no fig", "fr": "art fig", "es": "art cap fig"}
#: Function words by which a block in Latin letters shows its language.
FUNCTION_WORDS = {
    "en": "the of and to in is was were are be by for with on at as that this from its it he she his her they we then has have not or an",
    "de": "der die das und den dem ist von mit für auf im ein eine einer wurde wird nicht sich des zu sie wir er es am bei als",
    "fr": "le la les des du et une un est dans pour par sur que qui au aux il elle nous ce cette ses ne pas avec",
    "es": "el la los las de del y en un una por para con que se es al lo su sus no más fue como",
}
_MONTHS_DE = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jänner|Quartal|Halbjahr"
_ZONES = "Eastern|Pacific|Central|Mountain|Atlantic|Greenwich|London|New York|ET|EST|EDT|CET|CEST|PT|PST|CT|GMT|UTC"
_US_NOUNS = "Treasury|Treasuries|GAAP|Government|Federal|Dollars?|Senate|Congress|Department|Food|Bank|District|Army|Navy|Securities|Supreme|Court"
_HEADS = "Item|ITEM|Part|PART|Note|NOTE|Chapter|CHAPTER|Section|SECTION|Exhibit|EXHIBIT|Article|ARTICLE|Schedule|SCHEDULE|Appendix|APPENDIX|Teil|TEIL|Kapitel|Abschnitt|Anhang|Chap\\.?|Chapitre|Partie|Annexe|ANNEXE|Titre|Cap\\.?|Capítulo|Parte|Anexo|ANEXO|Κεφ\\.?|Κεφάλαιο|Μέρος|Παράρτημα|अध्याय|भाग|परिशिष्ट|الفصل|الباب|الملحق"


def _words(text: str) -> str:
    return "|".join(re.escape(w) for w in sorted(text.split(), key=len, reverse=True))


_UPPER_NEXT = r"\s*[\"“„«‹(\[¿¡‘—–-]*\s*(?:\p{Lu}|\p{Lt}|\p{Nd}|\p{Lo}|[a-z]{1,2}\p{Lu}|\$|€|£)"
_CONTINUES = r"\s*[,;:،؛、，；：%)\]）」』”»…]|\s*[-–—/&+=]"
_LOWER_NEXT = r"\s*[\"“„«‹(\[‘—–-]*\s*(?![a-z]{1,2}\p{Lu})\p{Ll}"
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}ー々〆"

def _last_parts(text: str) -> frozenset[str]:
    return frozenset(w.rpartition(".")[2] for w in text.split())


_NUMBER_NEXT = r"\s*[#(\[]?(?:\p{Nd}|[IVXLC]+(?!\p{L})|[A-Z](?:[-–]?\p{Nd}|[.)]))"
#: Stand for: the mark lies in an address; a slash stands before it in the same token.
ADDRESS, SLASHED = "address", "slashed"

#: The cascade: (table, marks it is for, breaks?, before, after, next[, words]). The text before
#: ends with the mark and its closing marks; ``^`` is the start of the sentence, and without it
#: only the end is matched. The text after begins right behind them, noise left out. ``next`` says
#: where the rule can match at all: ``n`` no space follows, ``s`` space does, then the kinds of the
#: next character (see _kind_of), none for all. A rule with ``words`` is tried only if the last
#: word before the mark is one of them; its table is then a language.
TABLES: list[tuple] = [
    # numbers, references, addresses
    ("number", ".", False, r"\p{Nd}\.", r"\p{Nd}", "nd"),
    ("number", ".", False, r"^\.", r"\p{Nd}", "nd"),
    ("number", ".", False, r"[\s$€£¥(\[−-]\.", r"\p{Nd}", "nd"),
    ("address", ".", False, ADDRESS, r"[\w/]", "ndulox,"),
    ("address", ".", False, r"[\p{Ll}\p{Nd}_-]\.", r"(?:[a-z]{2,4}|html?|example|aspx?)(?![\p{L}])", "nl"),
    ("address", "!?", False, SLASHED, r"[\w=&]", "ndulox,"),
    ("heading", ".", False, rf"^\W*(?:(?:{_HEADS})\s*)?(?:\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}{{1,3}})*[A-Za-z]?|[IVXLC]{{1,6}}|[A-Z])\.", r"\s+\S", "s"),
    ("heading", ".", False, r"^\W*(?:Chap|Cap|Κεφ)\.", r"\s", "s"),
    # German
    ("de", ".", False, rf"{_L}\p{{Nd}}{{1,2}}\.", rf"\s*(?:{_MONTHS_DE})(?!\p{{L}})", "nsu"),
    ("de", ".", False, rf"{_L}Co\.", r"\s*(?:KGa?A?|OHG|Ltd|Inc|LLC)(?!\p{L})", "nsu"),
    # English
    ("en", ".", False, rf"{_L}[ap]\.\s?m\.", rf"\s*(?:{_ZONES})(?!\p{{L}})", "nsu"),
    ("en", ".", False, rf"{_L}U\.\s?S\.", rf"\s*(?:{_US_NOUNS})(?!\p{{L}})", "nsu"),
    ("en", ".", False, rf"{_L}(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)\.", r"\s*\p{Nd}", "nsd"),
    ("en", "!?", False, r"^\p{Lu}\p{L}*!", r"\s+\p{Lu}\p{Ll}+,", "su"),
    ("en", "!?", False, r"\s\p{Lu}\p{L}*!", r"\s+\p{Lu}\p{Ll}+,", "su"),
    *((lang, ".", False, rf"{_L}(?:{_words(w)})\.", _NUMBER_NEXT, "", _last_parts(w)) for lang, w in NUMBERED.items()),
    *((lang, ".", False, rf"{_L}(?:{_words(w)})\.", "", "", _last_parts(w)) for lang, w in INNER.items()),
    *((lang, ".", False, rf"{_L}(?:{_words(w)})\.", rf"[{_CJK}]", "no", _last_parts(w)) for lang, w in OUTER.items()),
    *((lang, ".", True, rf"{_L}(?:{_words(w)})\.[{_CLOSE}“]*", rf"(?!{_CONTINUES})(?!{_LOWER_NEXT})(?:\s+|(?=[\"“„«(¿¡])){_UPPER_NEXT}", "", _last_parts(w)) for lang, w in OUTER.items()),
    *((lang, ".", False, rf"{_L}(?:{_words(w)})\.", "", "", _last_parts(w)) for lang, w in OUTER.items()),
    # initials, in any cased script; letters of a dotted word
    ("initial", ".", False, r"(?<![\p{L}\p{M}\p{N}%‐-])\p{Lu}\.", r"\s*[\p{L}(]", "nsuloq"),
    ("initial", ".", False, r"\p{L}\.\p{L}\.", r"\p{L}", "nulo"),
    ("initial", ".", False, r"(?<![\p{L}\p{M}\p{N}])\p{L}\.", r"\p{L}\.", "nulo"),
    # Japanese and Chinese: a closed quotation that goes on
    ("ja", "。", False, r"[」』）)”’]", r"[とをはがもにのでへや、，]|って|など|という|から|まで", "no,"),
    ("zh", "。", False, r"[」』）)”’]", r"[的等之，、；：]|一[词文说]|这[一个种]|为|是", "no,"),
    ("zh", "…", False, r"…", rf"[{_CJK}\p{{L}}\p{{N}}，、]", "ndulox,"),
    # defaults: what goes on, goes on; everything else breaks
    ("default", "…", False, r"(?:\.{2,}|…)", r"\s*[^\s\p{Lu}\"“„«¿¡(]", ""),
    ("default", ".!?…;", False, "", _CONTINUES, "ns,q"),
    ("default", ".!?…", False, "", _LOWER_NEXT, "nslq"),
    ("default", "。", False, "", r"\s*[，、；：,]", "ns,"),
    ("default", ".!?…。;", True, "", "", ""),
]


def _compile() -> list[tuple]:
    """(marks, breaks, before, whole sentence?, after, next, words, language) of every rule."""
    out = []
    for table, marks, breaks, before, after, where, *words in TABLES:
        whole = before.startswith("^")
        left = before if before in (ADDRESS, SLASHED) else re.compile(before[1:]) if whole else re.compile(f"(?<={before})") if before else None
        out.append((marks, breaks, left, whole, re.compile(after) if after else None, where, words[0] if words else None, table if words and table in FUNCTION_WORDS else None))
    return out


_RULES = _compile()
_ABBREVIATED = frozenset().union(*(r[6] for r in _RULES if r[6]))
_GREEK = re.compile(r"\p{Greek}")
_LETTER = re.compile(r"\p{L}")
_THAI = re.compile(r"[฀-๿]")
_VISIBLE = re.compile(r"\S")
_LEADING = re.compile(r"\s*")
#: Backwards from the mark, one character more than the longest abbreviation has.
_LAST_WORD = re.compile(rf"(?r)[\p{{L}}\p{{M}}\p{{N}}]{{0,{max(map(len, _ABBREVIATED)) + 1}}}")
_ADDRESSES = re.compile(r"(?:https?://|www\.|(?<=[\w.+-])@)\S*")
_SLASHES = re.compile(r"/\S*")
_EVIDENCE = {lang: re.compile(rf"(?i)(?<!\p{{L}})(?:{_words(w)})(?!\p{{L}})") for lang, w in FUNCTION_WORDS.items()}
_ODD = re.compile(rf"{_NOISE.pattern}|{_INVISIBLE.pattern}")
_INDEX: dict[tuple, list[tuple]] = {}
_KINDS: dict[str, str] = {"": "e"}


def _kind_of(c: str) -> str:
    """d digit, u capital, l small letter, o other letter or sign on one, q opening mark or dash,
    "," what goes on, x anything else, e nothing."""
    kind = _KINDS.get(c)
    if kind is None:
        group = unicodedata.category(c)
        kind = "q" if c in "\"“„«‹([¿¡‘—–-" else "," if re.match(_CONTINUES, c) else {"Nd": "d", "Lu": "u", "Lt": "u", "Ll": "l"}.get(group) or ("o" if group[0] in "LM" else "x")
        _KINDS[c] = kind
    return kind


def _cascade(mark: str, word: str | None, spaced: bool, following: str) -> list[tuple]:
    """The rules that can match there, in their order."""
    key = (mark, word, spaced, following)
    if key not in _INDEX:
        _INDEX[key] = [
            (breaks, left, whole, after, language)
            for marks, breaks, left, whole, after, where, words, language in _RULES
            if mark in marks and (words is None or word in words)
            and (not where or (("s" if spaced else "n") in where or not set("ns") & set(where)) and (not set(where) - set("ns") or following in where))
        ]
    return _INDEX[key]


def _languages(block: str) -> frozenset[str]:
    """The languages in Latin letters that the block's function words allow; all if it has none."""
    found = {lang: sum(1 for _ in words.finditer(block)) for lang, words in _EVIDENCE.items()}
    most = max(found.values())
    return frozenset(lang for lang, n in found.items() if 2 * n >= most)


def _pair_up(block: str) -> list[tuple[int, int]]:
    """(opening, closing) places of all matched quotation marks and brackets of a block."""
    found, stack = [], []
    waiting: dict[str, int] = {}
    for m in _PAIRED.finditer(block):
        c, at = m.group(), m.start()
        opens = '"' if c == '"' else _OPENS.get(c, "")
        if any(waiting.get(o) for o in opens):
            while True:
                o, begin = stack.pop()
                waiting[o] -= 1
                if o in opens:
                    break
            found.append((begin, at))
        elif c == '"' or c in _PAIRS:
            stack.append((c, at))
            waiting[c] = waiting.get(c, 0) + 1
    return found


_OPENS = {c: "".join(o for o, closes in _PAIRS.items() if c in closes) for closes in _PAIRS.values() for c in closes}


def _mark_kind(mark: str) -> str:
    if len(mark) == 1:
        return mark if mark == "." else _SINGLE.get(mark, ".")
    core = mark.rstrip(_CLOSE.replace("\\", "") + "“   ")
    if len(core) >= 2 and set(core) <= set(".…") or core.endswith("…"):
        return "…"
    return _SINGLE.get(core[-1:], ".")


_SINGLE = {**dict.fromkeys("!?", "!"), **dict.fromkeys("。！？｡؟۔।॥‼⁇⁈⁉", "。"), **dict.fromkeys(";;", ";"), "…": "…"}


def _views(block: str, cuts: list[int]) -> tuple[str, str, dict[int, int] | None, dict[int, int] | None]:
    """(text before, text after, places in them) without what does not count.

    The text before is composed and has no invisible characters, the text after has no noise
    either; a place inside noise sees the noise. Places are None where nothing is left out.
    """
    if not _ODD.search(block) and unicodedata.is_normalized("NFC", block):
        return block, block, None, None
    noise = [m.span() for m in _NOISE.finditer(block)]
    before, after, at_before, at_after = [], [], {}, {}
    size_before = size_after = at = n = 0
    for cut in [*sorted(set(cuts)), len(block)]:
        part = block[at:cut]
        clean = unicodedata.normalize("NFC", _INVISIBLE.sub("", part))
        kept, here = [], at
        while n < len(noise) and noise[n][0] < cut:
            kept.append(block[here : max(here, noise[n][0])])
            here = max(here, min(noise[n][1], cut))
            if noise[n][1] > cut:
                break
            n += 1
        kept.append(block[here:cut])
        seen = unicodedata.normalize("NFC", _INVISIBLE.sub("", "".join(kept)))
        before.append(clean)
        after.append(seen)
        size_before += len(clean)
        size_after += len(seen)
        at_before[cut], at_after[cut] = size_before, size_after
        if n < len(noise) and noise[n][0] < cut < noise[n][1]:
            at_after[cut] = -cut  # inside noise: looked at as it stands
        at = cut
    at_before[0], at_after[0] = at_before.get(0, 0), at_after.get(0, 0)
    return "".join(before), "".join(after), at_before, at_after


def _greek_question(block: str, letters: list[int], greek: list[int], last: int, at: int) -> bool:
    """Whether a semicolon asks a question: the sentence so far has Greek letters and is mostly
    Greek, or goes on in Greek or ends there."""
    first, here = bisect_left(letters, last), bisect_left(letters, at)
    mine = bisect_left(greek, at) - bisect_left(greek, last)
    return mine > 0 and (2 * mine >= here - first or here == len(letters) or _GREEK.match(block[letters[here]]) is not None)


def _prose(text: str, start: int, end: int) -> Iterator[int]:
    """Cut places inside text[start:end], a block part without list items."""
    block = text[start:end]
    entities = {m.end() - 1 for m in _ENTITY.finditer(block)} if "&" in block else ()
    marks = [(m.start(), m.end()) for m in _MARKS.finditer(block) if block[m.start()] not in ";;" or m.start() not in entities]
    gaps = [(m.start("gap"), m.end("gap")) for m in _THAI_SPACE.finditer(block)] if _THAI.search(block) else []
    if not marks and not gaps:
        return
    greek, letters = [], []
    if any(block[at] in ";;" for at, _ in marks):
        greek = [m.start() for m in _GREEK.finditer(block)]
        letters = [m.start() for m in _LETTER.finditer(block)] if greek else []
    pairs = sorted(_pair_up(block))
    opening = {c: o for o, c in pairs}
    places: list[tuple[int, int, int, int]] = [(a, b, -1, -1) for a, b in gaps]
    for at, stop in marks:
        core = edge = stop
        if stop - at > 1:
            # Only closing marks whose opening lies before belong to the cut; an opening one starts what follows.
            core = next((k for k in range(at, stop) if block[k] in _CLOSE + "“" or block[k] in "   "), stop)
            edge = core
            for k in range(core, stop):
                if opening.get(k, at) < at or block[k] in "'’" or (block[k] in "   " and opening.get(k + 1, at) < at):
                    edge = k + 1
                else:
                    break
        places.append((at, stop, core, edge))
    places.sort()
    before, after, at_before, at_after = _views(block, [k for _, stop, core, edge in places for k in (stop, max(core - 1, 0), max(edge, 0))])
    spans: dict[str, list[tuple[int, int]]] = {}

    def lies_in(name: str, at: int) -> bool:
        if name not in spans:
            spans[name] = [m.span() for m in (_ADDRESSES if name == ADDRESS else _SLASHES).finditer(block)]
        k = bisect_left(spans[name], (at,)) - 1
        return k >= 0 and at < spans[name][k][1]

    languages = None
    last = seen = reach = 0
    first = -1
    for at, stop, core, edge in places:
        while seen < len(pairs) and pairs[seen][0] < at:
            reach = max(reach, pairs[seen][1])
            seen += 1
        if reach >= stop:
            continue  # inside a quotation or bracket that does not close right here
        if core < 0:
            yield start + stop
            last, first = stop, -1
            continue
        mark = _mark_kind(block[at:core])
        if mark == ";" and not _greek_question(block, letters, greek, last, at):
            continue
        if not _VISIBLE.search(block, edge):
            return
        opened = opening.get(edge - 1) if edge > core else None
        if opened is not None and mark == "。" and block[opened] in _BRACKETS and block[last:opened].strip():
            continue  # a remark in brackets within a sentence
        here, there, ahead = edge, edge, after
        dot = core - 1
        if at_before is not None:
            here, dot, there = at_before[edge], at_before[dot], at_after[edge]
            if there < 0:
                there, ahead = -there, block
        word = None
        if mark == ".":
            word = _LAST_WORD.match(before, 0, dot).group()
            if word not in _ABBREVIATED:
                word = None
        visible = _VISIBLE.search(ahead, there)
        visible = visible.start() if visible else len(ahead)
        spaced, following = visible > there, _kind_of(ahead[visible : visible + 1])
        for breaks, left, whole, right, language in _cascade(mark, word, spaced, following):
            # What follows is looked at first: it fails at once where what comes before must be searched.
            if right is not None and not right.match(ahead, there):
                continue
            if whole:
                if first < 0:
                    first = _LEADING.match(before, at_before[last] if at_before is not None else last).end()
                if not left.fullmatch(before, first, here):
                    continue
            elif left is ADDRESS or left is SLASHED:
                if not lies_in(left, at):
                    continue
            elif left is not None and not left.match(before, here):
                continue
            if language is not None and not breaks and spaced and following in "uq" and word.islower():
                # A small word that another language abbreviates is a word here.
                if languages is None:
                    languages = _languages(block)
                if language not in languages:
                    continue
            if breaks:
                yield start + edge
                last, first = edge, -1
            break


def sentences(text: str | None) -> list[tuple[int, int]]:
    """The [start, end) places of the sentences of a text, outer white space left out."""
    if not text:
        return []
    cuts = {0, len(text)}
    at = 0
    for blank in [*_BLANK.finditer(text), None]:
        end = blank.start() if blank else len(text)
        if end > at:
            items = [m.start("item") for m in _ITEM.finditer(text, at, end) if m.start() == at or text[m.start()] in "\n\r\v\f\x85  "]
            if not items or items[0] > at:
                cuts.update(_prose(text, at, items[0] if items else end))
            cuts.update(items)
        if blank:
            cuts.update((blank.start(), blank.end()))
            at = blank.end()
    places = sorted(cuts)
    out = []
    for a, b in zip(places, places[1:]):
        part = text[a:b]
        whole = part.strip()
        if whole:
            lead = len(part) - len(part.lstrip())
            out.append((a + lead, a + lead + len(whole)))
    return out


def split_sentences(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """(id, start_pos, end_pos[, sentence]) of every document, 0-based, end exclusive."""
    source = spread(documents.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text")), "__id")
    kind = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            take, starts, ends, parts = [], [], [], []
            for i in range(len(texts)):
                text = texts[i].as_py()
                for a, b in sentences(text):
                    take.append(i)
                    starts.append(a)
                    ends.append(b)
                    if with_text:
                        parts.append(text[a:b])
            columns = [batch.column(0).take(pa.array(take, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(parts, pa.string())] if with_text else []), names=[id_column, "start_pos", "end_pos"] + (["sentence"] if with_text else []))

    return source.mapInArrow(run, f"`{id_column}` {kind}, start_pos int, end_pos int" + (", sentence string" if with_text else ""))
