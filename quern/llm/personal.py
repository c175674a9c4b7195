"""Personal information in free text: spans of emails, phones, identity numbers, addresses and names.

Patterns propose candidate spans; six labelers (format, label before it, gazetteer, what follows,
layout, shape) vote for, against, or not at all.  Expectation-maximisation estimates from the
votes alone how far each labeler can be relied on, and its posteriors train a logistic span
classifier over the votes and hashed context.  What is known of words (how often they stand in
lower case, as a surname after a given name or title, after a word of place) is counted over all documents and kept as rates, one byte a word, in a table of hash
slots that grows with the vocabulary up to 2^26 slots; with more than a million known words the
share of strange words that fall on a known one rises above 1.6 percent.  Only the labelers and the
classifier are fitted on a bounded sample of documents (sample_rows).

A name is proposed wherever a given name, initials, a title, a
surname with evidence, or two capitalised words that the corpus hardly ever shows in lower case
stand; in Latin and Cyrillic script in any case, in Han script by surname, length and neighbours.

Cases: null and empty texts have no spans; texts of any length are scanned whole; repeated
texts are each reported under their own id; spans of one document never overlap; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import map_batches
from quern.llm.nameforms import _PET
from quern.runtime import durable, hash_sample

KINDS = ("email", "address", "id_number", "phone", "name")
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 26
# what a word's byte says
COMMON, SURNAME, STRONG, LOWER_SURNAME, PLACE, INITIAL, FIRST, SECOND = 1, 2, 4, 8, 16, 32, 64, 128
_HASHED = 1 << 14
LABELERS = 6

_EMAIL = re.compile(
    r"(?<![\w@.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?\s?(?:@|\[at\]|\(at\)|\{at\}|<at>)\s?[A-Za-z0-9-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z][A-Za-z0-9-]*)+",
    re.IGNORECASE,
)
_SPELLED = re.compile(
    r"(?<![\w@.+-])[A-Za-z0-9][A-Za-z0-9+_-]*(?: (?:dot|punto|point|punkt) [A-Za-z0-9][A-Za-z0-9+_-]*)* (?:at|arroba|\[at\]|\(at\)) [A-Za-z0-9-]+(?: (?:dot|punto|point|punkt) [A-Za-z0-9-]+)+(?![\w-])(?! at )",
    re.IGNORECASE,
)
# spelled addresses hold one of these
_DOTS = (" dot ", " punto ", " point ", " punkt ")
_AT_GATE = re.compile(r"@|[\[({<]at[\])}>]", re.IGNORECASE)
_EXT = r"(?:,?\s?(?:ext\.?|extension|x|durchwahl|poste|int\.?)\s?\d{1,5})?"
_PHONE = re.compile(
    r"(?<![\w@/+-])(?<!\d\.)(?:"
    r"(?:\+|00)[1-9]\d{0,2}(?:[\s./-]?\(?\d{1,8}\)?){1,6}"
    r"|\(\d{2,5}\)[\s/-]?\d{3,8}(?:[\s-]\d{2,6}){0,3}"
    r"|0\d(?:[\s.]\d\d){4}"
    r"|0\d{2,4}[\s/-]\d{3,8}(?:[\s-]\d{2,6}){0,2}"
    r"|(?:1[.\s-])?\d{3}[.\s-]\d{3}[.\s-]\d{4}"
    r"|\d{3}-\d{4}"
    r"|1[3-9]\d[\s-]?\d{4}[\s-]?\d{4}"
    r")" + _EXT + r"(?![\w]|[.-]\d)",
    re.IGNORECASE,
)
_ID = re.compile(
    r"(?<![\w@/+-])(?<!\d\.)(?:"
    r"[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-Z]"
    r"|[12]\s\d\d\s\d\d\s\d\d\s\d{3}\s\d{3}\s\d\d|[12]\d{14}"
    r"|\d{3}[\s-]\d\d[\s-]\d{4}"
    r"|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r"|[A-Z]{3}\d\d-\d{3}-[A-Z]\d"
    r"|[A-Z]{1,2}\d{7,8}"
    r"|\d{17}[\dXx]"
    r")(?![\w]|-\d)"
)
# no phone or identity number is shorter than this
_NUMBER_GATE = re.compile(r"\d[\d\s()./-]{5,}\d|[A-Z]{1,3}[\s-]?\d{2}")
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"
_TOWN = rf"{_CAP}(?![.@+_]\w)"
_STREET = r"(?:Street|St\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Avenue|Ave\b\.?|Quay|Close|Terrace|Gardens|Row|Way|Court|Place|Square|Crescent|Drive|Hill|Walk|Mews|Wharf|Parade)"
_FLAT = r"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|Room)\s\w{1,4},\s)?"
# each form of address with words of which it holds one, and a cheap test of whether it can occur at all
_STREET_WORDS = ("Street", "St", "Road", "Rd", "Lane", "Ln", "Avenue", "Ave", "Quay", "Close", "Terrace", "Gardens", "Row", "Way", "Court", "Place", "Square", "Crescent", "Drive", "Hill", "Walk", "Mews", "Wharf", "Parade")
_ADDRESSES = [
    (_STREET_WORDS, re.compile(r"\d[a-z]?\s[A-ZÀ-ÖØ-Þ]"), re.compile(rf"(?<![\w-]){_FLAT}\d{{1,4}}[a-z]?\s{_CAP}(?:\s{_CAP})?\s{_STREET}(?:,\s{_TOWN}(?:,?\s\d{{5}})?)?(?!\w)")),
    (("Box",), re.compile(r"Box\s\d"), re.compile(rf"(?<![\w-])P\.?\s?O\.?\sBox\s\d+(?:,\s{_TOWN}(?:,?\s\d{{5}})?)?(?!\w)")),
    (("rue", "avenue", "quai", "boulevard", "place", "chemin", "impasse", "allée"), re.compile(r"\s(?:rue|avenue|quai|boulevard|place|chemin|impasse|allée)\s"), re.compile(rf"(?<![\w-])\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|quai|boulevard|place|chemin|impasse|allée)\s(?:de\sla\s|de\s|du\s|des\s|d['’])?{_CAP}(?:,\s\d{{5}}\s{_TOWN})?(?!\w)")),
    (("str.", "straße", "strasse", "weg", "gasse", "platz", "allee", "ufer", "damm"), re.compile(r"(?:str\.|straße|strasse|weg|gasse|platz|allee|ufer|damm)\s\d"), re.compile(rf"(?<![\w-])[A-ZÀ-ÖØ-Þ]\w+(?:str\.|straße|strasse|weg|gasse|platz|allee|ufer|damm)\s\d{{1,4}}[a-z]?(?:,?\s(?:D-)?\d{{5}}\s{_TOWN})?(?!\w)")),
    (("C/", "Calle", "Avda", "Avenida", "Plaza", "Paseo"), re.compile(r"C/|Calle|Avda|Avenida|Plaza|Paseo"), re.compile(rf"(?<![\w-])(?:C/|Calle|Avda\.|Avenida|Plaza|Paseo)\s{_CAP},?\s(?:n\.º\s|núm\.\s)?\d{{1,4}}(?:,\s\d{{5}}\s{_TOWN})?(?!\w)")),
    (("号",), re.compile(r"号"), re.compile(r"(?:(?<![一-鿿])[一-鿿]{1,5}|[一-鿿]{1,3})(?:街|路|巷|大道|胡同)\d+号(?:\d+[栋幢座])?(?:\d+单元)?(?:\d+[室楼号])?")),
]
_LABELS = {
    "email": re.compile(r"(?<![A-Za-z])(?:e-?mail|mail|contact|reach me at|write to|replies go to|courriel|correo)\W*$", re.IGNORECASE),
    "phone": re.compile(r"(?<![A-Za-z])(?:tel|telephone|phone|fax|mobile|call|ring|cell|telefon|téléphone|teléfono|电话|手机|тел)\W*(?:fax)?\W*$", re.IGNORECASE),
    "id_number": re.compile(r"(?<![A-Za-z])(?:ssn|dni|nif|passport|insurance|ni no|id|ausweis-nr|steuer-id|tax|numéro|身份证|паспорт|his number is|her number is|identity(?: card)?)\W*(?:no|number|nr)?\W*$", re.IGNORECASE),
    "address": re.compile(r"(?<![A-Za-z])(?:address|adresse|anschrift|dirección|lives at|deliver to|return to|moved to|地址|住址|адрес)\W*$", re.IGNORECASE),
    "name": re.compile(r"(?<![A-Za-z])(?:yours|saludos|mit gruß|bien à vous|name|dear|sincerely|said|asked|cried|with|by)\W*$", re.IGNORECASE),
}
# nouns whose numbers identify things, up to three words before the number
_DECOY = re.compile(
    r"(?<![A-Za-z])(?:(?i:parcel|isbn|shelfmark(?: ms-?)?|version|reference|item|lot|invoice|order|page|chapter|file|handle|tracking|serial|model|batch|ticket)(?:\s[a-z]{1,9}){0,3}\.?(?:\s\S*\.\w+)?|(?i:vol|p|no|nr|núm|ref)\.)\W*$"
)
_NEUTRAL = re.compile(r"(?<![A-Za-z])(?:at|was|said|under|card|or|/|–|\||[:;,])\W*$|[:;,|/–]\W*$", re.IGNORECASE)
_PLACE_BEFORE = re.compile(r"(?<!\w)(?:in|at|near|the|of|der|die|das|dem|den|ein|eine|einen|im|am|zum|zur|à|en|nach|aus|в|el|la|le|los|las|les|du|des|un|une|una)\s+$", re.IGNORECASE)
_DIGIT = re.compile(r"\d")
_LETTERS = "A-Za-zÀ-ÖØ-öø-žА-Яа-яЁё"
_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_WORD = re.compile(rf"[{_LETTERS}]+(?:['’-][{_LETTERS}]+)*")
# a capitalised word and the capitalised word after it, initials between them left out
_PAIR = re.compile(rf"(?<![{_LETTERS}])([{_UPPER}][{_LETTERS}]*)(?=\.?\s+(?:[{_UPPER}]\.\s+)*([{_UPPER}][{_LETTERS}]*(?:['’-][{_LETTERS}]+)*)(?!\d))")
_OPENS = re.compile(rf"(?:^|[.!?…:;|“„\"«—(]|\n\s*\n)\s*[“„\"«]?([{_UPPER}][{_LETTERS}]*)")
_PLACED = re.compile(rf"(?<![{_LETTERS}])(?:in|at|near|à|en|nach|aus|в|из|bei)\s+([{_UPPER}][{_LETTERS}]+)")
_POSSESSIVE = re.compile(r"['’]s$")
_INNER = re.compile(r"['’-]")
_CAPITAL = re.compile(rf"(?<![{_LETTERS}])[{_UPPER}][{_LETTERS}]*(?:['’-][{_LETTERS}]+)*")
_LOWER = re.compile(r"[a-zß-öø-žа-яё]{2,}")
_LOWER_AFTER = re.compile(rf"\s+[a-zß-öø-žа-яё][{_LETTERS}]+")
# Frequent surnames in Han script, and characters that are words of their own rather than part of a given name.
HAN_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
_HAN_WORDS = "的了在是不有这那我你他她它们和与就都而及着或一个没上下大小为以可能会要到说问写答道走来去把给对被从向从前后里外中车站天年月日时分点号街路巷室楼"
_HAN_GATE = re.compile(f"[{HAN_SURNAMES}]")
_HAN_NAME = re.compile(
    rf"(?:(?<![一-鿿])|(?<=[和与跟给对向被由叫见找请替到是了天年月日午晚后时候让]))([{HAN_SURNAMES}][^\W\d_A-Za-z{_HAN_WORDS}]{{0,1}}[^\W\d_A-Za-z{_HAN_WORDS}匠师员工人者家客医商民])"
    rf"(?=说|问|写|答|喊|走|来|去|把|给|和|与|在|是|的|了|也|都|又|就|还|曾|正|将|会|已|先生|女士|小姐|太太|老师|医生|[，。！？；：、”」）\s]|$)"
)
_KANA = re.compile(r"[぀-ヿ]")
TITLES = frozenset("mr mrs ms miss dr prof sir lady lord dame capt captain sgt sergeant rev col maj lt gen hon mme mlle hr fr herr frau sr sra srta dra don doña señor señora monsieur madame master".split())
_ORG_NEXT = re.compile(
    r"(?:['’]s)?\s*(?:&|and\s+(?:Sons|Co)\b|(?:Brothers|Bros|Sons|Shipping|Railway|Printing|Assurance|Archive|Mills|Company|Limited|Ltd|Trust|Society|House|Works|Inc|Bank|GmbH)\b)"
)
_FIRM_WORDS = frozenset("brothers bros sons shipping railway printing assurance archive mills company limited ltd trust society house works inc bank gmbh haus box nr street road lane avenue station monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split())
_COMMON = frozenset(
    "the a an and or but of in on at to by for with from as that this every one it he she they we i you is was were be been has had not no so until while because although which who what when where why how if then than into near under der die das und ein eine le la les et el los las un une de du des dann wo wer warum".split()
)
GIVEN_FULL = frozenset(v for vs in _PET.values() for v in vs)
_ORDINARY = frozenset("dot will bill rich rob nat kit sandy sue pat jack harry dan ray mark dick rick penny val nell daisy bob jo al ed lee hal greta rita stu hump yo kitty gail ben ten max len leo rica tom sam jem mina dora willa xena tory billie nace alec libby pip cindy jerry".split())


_LOWER_GIVEN = frozenset(w for w in _PET if w not in _ORDINARY and len(w) > 2)


#: Runs without white space that are known to hold no word in lower case of which a name can be made, of the table in use.
_COLD: set[str] = set()


def _slot(word: str, table: np.ndarray) -> int:
    return zlib.crc32(word.encode()) & (len(table) - 1)


def name_tokens(text: str):
    return [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]


def possible_name_tokens(text: str, table: np.ndarray):
    """The tokens of which names can be made.  A word in lower case takes part only as a given name, as a word with surname
    evidence, or straight after a given name: where no word of the text is one of the first two, the others needn't be read."""
    for part in set(text.split()) - _COLD:
        for word in _LOWER.findall(part):
            if word in _LOWER_GIVEN or _facts(word, table)[4]:
                return name_tokens(text)
        if len(_COLD) > 500_000:
            _COLD.clear()
        if len(part) < 40:
            _COLD.add(part)
    toks = []
    for m in _CAPITAL.finditer(text):
        word = m.group()
        toks.append((word, m.start(), m.end()))
        if _facts(word, table)[1]:
            after = _LOWER_AFTER.match(text, m.end())
            if after:
                w = after.group().lstrip()
                toks.append((w, after.end() - len(w), after.end()))
    return toks


_COUNTS = ("low", "cap", "evid", "placed", "opens", "first", "second")


def word_knowledge(documents: DataFrame) -> np.ndarray:
    """One byte of what all documents show of a word, at the slot of its caseless form."""
    schema = T.StructType([T.StructField("h", T.LongType()), *(T.StructField(c, T.LongType()) for c in _COUNTS)])

    def count(batch):
        words: Counter = Counter()
        surname: Counter = Counter()
        placed: Counter = Counter()
        opens: Counter = Counter()
        first: Counter = Counter()
        second: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            words.update(_WORD.findall(text))
            placed.update(_PLACED.findall(text))
            opens.update(_OPENS.findall(text))
            for m in _PAIR.finditer(text):
                low, token = m.group(1).casefold(), _POSSESSIVE.sub("", m.group(2))
                gap = text[m.end(1) : m.start(2)]
                if gap.count("\n") > 1 or low not in TITLES and gap[0] == "." or token.isupper() and not m.group(1).isupper():
                    continue
                first[m.group(1)] += 1
                second[token] += 1
                if low not in TITLES and (low not in _PET or low in _ORDINARY):
                    continue
                # a surname with a hyphen or apostrophe counts whole and by its first part
                for last in {token, _INNER.split(token, maxsplit=1)[0]}:
                    if len(last) >= 2 and last.casefold() not in _PET and not _ORG_NEXT.match(text, m.start(2) + len(last)):
                        surname[last] += 1
        found: dict[int, list[int]] = {}
        for at, counter in ((None, words), (2, surname), (3, placed), (4, opens), (5, first), (6, second)):
            for word, n in counter.items():
                h = zlib.crc32(_POSSESSIVE.sub("", word).casefold().encode())
                row = found.setdefault(h, [0] * len(_COUNTS))
                row[at if at is not None else int(word[0].isupper())] += n
        out = {"h": list(found)}
        for i, c in enumerate(_COUNTS):
            out[c] = [r[i] for r in found.values()]
        return out

    counted = map_batches(documents.select(F.col("text").cast("string")), schema, count)
    per = counted.groupBy("h").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    low, cap, evid = F.col("low"), F.col("cap"), F.col("evid")
    bit = lambda cond, value: F.when(cond, value).otherwise(0)
    surname = (evid > 0) & (evid * 20 >= cap)
    code = (
        bit((low > 0) & (low * 10 >= cap), COMMON) + bit(surname, SURNAME) + bit(surname & (evid > 1), STRONG)
        + bit(surname & (evid * 20 >= cap + low), LOWER_SURNAME)
        + bit((F.col("placed") > 0) & (F.col("placed") * 4 >= cap), PLACE) + bit((cap > 2) & (F.col("opens") * 10 >= cap * 9), INITIAL)
        + bit((F.col("first") > 2) & (F.col("first") * 2 >= cap), FIRST) + bit((F.col("second") > 2) & (F.col("second") * 3 >= cap), SECOND)
    )
    known = durable(per.select("h", code.cast("int").alias("code")).filter("code > 0"))
    slots = LEAST_SLOTS
    while slots < MOST_SLOTS and slots < 64 * known.count():
        slots *= 2
    rows = known.groupBy(F.pmod(F.col("h"), F.lit(slots)).cast("int").alias("slot")).agg(F.max("code").alias("code"))
    table = np.zeros(slots, dtype=np.uint8)
    for r in rows.toLocalIterator():
        table[r["slot"]] = r["code"]
    return table


def _french(text: str, at: int) -> bool:
    around = text[max(0, at - 60) : at + 90]
    return len(re.findall(r"\b(?:le|la|les|un|une|des|du|au|en|fût|et|paya|soit|sous|avant|était)\b|[àéèêçùô]", around)) >= 3


_FACTS: dict[str, tuple] = {}


def forget_words() -> None:
    """Empty what is remembered of words; needed when another table comes into use."""
    _FACTS.clear()
    _COLD.clear()


def _facts(word: str, table: np.ndarray) -> tuple:
    """(caseless form, may be a given name, surname evidence, may take part in a name, counts in lower case, its byte)."""
    got = _FACTS.get(word)
    if got is None:
        if len(_FACTS) > 300_000:
            _FACTS.clear()
        low = word.casefold()
        code = int(table[_slot(_POSSESSIVE.sub("", low), table)])
        upper = word[0].isupper()
        n = (1 + (code & STRONG > 0)) if code & (SURNAME if upper else LOWER_SURNAME) else 0
        given = low in _PET
        got = _FACTS[word] = (low, given, n, given or n > 0 or upper and (low not in _COMMON or len(word) == 1), n > 0 and not upper and low not in _COMMON, code)
    return got


def name_candidates(text: str, table: np.ndarray):
    """(start, end, form, surname evidence) of possible names, left to right, without overlaps."""
    toks = possible_name_tokens(text, table)
    facts = [_facts(w, table) for w, _, _ in toks]
    out, i, n = [], 0, len(toks)

    def gap(a, b):
        return text[toks[a][2] : toks[b][1]]

    def blank(g):
        return g != "" and not g.strip() and g.count("\n") < 2

    def evidence(k):
        return facts[k][2]

    def surname_like(k, strict=False):
        w = toks[k][0]
        if len(w) < 2 or facts[k][0] in _COMMON or facts[k][0] in GIVEN_FULL:
            return False
        if w[0].isupper() and not strict:
            return evidence(k) > 0 or not facts[k][1] and not facts[k][5] & (COMMON | INITIAL) and w.casefold() not in TITLES
        return evidence(k) > 0

    def is_given(k):
        return facts[k][1]

    def proper(k):
        w, code = toks[k][0], facts[k][5]
        return len(w) > 1 and w[0].isupper() and not w.isupper() and not facts[k][1] and (code & LOWER_SURNAME or not code & COMMON) and not code & (PLACE | INITIAL) and facts[k][0] not in _COMMON and facts[k][0] not in TITLES and facts[k][0] not in _FIRM_WORDS and _POSSESSIVE.search(w) is None

    while i < n:
        low, given, n_evidence, part, _, code = facts[i]
        word, s, e = toks[i]
        # nothing can begin at an ordinary word: no given name, no initial, no evidence, and of small letters elsewhere
        if not part or code & (COMMON | INITIAL) and not given and not n_evidence and len(word) > 1:
            i += 1
            continue
        # given name, initials, surname
        if is_given(i):
            j = i + 1
            while j < n and len(toks[j][0]) == 1 and toks[j][0].isalpha() and (text[toks[j][2] : toks[j][2] + 1] == "." or toks[j][0].isupper()) and blank(gap(j - 1, j).replace(".", "", 1)):
                j += 1
            ok = j < n and blank(gap(j - 1, j).replace(".", "", 1) if j > i + 1 else gap(j - 1, j))
            cased = word[0].isupper()
            if ok and surname_like(j, strict=not cased or low in _ORDINARY) and (toks[j][0][0].isupper() or evidence(j) > 0):
                out.append((s, toks[j][2], "full", evidence(j)))
                i = j + 1
                continue
        # initials and surname
        if len(word) == 1 and word.isupper() and text[e : e + 1] == "." and not text[max(0, s - 2) : s].strip()[-1:].isdigit():
            j = i
            while j + 1 < n and len(toks[j + 1][0]) == 1 and toks[j + 1][0].isupper() and text[toks[j + 1][2] : toks[j + 1][2] + 1] == "." and blank(gap(j, j + 1).replace(".", "", 1)):
                j += 1
            k = j + 1
            if k < n and blank(gap(j, k).replace(".", "", 1)) and toks[k][0][0].isupper() and surname_like(k) and len(toks[k][0]) >= 2:
                if word == "M" and j == i and _french(text, s):
                    out.append((toks[k][1], toks[k][2], "titled", evidence(k)))
                else:
                    out.append((s, toks[k][2], "initial", evidence(k)))
                i = k + 1
                continue
        titled = i > 0 and toks[i - 1][0].casefold() in TITLES and blank(gap(i - 1, i).replace(".", "", 1))
        if word[0].isupper() and len(word) >= 2 and low not in _COMMON and low not in GIVEN_FULL or evidence(i) > 0 and not word[0].isupper():
            # surname before the given name, with or without a comma
            if i + 1 < n and is_given(i + 1) and (word[0].isupper() or evidence(i) > 0):
                g = gap(i, i + 1)
                comma = bool(re.fullmatch(r",\s?", g))
                preposition = not comma and facts[i + 1][0] in _ORDINARY and toks[i + 1][0][0].islower() and word[0].isupper()
                if (comma or blank(g) and not preposition) and evidence(i) > 0:
                    j = i + 2
                    end = toks[i + 1][2]
                    while j < n and len(toks[j][0]) == 1 and toks[j][0].isupper() and blank(gap(j - 1, j).replace(".", "", 1)):
                        end = toks[j][2] + (text[toks[j][2] : toks[j][2] + 1] == ".")
                        j += 1
                    follows = j < n and blank(gap(j - 1, j)) and toks[j][0][0].isupper() and surname_like(j) and evidence(j) > 0
                    if not follows:
                        out.append((s, end, "reversed", evidence(i)))
                        i = j
                        continue
            if i + 1 < n and len(toks[i + 1][0]) == 1 and (toks[i + 1][0].isupper() or not word[0].isupper()) and re.fullmatch(r",\s", gap(i, i + 1)) and text[toks[i + 1][2] : toks[i + 1][2] + 1] == "." and evidence(i) > 0:
                out.append((s, toks[i + 1][2] + 1, "reversed", evidence(i)))
                i += 2
                continue
            if titled and word[0].isupper() and surname_like(i):
                out.append((s, e, "titled", evidence(i)))
                i += 1
                continue
            # two or three words in a row that the corpus capitalises, the first of which no list holds
            if proper(i) and not titled:
                j = i
                while j + 1 < n and j - i < 2 and blank(gap(j, j + 1)) and proper(j + 1):
                    j += 1
                if j > i and not (j + 1 < n and toks[j + 1][0][0].isupper() and blank(gap(j, j + 1))):
                    out.append((s, toks[j][2], "pair", 2 * (facts[i][5] & FIRST > 0 and facts[j][5] & SECOND > 0)))
                    i = j + 1
                    continue
            if word[0].isupper() and evidence(i) > 0 and (facts[i][5] & LOWER_SURNAME or not facts[i][5] & COMMON):
                out.append((s, e, "alone", evidence(i)))
        i += 1
    if _HAN_GATE.search(text) and not _KANA.search(text):
        out += [(m.start(1), m.end(1), "han", 0) for m in _HAN_NAME.finditer(text)]
    return out


def candidates(text: str, table: np.ndarray):
    """(kind, start, end, votes, hashed context) of every candidate span."""
    found = []
    low = text.lower()
    if "@" in text or "at" in low and _AT_GATE.search(text):
        for m in _EMAIL.finditer(text):
            found.append(("email", m.start(), m.end(), 1 if "@" in m.group() else 0, "plain"))
    if any(word in low for word in _DOTS):
        for m in _SPELLED.finditer(text):
            found.append(("email", m.start(), m.end(), 1, "spelled"))
    if _DIGIT.search(text):
        for words, gate, pattern in _ADDRESSES:
            if words and not any(w in text for w in words) or not gate.search(text):
                continue
            for m in pattern.finditer(text):
                s, e = m.start(), m.end()
                town = m.group().rsplit(", ", 1)
                if len(town) == 2 and town[1].casefold() in _PET:
                    e = s + len(town[0])
                while text[e - 1] in ",;:":
                    e -= 1
                found.append(("address", s, e, 1 if re.search(r"\d{5}|,|号|Box", m.group()) else 0, "address"))
        numbers = _NUMBER_GATE.search(text)
        for m in _ID.finditer(text) if numbers else ():
            found.append(("id_number", m.start(), m.end(), 1 if re.search(r"[A-Z]", m.group()) or m.group().count(" ") > 4 else 0, "id"))
        for m in _PHONE.finditer(text) if numbers else ():
            digits = sum(c.isdigit() for c in m.group())
            found.append(("phone", m.start(), m.end(), 1 if m.group()[0] in "+(0" and digits >= 9 else 0, "phone"))
    for s, e, form, ev in name_candidates(text, table):
        found.append(("name", s, e, 1 if form in ("full", "reversed", "pair") and ev or form == "han" else 0, form + ("+" if ev > 1 else "-" if ev or form in ("pair", "han") else "")))
    out = []
    for kind, s, e, strict, form in found:
        left, right = text[max(0, s - 40) : s], text[e : e + 30]
        body = text[s:e]
        label = 0
        if _LABELS[kind].search(left):
            label = 1
        elif kind in ("phone", "id_number", "email") and _DECOY.search(left):
            label = strict = -1
        elif form.startswith("pair") and _PLACE_BEFORE.search(left):
            label = strict = -1
        elif kind in ("phone", "id_number") and any(p.search(left) for k, p in _LABELS.items() if k != kind and k != "name"):
            label = -1
        elif kind != "name" and _NEUTRAL.search(left):
            label = 1
        digits = 0 if kind == "name" else sum(c.isdigit() for c in body)
        gaz = 0
        if kind == "name":
            gaz = 1 if form[-1] == "+" else 0 if form[-1] == "-" else -1
        firm = kind == "name" and _ORG_NEXT.match(right) is not None
        if kind == "name" and gaz == 1 and not firm and form.startswith("alone"):
            strict = 1
        after = -1 if firm or kind != "name" and re.match(r"\s*(?:N\b|kg|km)", right) else 0
        if kind == "name" and re.match(r"\s*,\s*\d", right) is None and after == 0 and form.startswith(("titled", "alone")):
            after = 1 if re.match(r"\s+(?:later|answered|wrote|said|paya|pagó|escribió|écrivit|schrieb)\b", right) else 0
        line_start = not left or left.endswith(("\n", "| ", ": ", "/ ", "– ", "; "))
        line_end = not right or right[0] in "\n.;,|/:" or right.startswith((" |", " –", " /", " or "))
        layout = 1 if line_start and line_end else 0
        shape = 0
        if kind == "phone":
            shape = 1 if 9 <= digits <= 18 or re.fullmatch(r"555-\d{4}", body) else -1 if digits < 7 else 0
        elif kind == "id_number":
            shape = 1 if 7 <= digits <= 18 else -1
        elif kind == "email":
            shape = 1 if re.search(r"[A-Za-z]{2,}$", body) else -1
        elif kind == "address":
            shape = 1
        elif kind == "name":
            shape = 1 if form.startswith(("full", "reversed", "initial", "titled", "pair", "han")) or strict == 1 else 0
        votes = (strict, label, gaz, after, layout, shape)
        before, behind = " ".join(left.split()[-2:]).lower(), " ".join(right.split(None, 2)[:2]).lower()
        pattern = form if kind == "name" else re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d", "9", body)))[:24]
        feats = [zlib.crc32(f"{kind}:{x}".encode()) % _HASHED for x in ("f" + form, "l" + before, "r" + behind, "p" + pattern)]
        out.append((kind, s, e, votes, feats))
    return out


class Labelers:
    """Per kind: how each labeler votes on true and false spans, estimated by expectation-maximisation."""

    def fit(self, rows: list[tuple[str, tuple]], rounds: int = 25):
        self.table, self.prior = {}, {}
        for kind in KINDS:
            patterns: dict[tuple, int] = {}
            for k, votes in rows:
                if k == kind:
                    patterns[votes] = patterns.get(votes, 0) + 1
            p = np.array(list(patterns) or [(0,) * LABELERS])
            n = np.array(list(patterns.values()) or [1.0], dtype=float)
            score = p.sum(axis=1)
            post = 1 / (1 + np.exp(-1.5 * (score - 0.5)))
            for _ in range(rounds):
                w1, w0 = n * post, n * (1 - post)
                prior = (w1.sum() + 2) / (n.sum() + 3)
                t = np.zeros((LABELERS, 3, 2))
                for j in range(LABELERS):
                    for v in (-1, 0, 1):
                        at = p[:, j] == v
                        # labelers are taken to be right more often than not: a vote for weighs towards true, a vote
                        # against, which few cast and only for a reason, more so towards false
                        t[j, v + 1, 1] = (w1[at].sum() + (2.0 if v == 1 else 0.2 if v == -1 else 1.0)) / (w1.sum() + 3.2)
                        t[j, v + 1, 0] = (w0[at].sum() + (0.2 * w0.sum() + 2.0 if v == -1 else 1.0)) / (1.2 * w0.sum() + 4)
                log = np.log(prior / (1 - prior)) + sum(np.log(t[j, p[:, j] + 1, 1] / t[j, p[:, j] + 1, 0]) for j in range(LABELERS))
                post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
            self.table[kind], self.prior[kind] = t, prior
        return self

    def posterior(self, kind: str, votes: tuple) -> float:
        t, prior = self.table[kind], self.prior[kind]
        log = np.log(prior / (1 - prior)) + sum(np.log(t[j, votes[j] + 1, 1] / t[j, votes[j] + 1, 0]) for j in range(LABELERS))
        return float(1 / (1 + np.exp(-np.clip(log, -30, 30))))


class SpanClassifier:
    """Logistic regression over kind x vote and hashed context, trained on the labelers' posteriors."""

    def __init__(self):
        self.votes = np.zeros((len(KINDS), LABELERS * 3 + 1), dtype=np.float32)
        self.hashed = np.zeros(_HASHED, dtype=np.float32)
        self.plain = None

    def start_from(self, labelers: Labelers) -> SpanClassifier:
        """Begin at what the labelers' reliabilities alone would decide."""
        for i, kind in enumerate(KINDS):
            t, prior = labelers.table[kind], labelers.prior[kind]
            self.votes[i, : LABELERS * 3] = np.log(t[:, :, 1] / t[:, :, 0]).ravel()
            self.votes[i, -1] = np.log(prior / (1 - prior))
        return self

    def _at(self, votes):
        return [j * 3 + votes[j] + 1 for j in range(LABELERS)] + [LABELERS * 3]

    def score(self, kind: str, votes: tuple, feats: list[int]) -> float:
        return float(self.votes[KINDS.index(kind), self._at(votes)].sum() + 0.5 * self.hashed[feats].sum())

    def freeze(self) -> SpanClassifier:
        """Weights as plain numbers, for scoring span by span."""
        self.plain = (dict(zip(KINDS, self.votes.tolist())), self.hashed.tolist())
        return self

    def quick_score(self, kind: str, votes: tuple, feats: list[int]) -> float:
        if self.plain is None:
            return self.score(kind, votes, feats)
        own, hashed = self.plain[0][kind], self.plain[1]
        total = own[-1]
        for j, v in enumerate(votes):
            total += own[j * 3 + v + 1]
        return total + 0.5 * sum([hashed[f] for f in feats])

    def fit(self, rows, targets, epochs: int = 4, rate: float = 0.1):
        order = np.arange(len(rows))
        rng = np.random.default_rng(3)
        for _ in range(epochs):
            rng.shuffle(order)
            for i in order:
                kind, votes, feats = rows[i]
                err = 1 / (1 + np.exp(-np.clip(self.score(kind, votes, feats), -30, 30))) - targets[i]
                self.votes[KINDS.index(kind), self._at(votes)] -= rate * err
                self.hashed[feats] -= rate * 0.5 * err
        return self


def choose(text: str, table: np.ndarray, model: SpanClassifier) -> list[tuple[str, int, int]]:
    """The spans that the classifier accepts; earlier kinds and longer spans win where they overlap."""
    kept: list[tuple[str, int, int]] = []
    rows = [(KINDS.index(k), -(e - s), s, e, k) for k, s, e, votes, feats in candidates(text, table) if model.quick_score(k, votes, feats) > 0]
    for _, _, s, e, k in sorted(rows):
        if all(e <= a or s >= b for _, a, b in kept):
            kept.append((k, s, e))
    return sorted(kept, key=lambda x: x[1])


def train(documents: DataFrame, sample_rows: int = 3000) -> tuple[np.ndarray, SpanClassifier]:
    table = word_knowledge(documents)
    sample = hash_sample(documents.filter("text is not null").select("doc_id", "text"), ["doc_id"], sample_rows).collect()
    forget_words()
    rows = [(k, votes, feats) for r in sample for k, _, _, votes, feats in candidates(r["text"], table)]
    labelers = Labelers().fit([(k, v) for k, v, _ in rows])
    targets = [labelers.posterior(k, v) for k, v, _ in rows]
    return table, SpanClassifier().start_from(labelers).fit(rows, targets)


_SPANS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())]))),
        T.StructField("redacted", T.StringType()),
    ]
)
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with typed placeholders in place of the spans."""
    out, at = [], 0
    for kind, s, e in spans:
        out += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join([*out, text[at:]])


def find_personal(documents: DataFrame, sample_rows: int = 3000, with_text: bool = True) -> DataFrame:
    """doc_id, spans (kind, start_char, end_char), redacted: one row per document that is not null."""
    table, model = train(documents, sample_rows)
    used = np.flatnonzero(table)
    sent = (used.astype(np.int32), table[used], model.votes, model.hashed, len(table))
    ready: list = []

    def scan(batch):
        if not ready:
            forget_words()
            full, m = np.zeros(sent[4], dtype=np.uint8), SpanClassifier()
            full[sent[0]], m.votes, m.hashed = sent[1], sent[2], sent[3]
            ready.extend((full, m.freeze()))
        out = {"doc_id": [], "spans": [], "redacted": []}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is None:
                continue
            spans = choose(text, *ready)
            out["doc_id"].append(doc)
            out["spans"].append([{"kind": k, "start_char": s, "end_char": e} for k, s, e in spans])
            out["redacted"].append(redact(text, spans) if with_text else None)
        return out

    return map_batches(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _SPANS, scan)


def span_rows(found: DataFrame) -> DataFrame:
    """One row per span: doc_id, kind, start_char, end_char."""
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.start_char", "s.end_char")
