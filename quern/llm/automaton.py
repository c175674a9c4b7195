"""Sentence automaton: a pushdown scan over punctuation events of one text.

The scan visits only characters that can matter (terminators, quotation marks,
brackets, dashes, line breaks, Thai spaces).  A stack holds the open quotations and
brackets; terminators inside them never end a sentence.  A second stack holds the open list
levels (indentation, kind of mark, last number): a line that goes on with an open level, or opens one inside it or after a colon,
begins a new sentence; any other line break doesn't.  Abbreviations are looked up
in suffix tries, read from the dot backwards.  A quotation that isn't closed holds to the end of a text
that is itself cut off, however long; in a text that ends with a mark it is taken for a stray mark.

Offsets count Unicode code points from 0, ends are exclusive.  Sentences carry no outer
white space and together cover every other character of the text.
"""

from __future__ import annotations

import re

# Abbreviations that never end a sentence (a word always follows).
NEVER_FINAL = """
mr mrs ms messrs dr prof st capt sgt lt col gen rev hon maj adm gov sen rep fr mt
vol vols pp fig figs sec ch eq ed eds cf viz vs approx e.g i.e ca vgl bzw sog z.b d.h u.a s.a evtl ggf
mme mlle mm mgr env aprox pág págs núm núms ud uds vd vds sr sra srta sres dra dña
hr frl nr abb bd см стр рис гл ул им проф акад т.е т.н напр р.х
डॉ नं पृ श्री सं कि.मी p.ex c.-à-d p.e v.gr f.e
""".split()

# Abbreviations that may be the last word: a capital, digit or opening mark after them ends the sentence.
MAYBE_FINAL = """
etc usw usf co ltd inc corp bros jr esq a.m p.m inst ult prox kg km cm mm mi lb lbs oz ft yd
г гг в вв т.д т.п др руб коп кг км тыс млн min max dept est ave rd blvd u.s u.k b.c a.d cía s.a.r.l
pta ptas frs fr hrs hr min sec cwt
""".split()

# Abbreviations that number the thing after them: final only when neither digit nor capital follows.
BEFORE_NUMBER = "no nos p s art arts par abs bl taf cap lib pl q".split()

MONTHS = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember".split()
)
REPORTING = re.compile(
    r"\b(?:said|asked|cried|answered|replied|wrote|shouted|whispered|called|added|muttered|told|exclaimed|remarked"
    r"|sagte|fragte|rief|antwortete|schrieb|dit|demanda|cria|répondit|écrivit|ajouta|dijo|preguntó|gritó|respondió|escribió"
    r"|disse|chiese|rispose|gridò|scrisse|disse|perguntou|respondeu|спросил\w*|сказал\w*|крикнул\w*|ответил\w*|писал\w*)\b"
)
# whatever the verb: a name or pronoun, one word in the past tense, and the end of the clause or an adverb
_REPORTS = re.compile(r"(?:(?:(?:Mr|Mrs|Ms|Dr)\.?\s+)?[^\W\d_]+(?:\s[A-Z]\w+)?)\s+(?:[^\W\d_]{3,}(?:ed|te|ten|ó|ò|ait|ait-il)|\w+ла|\w+ил|\w+ал)(?:\s\w+ly)?\s*(?:[.,:;!?…]|$)")
_ARTICLES = frozenset("the a an this that these those his her their my our its der die das ein eine le la les un une el los las una il lo gli i".split())
_ITEM = re.compile(r"([ \t]*)(?:(\d{1,3})[.)]|([a-z])\)|([-*•‣]))[ \t]+(?=\S)")


def build_trie(words) -> dict:
    """Suffix trie: characters of each word from its end to its start; the key '' marks a word."""
    root: dict = {}
    for word in words:
        node = root
        for ch in reversed(word):
            node = node.setdefault(ch, {})
        node[""] = True
    return root


_NEVER, _MAYBE, _NUMBER = build_trie(NEVER_FINAL), build_trie(MAYBE_FINAL), build_trie(BEFORE_NUMBER)

_CLOSER = {
    "“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉",
    "（": "）", "(": ")", "[": "]", "{": "}", "【": "】", "‘": "’", '"': '"',
}
_BRACKETS = frozenset("([{（【《〈")
_CLOSING = frozenset("”»›」』》〉）)]}】’")
_TERMINATORS = ".!?…。！？｡।॥"
_WIDE = frozenset("。！？｡।॥")
_EVENT = re.compile(r"[\n\u2029.!?…。！？｡।॥“”„«»‹›「」『』《》〈〉（）()\[\]{}【】‘’\"—]")
_EVENT_THAI = re.compile(_EVENT.pattern + r"|(?<=[\u0e00-\u0e7f]) +(?=[\u0e00-\u0e7f])")
_THAI = re.compile("[\u0e00-\u0e7f]")
_RUN = re.compile(r"[.!?…。！？｡।॥]+")
_BLANK_RUN = re.compile(r"\n[^\S\n]*\n\s*|\u2029\s*")
_DASH_BACK = re.compile(r"\s—\s*(?=[^\W\d_])")
_CLAUSE_END = re.compile(r"[.!?…“«„\n]")
_SHORT_WORD = re.compile(r"\b\w{1,4}$")
_BLANK = re.compile(r"\n[^\S\n]*\n|\u2029")
_SPACE_RUN = re.compile(r"\s*")
_NUMBER_TOKEN = re.compile(r"\d+(?:[.,:]\d+)*$")
_WORD = re.compile(r"\w+")


def _caseless(ch: str) -> bool:
    """Letters of scripts without case (Indic, Thai, CJK and so on)."""
    return ch.isalpha() and not ch.isupper() and not ch.islower()


def _in_trie(trie: dict, text: str, dot: int, floor: int) -> bool:
    """Does a trie word end just before the dot, starting at a word boundary?  Blanks inside (z. B.) are skipped."""
    node, i = trie, dot - 1
    while i >= floor:
        ch = text[i].lower()
        if ch in node:
            node = node[ch]
            if "" in node and (i == floor or not (text[i - 1].isalnum() or text[i - 1] in "._@&-")):
                return True
            i -= 1
        elif ch.isspace() and "." in node:
            i -= 1
        else:
            return False
    return False


def _words_between(text: str, start: int, end: int, enough: int) -> bool:
    n = 0
    for _ in _WORD.finditer(text, start, end):
        n += 1
        if n >= enough:
            return True
    return False


def _dot_ends(text: str, i: int, end: int, start: int, size: int) -> bool:
    """Does the single full stop at i (the run ends at end) finish the sentence that began at start?"""
    nxt = text[end] if end < size else ""
    if not nxt:
        return True
    before = text[i - 1] if i else " "
    if not nxt.isspace():
        if nxt.isalpha():
            if not (nxt.isupper() or _caseless(nxt)) or not before.isalpha():
                return False
            j = i
            while j > start and (text[j - 1].isalnum() or text[j - 1] in "._@-/"):
                j -= 1
            token = text[j:i]
            if _caseless(nxt) and not before.islower():
                return False
            return len(token) >= 3 and token.isalpha() and (before.islower() or _caseless(before))
        return nxt in "“„«「『‘(（" and before.isalnum()
    k = _SPACE_RUN.match(text, end).end()
    nxt = text[k] if k < size else ""
    if not nxt:
        return True
    if nxt in ",;:":
        return False
    lower = nxt.islower()
    j = i
    while j > start and not text[j - 1].isspace():
        j -= 1
    token = text[j:i].lstrip("“„«‘(\"'[—¿¡")
    if not token:
        return False
    if _NUMBER_TOKEN.match(token):
        if j <= _SPACE_RUN.match(text, start).end() and len(token) <= 3 and token.isdigit():
            return False  # a list number opens the sentence
        if token.isdigit() and len(token) <= 2:
            word = _WORD.match(text, k)
            if word and word.group().lower() in MONTHS:
                return False
            if lower:
                p = j
                while p > start and text[p - 1].isspace():
                    p -= 1
                return p > start and text[p - 1] == "."
        return True
    if token[-1].isupper() and len(token) > 1 and _caseless(token[-2]):
        return False  # an initial straight after a script without spaces
    if len(token) == 1 and token.isalpha():
        if token.isupper():
            return False  # an initial, or z. B.
        if _in_trie(_MAYBE, text, i, start):
            if lower or nxt.isdigit():
                return False
            return not (token == "г") or _words_between(text, start, i, 4)
        if lower or nxt.isdigit() or text[k + 1 : k + 2] == ".":
            return False
        return not (_in_trie(_NEVER, text, i, start) or _in_trie(_NUMBER, text, i, start))
    if _in_trie(_NEVER, text, i, start):
        return False
    if _in_trie(_NUMBER, text, i, start):
        return not (nxt.isdigit() or nxt.isupper())
    if _in_trie(_MAYBE, text, i, start):
        if lower:
            return False
        if token[-2:] == ".m" or token in ("г", "гг", "inst"):
            return _words_between(text, start, i, 5)
        return True
    if _caseless(before) and _caseless(nxt) and before > "๿":
        return True
    return True


def cut_points(text: str) -> list[int]:
    """Positions after which a new sentence begins, in order; the end of the text is not among them."""
    cuts: list[int] = []
    stack: list[tuple[str, int, bool]] = []  # closing marks, position of the opening mark, opens the sentence
    size = len(text)
    start = 0  # where the current sentence began, white space included
    skip = 0
    para_end = -1

    levels: list[tuple[int, str, int]] = []  # of lists: indentation, kind of mark, number of the last item
    cut_off: bool | None = None

    def item(at: int) -> bool:
        """Does the line at this place go on with an open list level or open one inside it?  Keeps the stack of levels."""
        m = _ITEM.match(text, at)
        if not m:
            return False
        indent = len(m.group(1))
        kind, number = ("9", int(m.group(2))) if m.group(2) else ("a", ord(m.group(3)) - 96) if m.group(3) else (m.group(4), 0)
        if kind == "9":
            word = _WORD.match(text, m.end())
            if word and word.group().lower() in MONTHS:
                return False
        while levels and levels[-1][0] > indent:
            levels.pop()
        if levels and levels[-1][:2] == (indent, kind) and number == levels[-1][2] + (kind.isalnum()):
            levels[-1] = (indent, kind, number)
            return True
        if number > 1:
            return False
        inside = bool(levels) and levels[-1][0] < indent
        if levels and levels[-1][0] == indent:
            levels.pop()
        levels.append((indent, kind, number))
        return inside or text[:at].rstrip()[-1:] in (":", "：") if at else False

    def paragraph_end(i: int) -> int:
        nonlocal para_end
        if para_end < i:
            m = _BLANK.search(text, i)
            para_end = m.start() if m else size
        return para_end

    item(0)
    for m in (_EVENT_THAI if _THAI.search(text) else _EVENT).finditer(text):
        i = m.start()
        if i < skip:
            continue
        ch = text[i]
        if ch == "\n" or ch == "\u2029":
            blank = _BLANK_RUN.match(text, i)
            if blank:
                stack.clear()
                start = skip = blank.end()
                cuts.append(i)
                item(blank.end())
            elif item(i + 1) and not stack:
                cuts.append(i)
                start = i + 1
            continue
        if ch == " ":
            if not stack:
                cuts.append(i)
                start = m.end()
            continue
        if ch == "—":
            if stack:
                if stack[-1][0] == "—":
                    k = _SPACE_RUN.match(text, i + 1).end()
                    if k < size and text[k].islower() and i and text[i - 1].isspace():
                        stack.pop()
                continue
            if not text[start:i].strip() and i + 1 < size:
                stop = paragraph_end(i)
                found = _DASH_BACK.search(text, i + 1, stop)
                while found and not text[found.end()].islower():
                    found = _DASH_BACK.search(text, found.end(), stop)
                if found:
                    stack.append(("—", i, True))
            continue
        if ch in _TERMINATORS:
            if stack:
                continue
            run = _RUN.match(text, i).group()
            end = skip = i + len(run)
            if len(run) == 1 and ch == ".":
                ends = _dot_ends(text, i, end, start, size)
            elif run[-1] in _WIDE or run[0] in _WIDE:
                ends = True
            elif "!" in run or "?" in run:
                k = _SPACE_RUN.match(text, end).end()
                nxt = text[k] if k < size else ""
                ends = nxt not in tuple(",;:") if nxt else True
                if nxt and k == end and (nxt.islower() or nxt.isdigit()):
                    ends = False
                if nxt in ("—", "–") and text[k + 1 : k + 3].strip()[:1].islower():
                    ends = False
            else:  # dots of hesitation
                k = _SPACE_RUN.match(text, end).end()
                nxt = text[k] if k < size else ""
                prev = text[i - 1] if i else " "
                ends = not nxt or (nxt.isupper() and not _caseless(prev) and text[k : k + 2] != "I ") or nxt in "“„«"
            if ends:
                while end < size and text[end] in _CLOSING:
                    end += 1
                cuts.append(end)
                start = end
                skip = end
            continue
        # quotation marks and brackets
        if stack and ch in stack[-1][0]:
            if ch == "’" and i + 1 < size and text[i + 1].isalpha():
                continue  # an apostrophe
            _, opened, initial = stack.pop()
            if stack or text[opened] in _BRACKETS and not initial:
                continue
            j = i - 1
            while j > opened and text[j].isspace():
                j -= 1
            if text[j] not in _TERMINATORS:
                continue
            end = i + 1
            k = _SPACE_RUN.match(text, end).end()
            nxt = text[k] if k < size else ""
            if not nxt or nxt in ",;:.!?…。！？，、；—–-)）":
                continue
            inner_caseless = any(_caseless(c) for c in text[opened + 1 : min(opened + 12, i)])
            if text[opened] in _BRACKETS:
                ends = not nxt.islower()
            elif initial:
                if nxt in _CLOSER:
                    ends = True
                elif inner_caseless:
                    ends = not nxt.isalnum()
                elif nxt.islower():
                    ends = False
                elif k == end and nxt.isalpha():
                    ends = True
                else:
                    # the clause after it: up to its mark, passing over the dot of a short word
                    stop = _CLAUSE_END.search(text, k)
                    while stop and stop.group() == "." and _SHORT_WORD.search(text, k, stop.start()):
                        stop = _CLAUSE_END.search(text, stop.end())
                    stop = stop.start() if stop else size
                    report = _REPORTS.match(text, k)
                    first = _WORD.match(text, k)
                    ends = not REPORTING.search(text, k, stop) and not (report and first and first.group().lower() not in _ARTICLES)
            else:
                p = opened - 1
                while p > start and text[p].isspace():
                    p -= 1
                if inner_caseless:
                    ends = text[p] in "：:" or nxt in _CLOSER
                else:
                    ends = not nxt.islower()
            if ends:
                cuts.append(end)
                start = end
                skip = end
            continue
        if ch in _CLOSER:
            if ch in "‘\"" and i and text[i - 1].isalnum():
                continue
            closers = _CLOSER[ch]
            stop = paragraph_end(i)
            closed = any(text.find(c, i + 1, stop) >= 0 for c in closers)
            if not closed:
                if cut_off is None:
                    tail = text.rstrip()
                    cut_off = bool(tail) and tail[-1] not in _TERMINATORS and tail[-1] not in _CLOSING
                if not (cut_off and stop == size and ch not in "‘\"(["):
                    continue
            stack.append((closers, i, not text[start:i].strip(" \t\n\r¿¡")))
    return cuts


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Offsets of the sentences of a text; none for a null, empty or blank text."""
    if not text:
        return []
    spans, begin = [], 0
    for end in [*cut_points(text), len(text)]:
        piece = text[begin:end]
        left = begin + len(piece) - len(piece.lstrip())
        right = begin + len(piece.rstrip())
        if right > left:
            spans.append((left, right))
        begin = end
    return spans
