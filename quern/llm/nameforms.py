"""Reading one written name: its type, the part that may vary by slips of the keyboard, and the part that must agree."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Short and pet forms of given names.
PET_FORMS = """
abigail:abby,abbie,gail alexander:alec,alex,sandy,al,xander barnabas:barney,barnaby benjamin:ben,benny catherine:cathy,kitty
cecily:cis,cissy charles:charlie,chuck charlotte:lottie,charlie,lotte christopher:chris,kit daniel:dan,danny david:dave,davy
dorothea:dot,dottie,dolly,thea,dora edward:ed,eddie,ned,ted,teddy elizabeth:beth,liz,lizzie,betty,eliza,bess,betsy,libby
frances:fran,fanny frederick:fred,freddie,freddy george:georgie gwendolyn:gwen,gwennie,wendy henrietta:hetty,etta,hettie
henry:harry,hal humphrey:humph,hump ignatius:iggy,nace isadora:izzy,issy,dora,isa james:jim,jimmy,jamie jeremiah:jerry,jem
john:jack,johnny jonathan:jon joseph:joe,joey josephine:josie,jo,josey katherine:kate,kathy,katie,kit,kitty leonard:len,lenny,leo
lucinda:lucy,cindy,lucie margaret:meg,peggy,maggie,madge,daisy,greta,rita michael:mick,mike,mickey nathaniel:nat,nate,nathan
nicholas:nick octavia:tavy,tavia,tavie oliver:ollie,noll patricia:pat,patsy penelope:penny,nell peter:pete philippa:pippa,pip
quentin:quent,quin rebecca:becky richard:dick,rick,rich,richie,ricky robert:bob,rob,bobby,robbie,bert samuel:sam
susannah:sue,susie,sukey,susan,suzy theodore:ted,theo,teddy,dory thomas:tom,tommy tobias:toby ulrica:ully,rica
valentine:val,vally victoria:vicky,vicki,tory wilhelmina:mina,minnie,willa,billie william:bill,will,billy,willie
xenia:xeny,xena yolanda:yola,yoli,yo zachary:zach,zack,zak
"""
TITLES = frozenset(
    "mr mrs ms miss dr prof professor sir lady lord dame capt captain sgt sergeant rev reverend col colonel maj major lt gen hon mme mlle esq jr sr st the".split()
)
BUSINESS = {
    "railway": "rly rlwy ry railways", "works": "wks", "printing": "print prtg printers", "house": "hse ho", "society": "soc socy",
    "assurance": "assur assce ass", "trust": "tr tst", "archive": "arch archives", "brothers": "bros bro", "sons": "son",
    "shipping": "shipg shpg ship", "mills": "mill mls", "bank": "bk", "institute": "inst", "library": "lib", "university": "univ",
    "association": "assoc assn", "department": "dept", "insurance": "ins", "foundry": "fdry", "brewery": "brew",
}
DETERMINERS = frozenset("the our my his her their your a an this that old".split())
# Legal forms, and words that join the others.
JOINING = "and the of & de del della di du des der die das für for la le el los y et und".split()
LEGAL = frozenset([*"ltd limited co company inc incorporated plc llc llp corp corporation gmbh ag aktiengesellschaft gesellschaft mbh kg ohg sarl srl spa bv nv oy pty pte messrs messers est".split(), *JOINING])
FEATURES = {
    "common": "comm cmn", "bridge": "brg br bdg", "junction": "jct junc jn", "harbour": "hbr harbor harb", "lock": "lk", "abbey": "abb aby",
    "station": "stn sta", "mill": "ml", "wood": "wd", "hill": "hl", "park": "pk", "cross": "x crs", "green": "grn", "quay": "qy",
}
ADDED = {
    "great": "gt grt", "little": "lt lit ltl", "lower": "lr low lwr", "upper": "up upr u", "old": "o", "new": "n nw", "north": "n nth no",
    "south": "s sth so", "east": "e", "west": "w", "saint": "st",
}
_PET: dict[str, set[str]] = {}
for _entry in PET_FORMS.split():
    _full, _, _short = _entry.partition(":")
    _PET.setdefault(_full, set()).add(_full)
    for _s in _short.split(","):
        _PET.setdefault(_s, set()).add(_full)
GIVEN = frozenset(e.partition(":")[0] for e in PET_FORMS.split())
_BUS = {v: k for k, vs in BUSINESS.items() for v in [k, *vs.split()]}
_FEAT = {v: k for k, vs in FEATURES.items() for v in [k, *vs.split()]}
_ADDED_FULL = frozenset(ADDED)
_ADDED: dict[str, str] = {}
for _k, _vs in ADDED.items():
    for _v in [_k, *_vs.split()]:
        _ADDED.setdefault(_v, _k)
_LETTERS = re.compile(r"[^\W\d_]+|&|\d+")


def slips(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance (a swap of neighbours counts one), or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            x = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                x = min(x, before[j - 2] + 1)
            cur.append(x)
        if min(cur) > most:
            return most + 1
        before, prev = prev, cur
    return prev[-1]


def fold(name: str) -> str:
    """Lower case without accents; hyphens inside words and possessive endings are dropped."""
    text = unicodedata.normalize("NFKD", name)
    text = "".join(c for c in text if not unicodedata.combining(c)).lower().replace("ß", "ss")
    text = re.sub(r"(?<=\w)['’]s\b", "", text)
    return re.sub(r"(?<=\w)[-‐‑](?=\w)|['’]", "", text)


def _residues(word: str) -> set[str]:
    """The word, and what it leaves without one of its letters: two words one slip apart share one."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


@lru_cache(maxsize=16)
def _by_residue(vocabulary: frozenset) -> dict[str, set[str]]:
    found: dict[str, set[str]] = {}
    for v in vocabulary:
        for r in _residues(v) if len(v) >= 4 else ():
            found.setdefault(r, set()).add(v)
    return found


@lru_cache(maxsize=1 << 16)
def _near(word: str, vocabulary: frozenset) -> str | None:
    if word in vocabulary:
        return word
    if len(word) < 4:
        return None
    by = _by_residue(vocabulary)
    best = [v for v in set().union(*(by.get(r, ()) for r in _residues(word))) if slips(word, v, 1) <= 1]
    return best[0] if len(best) == 1 else None


_BUS_LONG = frozenset(w for w in _BUS if len(w) >= 5)
_FEAT_LONG = frozenset(w for w in _FEAT if len(w) >= 4)


def _given_options(word: str) -> set[str] | None:
    if word in _PET:
        return _PET[word]
    near = _near(word, GIVEN)
    return {near} if near else None


def is_role(name: str) -> bool:
    """A description (our landlady), or a single word, which many may share."""
    words = _LETTERS.findall(fold(name))
    return len(words) < 2 or len(words) == 2 and words[0] in DETERMINERS


def read_name(name: str | None, kind: str | None) -> tuple[str, str, list[str], str] | None:
    """(type, fixed part, given names it may stand for, part open to slips); None when nothing can be matched."""
    if not name or not name.strip():
        return None
    kind = (kind or "unknown").strip().lower()
    text = fold(name)
    words = _LETTERS.findall(text)
    if not words:
        return None
    comma = re.match(r"\s*([^,]+),\s*(\S.*)$", text)
    business, rest = [], []
    for i, w in enumerate(words):
        b = _BUS.get(w) if i or len(words) > 1 else None
        if b is None and i and len(w) >= 5:
            near = _near(w, _BUS_LONG)
            b = _BUS[near] if near else None
        if b and (i or w in ("the",)):
            business.append(b)
        elif w not in LEGAL:
            rest.append(w)
    legal = any(w in ("&", "ltd", "limited", "co", "company", "messrs", "inc", "plc") for w in words)
    if kind not in ("person", "place") and (business or legal) or kind == "org":
        if not rest:
            return None
        return "org", " ".join(sorted(set(business))), [], " ".join(rest)
    feature = _FEAT.get(words[-1]) if len(words) > 1 else None
    if feature is None and len(words) > 1 and len(words[-1]) >= 4:
        near = _near(words[-1], _FEAT_LONG)
        feature = _FEAT[near] if near else None
    first_full = words[0] in _ADDED_FULL and len(words) > 1
    if kind == "place" or (kind != "person" and (feature or first_full)):
        added = _ADDED.get(words[0]) if len(words) > 1 else None
        if added is None and len(words) > 1 and len(words[0]) >= 4:
            added = _near(words[0], _ADDED_FULL)
        core = words[bool(added) : len(words) - bool(feature)]
        if not core:
            return None
        return "place", f"{added or ''}|{feature or ''}", [], " ".join(core)
    parts = [w for w in words if w not in TITLES and w != "&"] or words
    if len(parts) == 1:
        return ("place", "|", [], parts[0]) if kind == "unknown" and not comma and len(words) == 1 else None
    if comma:
        last = [w for w in _LETTERS.findall(comma.group(1)) if w not in TITLES]
        given = [w for w in _LETTERS.findall(comma.group(2)) if w not in TITLES]
        if not last or not given:
            return None
        surname, first = " ".join(last), given[0]
    else:
        known = [i for i, w in enumerate(parts) if len(w) > 1 and _given_options(w)]
        if known and known[0] == 0 or not known and len(parts[0]) == 1:
            first, others = parts[0], parts[1:]
        elif known:
            first, others = parts[known[0]], parts[: known[0]] + parts[known[0] + 1 :]
        else:
            singles = [w for w in parts if len(w) == 1]
            if singles and len(parts[0]) > 1 and len(parts) == 2:
                first, others = singles[0], [parts[0]]
            else:
                first, others = parts[0], parts[1:]
        long = [w for w in others if len(w) > 1]
        if not long:
            return None
        surname = " ".join(long)
    options = sorted(_given_options(first) or ({first} if len(first) > 1 else set()))
    if len(options) == 1:
        return "person", options[0], options, surname
    return "person", "", options or [first + "*"], surname
