"""Held-out passages inside a corpus: q-gram counting in diagonal bands, then banded alignment.

A document and an item are reduced to their words (runs of letters or digits, caseless, parted
by one space).  Every character q-gram that both hold is a hit on the diagonal
`document position - item position`.  By the q-gram lemma a passage of w characters with at most e
edits shares at least w + 1 - q * (e + 1) q-grams inside a band of 2e + 1 diagonals; bands overlap by
half, and those with fewer hits are dropped.  A surviving region is verified by an alignment
inside its band, and the longest exact run in it is measured in whole words (letters, for
scripts without spaces).

The items are a stated query set: they go to every task as one sorted array of hashes, in blocks
of a fixed number of characters, so that what is sent stays bounded however many items there
are.  The corpus is scanned once per block and never shuffled.

Cases: null and empty documents or items match nothing; equal documents are reported each under
its own id, equal items each under its own id; a document of any length is scanned whole; other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import map_batches

_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑­][^\S\n]*\n\s*(?=[^\W\d_])")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def plain_words(text: str, join_broken: bool = True) -> list[str]:
    """The caseless words of a text; a word broken by a hyphen at a line end counts as whole."""
    if join_broken:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.replace("­", ""))
    return _WORD.findall(text.casefold())


def gram_hashes(text: str, q: int) -> np.ndarray:
    """A 64-bit hash of every run of q characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    whole, size, at = None, 1, 0
    part = codes * _MULTIPLIER
    power = _MULTIPLIER
    with np.errstate(over="ignore"):
        left = q
        while left:
            if left & 1:
                piece = part[at : at + n]
                whole = piece.copy() if whole is None else whole * _power(size) + piece
                at += size
            left >>= 1
            if left:
                part = part[: len(part) - size] * _power(size) + part[size:]
                size *= 2
        whole ^= whole >> np.uint64(29)
        whole *= power
    return whole


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64))


def banded_edits(a: str, b: str, most: int) -> int:
    """Edits that turn a into b while the path stays within `most` of the main diagonal; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev = {j: j for j in range(min(len(b), most) + 1)}
    for i, ca in enumerate(a, 1):
        cur = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = most + 1
            if j in prev:
                best = prev[j] + 1
            if j and j - 1 in prev:
                best = min(best, prev[j - 1] + (ca != b[j - 1]))
            if j and j - 1 in cur:
                best = min(best, cur[j - 1] + 1)
            cur[j] = best
        if min(cur.values()) > most:
            return most + 1
        prev = cur
    return min(prev.get(len(b), most + 1), most + 1)


class ItemIndex:
    """The q-grams of a block of items, sorted by hash, with a bit table in front of them."""

    def __init__(self, items: list[tuple[int, str]], spaced: bool, q: int, units: int):
        self.q, self.spaced = q, spaced
        self.ids = [i for i, _ in items]
        self.texts = [self.shape(plain_words(t)) for _, t in items]
        hashes = [gram_hashes(t, q) for t in self.texts]
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        self.item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        self.pos = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, dtype=np.int64)
        self.window = np.array([self.shortest(t, units) for t in self.texts], dtype=np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.pos = self.hash[order], self.item[order], self.pos[order]
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def shape(self, words: list[str]) -> str:
        return f" {' '.join(words)} " if self.spaced else "".join(words)

    def shortest(self, text: str, units: int) -> int:
        """Characters of the shortest passage of so many words (letters) of an item, outer blanks included."""
        if not self.spaced:
            return units
        blanks = np.array([m.start() for m in re.finditer(" ", text)], dtype=np.int64)
        return int((blanks[units:] - blanks[:-units]).min()) + 1 if len(blanks) > units else len(text) + 1

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item number, item position and text position of every shared q-gram."""
        h = gram_hashes(text, self.q)
        at = np.nonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])[0]
        lo = np.searchsorted(self.hash, h[at], "left")
        n = np.searchsorted(self.hash, h[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.item[entry], self.pos[entry], np.repeat(at, n)

    def regions(self, text: str, edits: int):
        """(item number, exact run in words or letters, edits beside it, region start, end) of each item that passes the bound."""
        item, ipos, dpos = self.hits(text)
        if not len(item):
            return
        bound = np.maximum(1, self.window + 1 - self.q * (edits + 1))
        enough = np.bincount(item, minlength=len(bound)) >= bound
        keep = enough[item]
        if not keep.any():
            return
        item, ipos, dpos = item[keep], ipos[keep], dpos[keep]
        diag = dpos - ipos
        order = np.lexsort((dpos, diag, item))
        item, ipos, dpos, diag = item[order], ipos[order], dpos[order], diag[order]
        width = 2 * edits + 1
        best: dict[int, tuple] = {}
        for shift in (0, width):  # two sets of bands, each twice as wide as needed, overlapping by half
            band = (diag + shift) // (2 * width)
            cuts = np.flatnonzero((item[1:] != item[:-1]) | (band[1:] != band[:-1])) + 1
            a = np.concatenate(([0], cuts))
            b = np.concatenate((cuts, [len(item)]))
            passed = b - a >= bound[item[a]]
            for s, e in zip(a[passed].tolist(), b[passed].tolist()):
                number = int(item[s])
                found = self._verify(text, number, ipos[s:e], dpos[s:e], edits)
                if found and (number not in best or found[0] > best[number][0]):
                    best[number] = found
        for number, found in best.items():
            yield number, *found

    def _verify(self, text, number, ipos, dpos, edits):
        """Longest exact run of the region, and the edits of its alignment with the item."""
        diag = dpos - ipos
        cuts = np.flatnonzero((diag[1:] != diag[:-1]) | (dpos[1:] != dpos[:-1] + 1)) + 1
        breaks = np.concatenate(([0], cuts))
        ends = np.concatenate((cuts, [len(dpos)])) - 1
        longest, where = 0, None
        for a, b in zip(breaks, ends):
            run = text[dpos[a] : dpos[b] + self.q]
            units = len(run)
            if self.spaced:
                first, last = run.find(" "), run.rfind(" ")
                units = run[first : last].count(" ") if last > first else 0
            if units > longest:
                longest, where = units, (int(a), int(b))
        if where is None:
            return None
        a, b = where
        d0, d1 = int(dpos[a]), int(dpos[b]) + self.q
        i0, i1 = int(ipos[a]), int(ipos[b]) + self.q
        grow = 40
        left = min(grow, d0, i0)
        right = min(grow, len(text) - d1, len(self.texts[number]) - i1)
        cost = banded_edits(self.texts[number][i0 - left : i0], text[d0 - left : d0], edits)
        cost = min(cost, edits + 1) + banded_edits(self.texts[number][i1 : i1 + right], text[d1 : d1 + right], edits)
        return longest, cost, d0, d1


_LEAKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("run_units", T.IntegerType()),
        T.StructField("edits", T.IntegerType()),
        T.StructField("exact", T.BooleanType()),
    ]
)
UNSPACED = ("zh", "ja", "th")


def item_blocks(items: DataFrame, block_chars: int) -> list[list[tuple[int, str, str]]]:
    """The items, the stated query set, in blocks of about block_chars characters."""
    blocks, room = [[]], block_chars
    for row in items.select("item_id", "lang", "text").orderBy("item_id").toLocalIterator():
        if not row["text"]:
            continue
        if len(row["text"]) > room and blocks[-1]:
            blocks.append([])
            room = block_chars
        blocks[-1].append((row["item_id"], row["lang"] or "", row["text"]))
        room -= len(row["text"])
    return [b for b in blocks if b]


def find_leaks(
    documents: DataFrame, items: DataFrame, min_words: int = 10, min_letters: int = 18, edits: int = 1, q: int = 8, block_chars: int = 4_000_000
) -> DataFrame:
    """doc_id, item_id, run_units, edits, exact: every item that a document holds in part or whole.

    exact is true where the document holds min_words consecutive words of the item (min_letters
    letters or digits for items in scripts without spaces); the other rows are regions that met the
    edit budget's bound without such a run.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = []
    for block in item_blocks(items, block_chars):
        spaced = [(i, t) for i, lang, t in block if lang not in UNSPACED]
        compact = [(i, t) for i, lang, t in block if lang in UNSPACED]
        jobs = [(spaced, True, q, min_words), (compact, False, min(q, 6), min_letters)]
        parts.append(map_batches(rows, _LEAKS, _scanner([j for j in jobs if j[0]], edits)))
    if not parts:
        return documents.sparkSession.createDataFrame([], _LEAKS)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _scanner(jobs, edits):
    ready: list = []

    def scan(batch):
        if not ready:
            ready.extend((ItemIndex(items, spaced, q, least), least) for items, spaced, q, least in jobs)
        out: dict[str, list] = {f.name: [] for f in _LEAKS}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            versions = [plain_words(text)]
            if _BROKEN.search(text):
                versions.append(plain_words(text, join_broken=False))
            found: dict[int, tuple] = {}
            for index, least in ready:
                for words in versions:
                    for number, run, cost, _, _ in index.regions(index.shape(words), edits):
                        key = index.ids[number]
                        if run < least and cost > edits:
                            continue
                        if key not in found or run > found[key][0]:
                            found[key] = (run, cost, run >= least)
            for item, (run, cost, exact) in found.items():
                for name, value in zip(out, (doc, item, run, cost, exact)):
                    out[name].append(value)
        return out if out["doc_id"] else None

    return scan
