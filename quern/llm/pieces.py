"""Cutting oversized texts into overlapping pieces at natural boundaries.

The least number of pieces gives equal-length targets; each cut snaps to the strongest
boundary (blank line, sentence end, white space) within reach of its target, or, where its reach
holds none of a kind, of those since the last cut before a weaker kind is taken, and the number of pieces grows until every piece keeps the limit.  A piece begins with the last
sentence of the piece before it, or its last 200 characters if that sentence is longer.

Cases: null, empty and short texts yield no pieces; a text without any white space is cut
hard, never inside a letter and its combining marks; repeated rows are cut alike; extra
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import map_batches
from quern.llm.automaton import sentence_spans

_BLANK = re.compile(r"\n[^\S\n]*\n\s*|\u2029\s*")
_SPACE = re.compile(r"\s+")
_PARAGRAPH, _SENTENCE, _WORD, _NONE = "paragraph", "sentence", "word", "none"


def _longest(text: str, pattern: re.Pattern) -> int:
    return max((len(part.strip()) for part in pattern.split(text)), default=0)


def boundary_class(text: str, limit: int, spans: list[tuple[int, int]]) -> str:
    """The strongest kind of boundary at which alone the text can be cut under the limit."""
    if _longest(text, _BLANK) <= limit:
        return _PARAGRAPH
    if max((b - a for a, b in spans), default=0) <= limit:
        return _SENTENCE
    if _longest(text, _SPACE) <= limit:
        return _WORD
    return _NONE


def _overlap_start(starts: list[int], begin: int, end: int, overlap: int) -> int:
    """Where the piece after one that covers [begin, end) starts."""
    i = bisect_left(starts, end) - 1
    last = max(starts[i] if i >= 0 else begin, begin)
    return max(last, end - overlap)


def cut_pieces(text: str | None, limit: int = 2048, overlap: int = 200) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The boundary class, and (start, end, kind of the cut at the end) of every piece; nothing for texts within the limit."""
    if text is None or len(text) <= limit:
        return None, []
    size = len(text)
    spans = sentence_spans(text)
    starts = [a for a, _ in spans]
    levels = [
        (_PARAGRAPH, [m.start() for m in _BLANK.finditer(text) if 0 < m.start() < size]),
        (_SENTENCE, [b for _, b in spans if b < size]),
        (_WORD, [m.start() for m in _SPACE.finditer(text) if 0 < m.start() < size]),
    ]
    count = -(-size // limit)
    while True:
        pieces = _try_count(text, size, count, limit, overlap, starts, levels)
        if pieces is not None:
            return boundary_class(text, limit, spans), pieces
        count += 1


def _try_count(text, size, count, limit, overlap, starts, levels):
    pieces, begin, done = [], 0, 0
    for n in range(1, count + 1):
        if size - begin <= limit:
            pieces.append((begin, size, "end"))
            return pieces
        target = max(done + 1, size * n // count)
        high = min(begin + limit, size - 1)
        low = min(done + max(1, (min(target, high) - done) // 3), high)
        cut, kind = min(target, high), _NONE
        for name, positions in levels:
            # near the target, else anywhere after the last cut, before a weaker boundary is taken
            a, b = bisect_left(positions, low), bisect_right(positions, high)
            if a == b:
                a = bisect_right(positions, done)
                while a < b and not text[done : positions[a]].strip():
                    a += 1
            if a < b:
                k = min(range(a, b), key=lambda j: abs(positions[j] - target))
                cut, kind = positions[k], name
                break
        else:
            while cut > done + 1 and unicodedata.combining(text[cut]):
                cut -= 1
        pieces.append((begin, cut, kind))
        done, begin = cut, _overlap_start(starts, begin, cut, overlap)
    return None


_PIECES = T.StructType(
    [
        T.StructField("chunk_id", T.LongType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start_char", T.LongType()),
        T.StructField("end_char", T.LongType()),
        T.StructField("cut", T.StringType()),
        T.StructField("boundary", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def split_oversized(chunks: DataFrame, limit: int = 2048, overlap: int = 200) -> DataFrame:
    """The pieces of every chunk above the limit, numbered from 0 within the chunk, in its source and place."""

    def cut(batch):
        out: dict[str, list] = {f.name: [] for f in _PIECES}
        for chunk, source, ordinal, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            boundary, pieces = cut_pieces(text, limit, overlap)
            for n, (a, b, kind) in enumerate(pieces):
                for name, value in zip(out, (chunk, source, ordinal, n, a, b, kind, boundary, text[a:b])):
                    out[name].append(value)
        return out if out["piece"] else None

    rows = chunks.filter(F.length("text") > limit).select(
        F.col("id").cast("long"), F.col("source_id").cast("long"), F.col("ordinal").cast("int"), F.col("text")
    )
    return map_batches(rows, _PIECES, cut)


def piece_boundaries(pieces: DataFrame) -> DataFrame:
    """One row per cut chunk: chunk_id and the boundary class found while cutting it."""
    return pieces.filter("piece = 0").select("chunk_id", "boundary")
