"""Levenshtein distances of many string pairs at once, by one dynamic program over numpy rows."""

from __future__ import annotations

import numpy as np


def encode(names: list[str], width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Code point matrix (padded with 0) and lengths."""
    lengths = np.fromiter((len(n) for n in names), dtype=np.int16, count=len(names))
    width = width or int(lengths.max(initial=1)) or 1
    codes = np.zeros((len(names), width), dtype=np.uint32)
    for i, n in enumerate(names):
        if n:
            codes[i, : len(n)] = np.frombuffer(n.encode("utf-32-le"), dtype=np.uint32)
    return codes, lengths


def levenshtein_pairs(ca: np.ndarray, la: np.ndarray, cb: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Exact distances between row i of a and row i of b."""
    n = len(la)
    if n == 0:
        return np.zeros(0, dtype=np.int16)
    wa, wb = int(la.max()), int(lb.max())
    prev = np.broadcast_to(np.arange(wb + 1, dtype=np.int16)[:, None], (wb + 1, n)).copy()
    out = np.where(la == 0, lb, 0).astype(np.int16)
    at = np.arange(n)
    at_b = lb.astype(np.int64)
    tb = np.ascontiguousarray(cb[:, :wb].T)
    for i in range(1, wa + 1):
        cur = np.empty_like(prev)
        cur[0] = i
        col = ca[:, i - 1]
        for j in range(1, wb + 1):
            best = np.minimum(prev[j], cur[j - 1]) + 1
            np.minimum(best, prev[j - 1] + (tb[j - 1] != col), out=cur[j])
        done = la == i
        if done.any():
            out[done] = cur[at_b[done], at[done]]
        prev = cur
    return out


def levenshtein_table(a: list[str], b: list[str], tile: int = 200_000) -> np.ndarray:
    """All distances between two lists, in tiles of bounded memory."""
    ca, la = encode(a)
    cb, lb = encode(b)
    table = np.empty((len(a), len(b)), dtype=np.int16)
    step = max(1, tile // max(1, len(b)))
    for s in range(0, len(a), step):
        e = min(len(a), s + step)
        ia = np.repeat(np.arange(s, e), len(b))
        ib = np.tile(np.arange(len(b)), e - s)
        table[s:e] = levenshtein_pairs(ca[ia], la[ia], cb[ib], lb[ib]).reshape(e - s, len(b))
    return table
