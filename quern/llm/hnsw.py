"""Hierarchical navigable small-world graph in flat numpy arrays, built and searched in batches.

Neighbours are one int32 array per layer, padded with -1.  Insertion and search advance many
vectors at once: every step expands the best unexpanded entries of each beam by array
operations, so no Python loop runs over vectors.
"""

from __future__ import annotations

import numpy as np


class FlatHNSW:
    """Graph over unit vectors by inner product."""

    def __init__(self, vectors: np.ndarray, m: int = 12, ef_build: int = 40, seed: int = 5, batch: int = 512):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        self.m, self.ef_build, self.batch = m, ef_build, batch
        n = len(self.x)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(m)).astype(np.int64) if n else np.zeros(0, np.int64)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # members, neighbour numbers among the members
        top = 0
        while top < 8 and (level > top).sum() > m * 4:
            top += 1
        for lev in range(top, -1, -1):
            members = np.flatnonzero(level >= lev) if lev else np.arange(n)
            self.layers.append((members, self._build(members, 2 * m if lev == 0 else m, lev)))
        self.base = self.layers[-1][1] if self.layers else np.zeros((0, 2 * m), np.int32)

    def _build(self, members: np.ndarray, width: int, lev: int) -> np.ndarray:
        x = self.x[members]
        n = len(members)
        nbr = np.full((n, width), -1, dtype=np.int32)
        # nodes of the upper layers are inserted first, so that the descent can start from them
        rank = np.zeros(n, dtype=bool)
        if self.layers:
            rank[np.searchsorted(members, self.layers[-1][0])] = True
        order = np.concatenate([np.flatnonzero(rank), np.flatnonzero(~rank)])
        first = min(n, 96)
        self._link(x, nbr, order[:first], order[:first], None)
        at = first
        while at < n:
            size = min(self.batch, at, n - at)
            new = order[at : at + size]
            entry = self._entries(self.x[members[new]], members, order[:at])
            ids, _ = search_layer(x, nbr, x[new], entry, self.ef_build)
            self._link(x, nbr, new, new, ids)
            at += size
        return nbr

    def _entries(self, q: np.ndarray, members: np.ndarray, inserted: np.ndarray) -> np.ndarray:
        """Where the search of a layer starts: the best node of the layers above, by greedy descent."""
        if not self.layers:
            step = max(1, len(inserted) // 8)
            return np.tile(inserted[::step][:8], (len(q), 1))
        above, _ = self._descend(q)
        return np.searchsorted(members, above)

    def _descend(self, q: np.ndarray, layers=None) -> tuple[np.ndarray, None]:
        layers = self.layers if layers is None else layers
        members, nbr = layers[0]
        step = max(1, len(members) // 32)
        entry = np.tile(np.arange(len(members))[::step][:32], (len(q), 1))
        for i, (members, nbr) in enumerate(layers):
            ids, _ = search_layer(self.x[members], nbr, q, entry, 6)
            best = members[np.maximum(ids[:, :3], 0)]
            if i + 1 < len(layers):
                entry = np.searchsorted(layers[i + 1][0], best)
        return best, None

    def _link(self, x, nbr, new, batch, found) -> None:
        """Connect the new nodes with what the search found and with one another, both ways."""
        width = nbr.shape[1]
        among = x[new] @ x[batch].T
        among[new[:, None] == batch[None, :]] = -9
        take = min(len(batch), self.ef_build // 2 if found is not None else self.ef_build)
        part = np.argpartition(-among, take - 1, axis=1)[:, :take]
        cand = batch[part]
        sims = np.take_along_axis(among, part, axis=1)
        cand[sims < -8] = -1
        if found is not None:
            cand = np.concatenate([found, cand], axis=1)
        chosen = select_diverse(x, new, cand, self.m)
        nbr[new, : self.m] = chosen
        src = np.repeat(new, chosen.shape[1])
        dst = chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        at, first, n = np.unique(dst, return_index=True, return_counts=True)
        have = (nbr[at] >= 0).sum(axis=1)
        slot = np.arange(len(dst)) - np.repeat(first, n) + np.repeat(have, n)
        whole = int((have + n).max(initial=0))
        wide = np.full((len(at), max(whole, width)), -1, dtype=np.int32)
        wide[:, :width] = nbr[at]
        wide[np.repeat(np.arange(len(at)), n), slot] = src
        over = np.flatnonzero(have + n > width)
        fits = have + n <= width
        nbr[at[fits]] = wide[fits, :width]
        for s in range(0, len(over), 2048):
            rows = over[s : s + 2048]
            lists = wide[rows]
            if lists.shape[1] > width + 24:  # keep the nearest before the choice by diversity
                sims = np.einsum("nkd,nd->nk", x[np.maximum(lists, 0)], x[at[rows]])
                sims[lists < 0] = -9
                keep = np.argpartition(-sims, width + 23, axis=1)[:, : width + 24]
                lists = np.take_along_axis(lists, keep, axis=1)
            nbr[at[rows]] = select_diverse(x, at[rows], lists, width)

    def search(self, q: np.ndarray, k: int, ef: int = 32, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and inner products of the k best of every query; start: a node of the graph to begin from, per query."""
        ids = np.full((len(q), k), -1, dtype=np.int64)
        sims = np.full((len(q), k), -9, dtype=np.float32)
        if not len(self.x):
            return ids, sims
        for s in range(0, len(q), self.batch):
            part = np.ascontiguousarray(q[s : s + self.batch], dtype=np.float32)
            if start is not None:
                entry = start[s : s + self.batch, None]
            elif len(self.layers) > 1:
                entry, _ = self._descend(part, self.layers[:-1])
            else:
                step = max(1, len(self.x) // 16)
                entry = np.tile(np.arange(len(self.x))[::step][:16], (len(part), 1))
            a, b = search_layer(self.x, self.base, part, entry, max(ef, k))
            width = min(k, a.shape[1])
            ids[s : s + self.batch, :width], sims[s : s + self.batch, :width] = a[:, :width], b[:, :width]
        return ids, sims


def select_diverse(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
    """Per node at most m candidates: those nearer to the node than to any chosen one, then the nearest of the rest."""
    n, c = cand.shape
    vec = x[np.maximum(cand, 0)]
    sims = np.matmul(vec, x[nodes][:, :, None])[:, :, 0]
    bad = (cand < 0) | (cand == nodes[:, None])
    sims[bad] = -9
    order = np.argsort(-sims, axis=1)
    cand, sims = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sims, order, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1  # the same node found twice has the same similarity
    sims[cand < 0] = -9
    vec = np.take_along_axis(vec, order[:, :, None], axis=1)
    pair = np.matmul(vec, vec.transpose(0, 2, 1))
    closest = np.full((n, c), -9, dtype=np.float32)
    taken = np.zeros((n, c), dtype=bool)
    count = np.zeros(n, dtype=np.int64)
    for j in range(c):
        good = (sims[:, j] > -8) & (sims[:, j] > closest[:, j]) & (count < m)
        if good.any():
            taken[good, j] = True
            count[good] += 1
            closest[good] = np.maximum(closest[good], pair[good, :, j])
    key = np.where(taken, 10 + sims, sims)
    width = min(m, c)
    best = np.argsort(-key, axis=1)[:, :width]
    out = np.full((n, m), -1, dtype=np.int32)
    picked = np.take_along_axis(cand, best, axis=1)
    picked[np.take_along_axis(sims, best, axis=1) < -8] = -1
    out[:, :width] = picked
    return out


def search_layer(x: np.ndarray, nbr: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, expand: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Best-first beams of width ef for all queries at once; ids (-1 for none) and inner products, best first."""
    nq, n = len(q), len(x)
    seen = np.zeros((nq, n + 1), dtype=bool)
    seen[:, n] = True
    rows = np.arange(nq)[:, None]
    ids = np.full((nq, ef), -1, dtype=np.int64)
    sims = np.full((nq, ef), -9, dtype=np.float32)
    done = np.ones((nq, ef), dtype=bool)
    width = min(ef, entry.shape[1])
    s0 = np.matmul(x[entry], q[:, :, None])[:, :, 0]
    if entry.shape[1] > 1:
        e_order = np.argsort(-s0, axis=1)
        entry, s0 = np.take_along_axis(entry, e_order, axis=1), np.take_along_axis(s0, e_order, axis=1)
        dup = np.zeros(entry.shape, dtype=bool)
        for j in range(1, entry.shape[1]):
            dup[:, j] = (entry[:, :j] == entry[:, j : j + 1]).any(axis=1)
    else:
        dup = np.zeros(entry.shape, dtype=bool)
    ids[:, :width] = np.where(dup, -1, entry)[:, :width]
    sims[:, :width] = np.where(dup, -9, s0)[:, :width]
    done[:, :width] = dup[:, :width]
    seen[rows, np.where(entry >= 0, entry, n)] = True
    active = np.arange(nq)
    while len(active):
        a_ids, a_sims, a_done = ids[active], sims[active], done[active]
        rank = np.where(a_done, -99, a_sims)
        pick = np.argpartition(-rank, min(expand, ef - 1), axis=1)[:, :expand] if ef > expand else np.argsort(-rank, axis=1)[:, :expand]
        valid = np.take_along_axis(rank, pick, axis=1) > -50
        go = valid.any(axis=1)
        if not go.any():
            break
        if not go.all():
            active, a_ids, a_sims, a_done, pick, valid = active[go], a_ids[go], a_sims[go], a_done[go], pick[go], valid[go]
        r = np.arange(len(active))[:, None]
        a_done[r, pick] |= valid
        nodes = np.take_along_axis(a_ids, pick, axis=1)
        near = nbr[np.maximum(nodes, 0)]
        near = np.where(valid[:, :, None], near, -1).reshape(len(active), -1).astype(np.int64)
        near[near < 0] = n
        fresh = ~seen[active[:, None], near]
        # a node that two of the expanded ones share is taken once
        near[~fresh] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near.sort(axis=1)
        most = int((near < n).sum(axis=1).max(initial=0))
        if most == 0:
            done[active] = a_done
            continue
        near = near[:, :most]
        seen[active[:, None], near] = True
        s = np.matmul(x[np.minimum(near, n - 1)], q[active][:, :, None])[:, :, 0]
        s[near == n] = -9
        all_ids = np.concatenate([a_ids, near], axis=1)
        all_sims = np.concatenate([a_sims, s], axis=1)
        all_done = np.concatenate([a_done, near == n], axis=1)
        best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[active] = np.take_along_axis(all_ids, best, axis=1)
        sims[active] = np.take_along_axis(all_sims, best, axis=1)
        done[active] = np.take_along_axis(all_done, best, axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    ids[sims < -8] = -1
    return ids, sims
