"""A small-world graph over unit vectors, built and searched many points at a time."""

from __future__ import annotations

import numpy as np

#: Neighbours per node above and on the ground layer, beam while building, points added at once.
M, M0, BUILD_BEAM, STEP = 12, 24, 64, 512


def _pick(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Diverse neighbours: a candidate stays if it is nearer to the point than to any chosen one;
    room that is left goes to the nearest of the others.

    ``sims`` and ``ids`` are sorted by falling similarity, -1 = none. Keeps tight groups linked
    to the rest of the graph.
    """
    n, width = ids.shape
    v = x[np.maximum(ids, 0)]
    among = v @ v.transpose(0, 2, 1)
    closest = np.full((n, width), -np.inf, np.float32)  # similarity to the chosen ones
    chosen, count = np.zeros((n, width), bool), np.zeros(n, np.int64)
    for j in range(width):
        take = (ids[:, j] >= 0) & (count < most) & (sims[:, j] > closest[:, j])
        chosen[:, j] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, among[:, j]), closest)
    order = np.argsort(np.where(ids < 0, 2, ~chosen), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1)


class Graph:
    """Layers of adjacency lists (-1 = none) over the rows of ``x``."""

    def __init__(self, x: np.ndarray, seed: int = 11) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        top = np.minimum(np.floor(-np.log(np.random.default_rng(seed).uniform(1e-9, 1, n)) / np.log(M)).astype(int), 8)
        order = np.argsort(-top, kind="stable")  # upper layers first: every layer grows from its entry
        self.entry = int(order[0])
        self.layers = [np.full((n, M0 if k == 0 else M), -1, np.int32) for k in range(int(top.max()) + 1)]
        done = 1
        while done < n:
            new = order[done : done + min(STEP, done)]
            at = np.full((len(new), 1), self.entry)
            for k in range(len(self.layers) - 1, -1, -1):
                here = top[new] >= k
                ids, sims = self._search(k, self.x[new], at, BUILD_BEAM if here.any() else 1)
                if here.any():
                    self._link(k, new[here], ids[here], sims[here])
                at = ids[:, :1]
            done += len(new)
        ground = self.layers[0]
        for lost in np.flatnonzero(np.bincount(ground[ground >= 0], minlength=n) == 0).tolist():
            if ground[lost, 0] >= 0:  # nobody points here: its nearest neighbour shall
                ground[ground[lost, 0], -1] = lost

    def _link(self, k: int, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        adj = self.layers[k]
        mates = self.x[new] @ self.x[new].T  # points added together may be neighbours too
        np.fill_diagonal(mates, -np.inf)
        few = min(8, len(new) - 1)
        if few > 0:
            near = np.argpartition(-mates, few - 1, axis=1)[:, :few]
            ids, sims = np.c_[ids, new[near]], np.c_[sims, np.take_along_axis(mates, near, 1)]
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = _pick(sims, ids, self.x, adj.shape[1] // 2)
        adj[new, : out.shape[1]] = out
        source, target = np.repeat(new, out.shape[1]), out.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        width = adj.shape[1] + int(count.max(initial=0))
        both = np.full((len(nodes), width), -1, np.int64)
        both[:, : adj.shape[1]] = adj[nodes]
        nth = np.arange(len(target)) - np.repeat(first, count)
        both[np.repeat(np.arange(len(nodes)), count), adj.shape[1] + nth] = source
        for a in range(0, len(nodes), STEP):  # a full list keeps its most diverse members
            part, cand = nodes[a : a + STEP], both[a : a + STEP]
            s = np.where(cand >= 0, np.einsum("nd,nwd->nw", self.x[part], self.x[np.maximum(cand, 0)]), -np.inf)
            by = np.argsort(-s, axis=1, kind="stable")
            s, cand = np.take_along_axis(s, by, 1), np.take_along_axis(cand, by, 1)
            kept = _pick(s, cand, self.x, adj.shape[1])
            fits = (cand >= 0).sum(1) <= adj.shape[1]
            kept[fits] = cand[fits, : adj.shape[1]]
            adj[part] = kept

    def _search(self, k: int, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once on one layer; ids (-1 = none) by falling similarity."""
        adj, n, rows = self.layers[k], len(self.x), np.arange(len(q))[:, None]
        beam = min(beam, n)
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -np.inf, np.float32)
        width = min(start.shape[1], beam)
        ids[:, :width] = start[:, :width]
        sims[:, :width] = np.where(start[:, :width] >= 0, np.einsum("nd,nwd->nw", q, self.x[np.maximum(start[:, :width], 0)]), -np.inf)
        open_ = ids >= 0
        seen = np.zeros((len(q), n + 1), bool)
        seen[rows, ids] = True  # -1 marks the spare last column
        live = np.arange(len(q))
        while len(live):
            take = np.argsort(np.where(open_[live], -sims[live], np.inf), axis=1, kind="stable")[:, : min(4, beam)]
            ok = np.take_along_axis(open_[live], take, 1)
            alive = ok.any(1)
            live, take, ok = live[alive], take[alive], ok[alive]
            if not len(live):
                break
            nodes = np.take_along_axis(ids[live], take, 1)
            open_[live[:, None], take] = False
            near = np.where(ok[:, :, None], adj[np.maximum(nodes, 0)], -1).reshape(len(live), -1).astype(np.int64)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            s = np.where(near >= 0, np.einsum("nd,nwd->nw", q[live], self.x[np.maximum(near, 0)]), -np.inf).astype(np.float32)
            all_ids, all_s = np.c_[ids[live], near], np.c_[sims[live], s]
            all_open = np.c_[open_[live], near >= 0]
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam] if all_s.shape[1] > beam else np.argsort(-all_s, axis=1)
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_s, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1) & np.isfinite(sims[live])
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(q), 1), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            at = self._search(k, q, at, 1)[0]
        return self._search(0, q, at, beam)
