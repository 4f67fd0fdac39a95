"""A hierarchical navigable small-world graph over one shard, in flat arrays, with all steps vectorised over many nodes at once."""

from __future__ import annotations

import io

import numpy as np


#: Nodes of a level that are compared with a query all at once, and places where a search starts.
WHOLE_LEVEL, ENTRIES = 2048, 4


class Graph:
    """``vecs`` (n x d, unit length), ``levels`` (largest first): per level the sorted node numbers and a flat neighbour array (nodes x degree, -1 = none)."""

    def __init__(self, vecs: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vecs, self.layers = vecs, layers

    # -- build -------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, vecs: np.ndarray, degree: int = 12, ef: int = 40, seed: int = 7) -> Graph:
        """Inserts nodes in growing batches: each batch searches the graph so far, and sees its own members as well.

        Level 0 holds every node with up to 2 * degree neighbours; each level above a 1/degree share of the
        one below with up to degree.
        """
        n = len(vecs)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 4)
        layers = []
        for lv in range(int(level.max(initial=0)), -1, -1):
            nodes = np.sort(order[level[order] >= lv])
            sub = vecs[nodes]
            nbrs = _insert_all(sub, 2 * degree if lv == 0 else degree, ef, rng)
            layers.append((nodes.astype(np.int32), nbrs))
        return cls(vecs, layers)

    # -- search ------------------------------------------------------------------------------------------

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """Close nodes of level 0 for each query: the ``ENTRIES`` best of the lowest level above that is small enough to be compared as a whole, then greedy descent."""
        upper = self.layers[:-1]
        if not upper:
            return np.zeros((len(queries), 1), np.int64)
        k = max(i for i, (nodes, _) in enumerate(upper) if i == 0 or len(nodes) <= WHOLE_LEVEL)
        nodes = upper[k][0]
        s = queries @ self.vecs[nodes].T
        m = min(ENTRIES, len(nodes))
        at = np.argpartition(-s, m - 1, axis=1)[:, :m]
        at = nodes[at].astype(np.int64)
        for nodes, nbrs in upper[k + 1 :]:
            flat = _greedy(self.vecs[nodes], nbrs, np.repeat(queries, m, 0), np.searchsorted(nodes, at.reshape(-1)))
            at = nodes[flat].astype(np.int64).reshape(-1, m)
        return at

    def search(self, queries: np.ndarray, k: int, ef: int, entry: np.ndarray | None = None, block: int = 128, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers and cosines of the k closest nodes of each query, best first; -1 where there are fewer.

        ``entry``: node to start from. ``floor``: a cosine per query that so many as a beam holds reach elsewhere already; nodes below it are of no use.
        """
        ids, sims = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf, np.float32)
        nbrs = padded(self.layers[-1][1])
        self.last = np.full(len(queries), -np.inf, np.float32)  # cosine at the end of each query's beam
        for a in range(0, len(queries), block):
            q = queries[a : a + block]
            start = self.entries(q) if entry is None else entry[a : a + block, None]
            i, s = _beam(self.vecs, nbrs, q, start, max(ef, k), floor=None if floor is None else floor[a : a + block])
            self.last[a : a + block] = s[:, -1]
            i = i[:, :k]
            s = np.einsum("ikj,ij->ik", self.vecs[i], q)  # all in one way, so that copies of a vector tie exactly
            s[i < 0] = -np.inf
            ids[a : a + block, : min(k, i.shape[1])], sims[a : a + block, : min(k, i.shape[1])] = i[:, :k], s[:, :k]
        return ids, sims

    # -- flat form ---------------------------------------------------------------------------------------

    def dump(self) -> bytes:
        buf = io.BytesIO()
        parts = {f"n{k}": nodes for k, (nodes, _) in enumerate(self.layers)} | {f"e{k}": e.astype(np.int32) for k, (_, e) in enumerate(self.layers)}
        np.savez(buf, vecs=self.vecs.astype(np.float32), **parts)
        return buf.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        z = np.load(io.BytesIO(data))
        m = sum(x.startswith("n") for x in z.files)
        return cls(z["vecs"], [(z[f"n{k}"], z[f"e{k}"]) for k in range(m)])


def padded(nbrs: np.ndarray) -> np.ndarray:
    """The neighbour array with n in place of -1, and a row for node n, which has no neighbours."""
    n = len(nbrs)
    return np.concatenate([np.where(nbrs < 0, n, nbrs), np.full((1, nbrs.shape[1]), n)]).astype(np.int32)


def _greedy(vecs: np.ndarray, nbrs: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each query moves to its closest neighbour until none is closer."""
    at = at.copy()
    best = np.einsum("ij,ij->i", vecs[at], q)
    live = np.arange(len(q))
    while len(live):
        near = nbrs[at[live]]
        s = np.einsum("ikj,ij->ik", vecs[near], q[live])
        s[near < 0] = -np.inf
        k = s.argmax(1)
        top = s[np.arange(len(live)), k]
        up = top > best[live]
        live = live[up]
        at[live], best[live] = near[up, k[up]], top[up]
    return at


def _beam(vecs: np.ndarray, nbrs: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, spread: int = 8, floor: np.ndarray | None = None, least: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: ``spread`` nodes of each beam are expanded at a time, until a beam holds no unexpanded node.

    With ``floor``, a beam holds the ``least`` best nodes and, beyond these, only such as are above the query's floor.
    """
    b, n = len(q), len(vecs)
    rows = np.arange(b)
    if len(nbrs) == n:
        nbrs = padded(nbrs)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # stands for "no neighbour"
    ids = np.full((b, ef), n, np.int64)
    sims = np.full((b, ef), -np.inf, np.float32)
    if floor is not None:
        sims[:, least:] = floor[:, None]
    done = np.ones((b, ef), bool)
    m = start.shape[1]
    ids[:, :m] = start
    sims[:, :m] = np.einsum("ikj,ij->ik", vecs[start], q)
    done[:, :m] = False
    if m > 1:  # descent from different nodes may end at the same one
        order = np.sort(start, axis=1)
        for r in np.flatnonzero((order[:, 1:] == order[:, :-1]).any(1)):
            _, one = np.unique(start[r], return_index=True)
            again = np.setdiff1d(np.arange(m), one)
            ids[r, again], sims[r, again], done[r, again] = n, -np.inf, True
    seen[rows[:, None], start] = True
    live = rows
    while len(live):
        open_ = np.where(done[live], np.inf, -sims[live])
        pick = np.argpartition(open_, spread, axis=1)[:, :spread] if ef > spread else np.tile(np.arange(ef), (len(live), 1))
        fresh = np.isfinite(np.take_along_axis(open_, pick, 1))
        done[live[:, None], pick] = True
        src = np.where(fresh, ids[live[:, None], pick], n)
        near = nbrs[src].reshape(len(live), -1)
        near.sort(axis=1)  # the same node may be a neighbour of several expanded ones
        new = ~seen[live[:, None], near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(new)
        v = near[r, c]
        seen[live[r], v] = True
        s = np.einsum("ij,ij->i", vecs[v], q[live[r]])
        ok = s > sims[live].min(1)[r]
        r, v, s = r[ok], v[ok], s[ok]
        if len(r):
            count = np.bincount(r, minlength=len(live))
            width = int(count.max())
            col = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            add_s = np.full((len(live), width), -np.inf, np.float32)
            add_i = np.full((len(live), width), n, np.int64)
            add_s[r, col], add_i[r, col] = s, v
            has = np.flatnonzero(count)
            at = live[has]
            all_s = np.concatenate([sims[at], add_s[has]], 1)
            all_i = np.concatenate([ids[at], add_i[has]], 1)
            all_d = np.concatenate([done[at], np.isneginf(add_s[has])], 1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]  # beams are sorted at the end only
            sims[at], ids[at], done[at] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_d, top, 1)
        live = live[~done[live].all(1)]
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    ids[ids == n] = -1
    return ids, sims


def _insert_all(vecs: np.ndarray, degree: int, ef: int, rng: np.random.Generator) -> np.ndarray:
    """The flat neighbour array of one level."""
    n = len(vecs)
    nbrs = np.full((n, degree), -1, np.int32)
    order = rng.permutation(n)
    first = min(n, 256)
    head = order[:first]
    s = vecs[head] @ vecs[head].T
    np.fill_diagonal(s, -np.inf)
    k = min(first - 1, 2 * degree)
    if k > 0:
        near = np.argsort(-s, axis=1)[:, :k]
        _connect(vecs, nbrs, head, head[near], np.take_along_axis(s, near, 1), degree)
    at = first
    while at < n:
        batch = order[at : at + min(512, at)]
        q = vecs[batch]
        entry = head[(q @ vecs[head].T).argmax(1)]  # the first nodes serve as the level's entries while it grows
        ids, sims = _beam(vecs, nbrs, q, entry[:, None], ef)
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        k = min(len(batch) - 1, degree)
        if k > 0:
            mate = np.argpartition(-own, k - 1, axis=1)[:, :k]
            ids = np.concatenate([ids, batch[mate]], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, mate, 1)], 1)
            top = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        _connect(vecs, nbrs, batch, ids, sims, degree)
        at += len(batch)
    return nbrs


def _choose(vecs: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """The neighbour heuristic: a candidate stays if it is closer to the node than to every neighbour already chosen; room left is filled by the closest others.

    ``ids`` (b x c, best first, -1 = none).
    """
    b, c = ids.shape
    v = vecs[ids]
    between = np.matmul(v, np.ascontiguousarray(v.transpose(0, 2, 1)))
    chosen = np.zeros((b, c), bool)
    worst = np.full((b, c), -np.inf, np.float32)  # similarity of each candidate to its closest chosen neighbour
    valid = ids >= 0
    count = np.zeros(b, int)
    for j in range(c):
        take = valid[:, j] & (sims[:, j] > worst[:, j]) & (count < degree)
        chosen[:, j] = take
        count += take
        worst = np.where(take[:, None], np.maximum(worst, between[:, :, j]), worst)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    top = np.argsort(rank, axis=1)[:, :degree]
    out = np.take_along_axis(np.where(valid, ids, -1), top, 1).astype(np.int32)
    if c < degree:
        out = np.concatenate([out, np.full((b, degree - c), -1, np.int32)], 1)
    return out


def _connect(vecs: np.ndarray, nbrs: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> None:
    """Links the new nodes to chosen candidates, and these back to them; full neighbour lists are chosen anew."""
    width = min(ids.shape[1], 2 * degree)
    picked = _choose(vecs, ids[:, :width], sims[:, :width], degree)
    nbrs[nodes] = picked
    src = np.repeat(nodes, degree)
    dst = picked.reshape(-1)
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    heads, begin, count = np.unique(dst, return_index=True, return_counts=True)
    by_count = np.argsort(count, kind="stable")  # blocks of like width
    heads, begin, count = heads[by_count], begin[by_count], count[by_count]
    for lo in range(0, len(heads), 512):
        h, bg, ct = heads[lo : lo + 512], begin[lo : lo + 512], count[lo : lo + 512]
        ct = np.minimum(ct, 3 * degree)
        width = int(ct.max())
        cand = np.full((len(h), degree + width), -1, np.int64)
        cand[:, :degree] = nbrs[h]
        r = np.repeat(np.arange(len(h)), ct)
        c = np.arange(len(r)) - np.repeat(np.cumsum(ct) - ct, ct)
        cand[r, degree + c] = src[np.repeat(bg, ct) + c]
        s = np.einsum("ikj,ij->ik", vecs[cand], vecs[h])
        srt = np.sort(cand, axis=1)
        twice = np.zeros(cand.shape, bool)
        if (srt[:, 1:] == srt[:, :-1])[srt[:, 1:] >= 0].any():  # mutual links appear twice
            for j in range(degree, cand.shape[1]):
                twice[:, j] = (cand[:, :j] == cand[:, j : j + 1]).any(1)
        s[(cand < 0) | twice] = -np.inf
        cand[np.isneginf(s)] = -1
        top = np.argsort(-s, axis=1, kind="stable")[:, : degree + max(8, degree // 2)]
        cand, s = np.take_along_axis(cand, top, 1), np.take_along_axis(s, top, 1)
        full = (cand[:, degree:] >= 0).any(1) if cand.shape[1] > degree else np.zeros(len(h), bool)
        nbrs[h[~full]] = cand[~full, :degree]
        if full.any():
            nbrs[h[full]] = _choose(vecs, cand[full], s[full], degree)
