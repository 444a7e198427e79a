"""A hierarchical navigable small-world graph over unit vectors, searched for all vectors within an angle.

Rows are put in order of descending level, so the nodes of layer l are a
prefix of the rows and each layer's links are one matrix. Rows are inserted in
batches: all of a batch are searched at once through the layers, then linked to the
diverse nearest of what they met (and of the batch itself).

A row within ``TIGHT`` of a node is hung on that node instead of being
inserted, so a crowd of near copies is one node and never an island that the
rest of the graph cannot reach. A search for cosine c visits all nodes within
the angle of c plus the angle of ``TIGHT``; the rows that hang on them are then
compared one by one, in double precision.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np

TIGHT = 0.97  # cosine from which a row hangs on a node
LINKS = 16  # links a node; twice as many in the lowest layer
WIDTH = 4  # nodes opened at a time
FIRST_BEAM = 32
NONE = -1


def units(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their length, in double precision; components of any finite size."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.square(rows).sum(axis=1, keepdims=True))


def levels(n: int, seed: int) -> np.ndarray:
    """Descending levels: a row reaches level l with probability LINKS ** -l."""
    draw = np.random.default_rng(seed).random(n)
    return -np.sort(-np.floor(-np.log(1 - draw) / math.log(LINKS)).astype(np.int64))


def diverse(sim: np.ndarray, ids: np.ndarray, x: np.ndarray, n_links: int) -> np.ndarray:
    """The links of each row among its candidates (ids, NONE for none): nearest first, and only those nearer to the row than to a link already chosen.

    Places that stay free are filled with the nearest of the others.
    """
    order = np.argsort(-sim, axis=1, kind="stable")
    sim, ids = np.take_along_axis(sim, order, 1), np.take_along_axis(ids, order, 1)
    rows, n = ids.shape
    v = x[ids]
    between = v @ v.transpose(0, 2, 1)
    chosen, count = np.zeros((rows, n), dtype=bool), np.zeros(rows, dtype=np.int64)
    closest = np.full((rows, n), -np.inf, dtype=np.float32)  # to any chosen link
    for j in range(n):
        take = (ids[:, j] >= 0) & (count < n_links) & (closest[:, j] < sim[:, j])
        chosen[take, j] = True
        count += take
        closest[take] = np.maximum(closest[take], between[take, j])
    rank = np.where(chosen, 0, 1) + 2 * (ids < 0)
    best = np.argsort(rank, axis=1, kind="stable")[:, :n_links]
    out = np.full((rows, n_links), NONE, dtype=np.int32)
    out[:, : best.shape[1]] = np.take_along_axis(ids, best, 1)
    return out


class Graph:
    """Rows ``x`` (unit vectors, float64) in the order of their levels, and the links of each layer."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray], owner: np.ndarray, beam: int):
        self.x, self.links, self.owner, self.beam = x, links, owner, beam
        self.near = x.astype(np.float32)
        self.hung = np.argsort(owner, kind="stable")  # rows by the node they hang on; a node hangs on itself
        self.hung_at = np.searchsorted(owner[self.hung], np.arange(len(x) + 1))

    @classmethod
    def build(cls, x: np.ndarray, at_least: float, seed: int = 0, batch: int = 256, build_beam: int = 48, recall: float = 0.995) -> Graph:
        """A graph of rows (already shuffled) whose beam is wide enough for ``recall`` in its audit."""
        n = len(x)
        level = levels(n, seed)
        sizes = [int((level >= i).sum()) for i in range(int(level[0]) + 1 if n else 1)]
        links = [np.full((m, LINKS * (1 if i else 2)), NONE, dtype=np.int32) for i, m in enumerate(sizes)]
        graph = cls(x, links, np.arange(n), build_beam)
        step, a = 1, 0
        while a < n:
            b = min(n, a + step)
            graph._insert(a, b, level, build_beam)
            a, step = b, min(batch, b)  # the graph at most doubles in a batch
        graph = cls(x, links, graph.owner, FIRST_BEAM)
        while graph.beam < n and graph.audit(at_least, seed) < recall:
            graph.beam *= 2
        return graph

    def _insert(self, a: int, b: int, level: np.ndarray, beam: int) -> None:
        rows = np.arange(a, b)
        q = self.near[a:b]
        same = np.tril(q @ q.T, -1)  # earlier rows of the batch
        same[np.triu_indices(b - a)] = -np.inf
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        entry = np.zeros((b - a, 1), dtype=np.int32)
        if a:
            for i in range(len(self.links) - 1, -1, -1):
                ids, sim = self._beam(q, i, entry, beam if i <= level[a] else 1, limit=a)
                found[i], entry = (ids, sim), ids
            nearest = sim.argmax(axis=1)
            hung = np.take_along_axis(sim, nearest[:, None], 1)[:, 0] >= TIGHT
            self.owner[rows[hung]] = np.take_along_axis(ids, nearest[:, None], 1)[hung, 0]
        else:
            hung = np.zeros(b - a, dtype=bool)
        for i in np.flatnonzero((same >= TIGHT).any(axis=1) & ~hung):  # near copies within the batch
            peers = np.flatnonzero((same[i] >= TIGHT) & ~hung)
            if len(peers):
                self.owner[rows[i]] = rows[peers[same[i, peers].argmax()]]
                hung[i] = True
        same[:, hung] = -np.inf
        for i, table in enumerate(self.links):
            new = np.flatnonzero(~hung & (level[a:b] >= i))
            if not len(new):
                continue
            k = min(b - a, LINKS)
            peers = np.argpartition(-same[new], k - 1, axis=1)[:, :k]
            peer_sim = np.take_along_axis(same[new], peers, 1)
            peer_ids = np.where(np.isfinite(peer_sim) & (level[rows[peers]] >= i), rows[peers], NONE)
            ids, sim = (np.concatenate([u[new], w], axis=1) for u, w in zip(found[i], (peer_ids, peer_sim), strict=True)) if i in found else (peer_ids, peer_sim)
            # a row that only hangs on a node is never linked; ids of the graph are nodes
            chosen = diverse(np.where(ids >= 0, sim, -np.inf).astype(np.float32), ids, self.near, LINKS)
            table[rows[new], : chosen.shape[1]] = chosen
            self._link_back(table, rows[new], chosen)

    def _link_back(self, table: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> None:
        """Links from the chosen nodes to the new rows; a full node keeps the diverse ones."""
        to, frm = chosen.ravel(), np.repeat(rows, chosen.shape[1])
        frm, to = frm[to >= 0], to[to >= 0]
        if not len(to):
            return
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        wide = np.full((len(nodes), int(count.max())), NONE, dtype=np.int32)
        wide[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = frm
        full = (table[nodes] >= 0).sum(axis=1)
        room = full + count <= table.shape[1]
        free = np.repeat(room, count)
        at = np.repeat(full, count) + np.arange(len(to)) - np.repeat(first, count)
        table[to[free], at[free]] = frm[free]
        some = nodes[~room]
        for a in range(0, len(some), 256):
            part, new = some[a : a + 256], wide[~room][a : a + 256]
            ids = np.concatenate([table[part], new], axis=1)
            sim = np.einsum("nd,nkd->nk", self.near[part], self.near[ids])
            table[part] = diverse(np.where(ids >= 0, sim, -np.inf).astype(np.float32), ids, self.near, table.shape[1])

    def _beam(self, q: np.ndarray, layer: int, entry: np.ndarray, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes that a search of one layer meets for each query (NONE: fewer), with their similarities."""
        links, n = self.links[layer], len(q)
        beam = max(beam, entry.shape[1])
        seen = np.zeros((n, min(len(links), limit or len(links)) + 1), dtype=bool)
        seen[:, -1] = True  # stands for no node
        ids = np.full((n, beam), NONE, dtype=np.int32)
        sim = np.full((n, beam), -np.inf, dtype=np.float32)
        ids[:, : entry.shape[1]] = entry
        known = ids >= 0
        r, c = np.nonzero(known)
        sim[r, c] = np.einsum("nd,nd->n", q[r], self.near[ids[r, c]])
        seen[r, ids[r, c]] = True
        fresh = known.copy()  # not opened yet
        live = np.arange(n)
        width = min(WIDTH, beam)
        while len(live):
            waiting = np.where(fresh[live], sim[live], -np.inf)
            pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width] if width < beam else np.broadcast_to(np.arange(beam), (len(live), beam))
            usable = np.isfinite(np.take_along_axis(waiting, pick, 1))
            some = usable.any(axis=1)
            live, pick, usable = live[some], pick[some], usable[some]
            if not len(live):
                break
            fresh[live[:, None], pick] = False
            nodes = ids[live[:, None], pick]
            near = links[nodes]
            near[~usable] = NONE
            near = np.sort(near.reshape(len(live), -1), axis=1)
            new = ~seen[live[:, None], near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(new)
            if not len(r):
                continue
            node = near[r, c]
            seen[live[r], node] = True
            got = np.full(near.shape, -np.inf, dtype=np.float32)
            got[r, c] = np.einsum("nd,nd->n", q[live[r]], self.near[node])
            all_sim = np.concatenate([sim[live], got], axis=1)
            all_ids = np.concatenate([ids[live], np.where(new, near, NONE)], axis=1)
            all_fresh = np.concatenate([fresh[live], new], axis=1)
            best = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            sim[live], ids[live], fresh[live] = (np.take_along_axis(u, best, 1) for u in (all_sim, all_ids, all_fresh))
        return np.where(np.isfinite(sim), ids, NONE), sim

    def _reach(self, at_least: float) -> float:
        """Cosine within which the node of any row that is similar enough must lie."""
        return math.cos(min(math.pi, math.acos(at_least) + math.acos(TIGHT))) - 1e-6

    def nodes_within(self, q: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the nodes found on which similar rows may hang.

        A beam that ends within reach is too narrow for its query, which is searched again with twice the beam.
        """
        reach, out = self._reach(at_least), []
        q = q.astype(np.float32)
        entry = np.zeros((len(q), 1), dtype=np.int32)
        for i in range(len(self.links) - 1, 0, -1):
            entry = self._beam(q, i, entry, min(self.beam, 8))[0]
        todo, beam = np.arange(len(q)), self.beam
        while len(todo):
            ids, sim = self._beam(q[todo], 0, entry[todo], beam)
            short = (sim.min(axis=1) >= reach) & (beam < len(self.x))
            r, c = np.nonzero((sim >= reach) & ~short[:, None])
            out.append((todo[r], ids[r, c]))
            todo, beam = todo[short], 2 * beam
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))

    def similar(self, q: np.ndarray, at_least: float, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, rows, matrix of who is similar to whom) in blocks, each pair found once, in double precision."""
        for a in range(0, len(q), block):
            part = q[a : a + block]
            r, node = self.nodes_within(part, at_least)
            order = np.argsort(node, kind="stable")
            r, node = r[order], node[order]
            alone = np.diff(self.hung_at)[node] == 1
            if alone.any():
                single, row = r[alone], node[alone]
                ok = np.einsum("nd,nd->n", part[single], self.x[row]) >= at_least
                for i, j in zip(single[ok].tolist(), row[ok].tolist(), strict=True):
                    yield np.array([a + i]), np.array([j]), np.ones((1, 1), dtype=bool)
            r, node = r[~alone], node[~alone]
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else []
            for i, s in enumerate(starts):
                e = starts[i + 1] if i + 1 < len(starts) else len(node)
                rows = self.hung[self.hung_at[node[s]] : self.hung_at[node[s] + 1]]
                yield a + r[s:e], rows, part[r[s:e]] @ self.x[rows].T >= at_least

    def audit(self, at_least: float, seed: int, n_queries: int = 256) -> float:
        """Share of links found, of two kinds: planted ones, and all that brute force finds for some rows.

        A planted query is turned away from a row by exactly the angle of ``at_least`` in a random
        direction, which is the hardest link to find.
        """
        rng = np.random.default_rng(seed + 1)
        rows = rng.choice(len(self.x), min(n_queries, len(self.x)), replace=False)
        base = self.x[rows]
        side = rng.standard_normal(base.shape)
        side -= np.einsum("nd,nd->n", side, base)[:, None] * base
        length = np.sqrt(np.square(side).sum(axis=1, keepdims=True))
        bound = at_least + 1e-9
        planted = np.where(length > 1e-9, bound * base + math.sqrt(max(0.0, 1 - bound**2)) * side / np.maximum(length, 1e-9), base)
        asked, wanted = np.concatenate([planted, base]), 0
        hits = found = 0
        truth = asked @ self.x.T >= at_least
        wanted = int(truth.sum())
        for i, _, near in self.similar(asked, at_least):
            found += int(near.sum())
        hits = found / max(1, wanted)
        own = np.zeros(len(rows), dtype=bool)
        for i, r, near in self.similar(planted, at_least):
            own[i] |= (near & (r[None, :] == rows[i][:, None])).any(axis=1)
        return min(hits, float(own.mean()))

    def dump(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, owner=self.owner, beam=np.int64(self.beam), **{f"links{i}": t for i, t in enumerate(self.links)}, **more)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
        """The graph, and the other arrays it was stored with."""
        with np.load(io.BytesIO(data)) as f:
            got = {k: f[k] for k in f.files}
        links = [got.pop(f"links{i}") for i in range(sum(k.startswith("links") for k in got))]
        return cls(got.pop("x"), links, got.pop("owner"), int(got.pop("beam"))), got
