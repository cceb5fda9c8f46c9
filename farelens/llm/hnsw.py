"""A hierarchical navigable small-world graph over unit vectors, built and searched for many vectors at a time with numpy."""

from __future__ import annotations

import math

import numpy as np

#: Neighbours of a node on upper layers (twice as many on the lowest), and nodes considered when a node is linked.
NEIGHBOURS, BUILD_BEAM = 12, 64
#: Vectors that are inserted or searched together, and beam entries whose neighbours are looked at in one step.
BLOCK, AHEAD = 256, 4
# An empty place of a beam: behind all others, nothing to look at; and the half of a number that holds the node.
_NONE, _LOW = np.int64((1 << 63) - 1), np.int64((1 << 32) - 1)


class Graph:
    """Layers of neighbour tables over ``unit`` (n, d), float32 rows of length 1. ``seed`` draws the layers of the nodes."""

    def __init__(self, unit: np.ndarray, seed: int = 1):
        self.unit = unit
        n = len(unit)
        self._marks: np.ndarray | None = None
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(1.0 - draw) / math.log(NEIGHBOURS)).astype(int)
        # Nodes of high layers go in first, so that every layer is there before those below fill up.
        self.order = np.argsort(-level, kind="stable")
        self.level = level
        self.layers = [np.full((n, NEIGHBOURS * (1 if k else 2)), -1, np.int32) for k in range(int(level.max()) + 1 if n else 0)]
        self.start = int(self.order[0]) if n else -1
        done = 1
        while done < n:
            batch = self.order[done : done + min(BLOCK, max(1, done))]
            self._insert(batch)
            done += len(batch)

    def _insert(self, batch: np.ndarray) -> None:
        queries = self.unit[batch]
        entry = np.full((len(batch), 1), self.start, np.int32)
        among = queries @ queries.T
        np.fill_diagonal(among, -2)
        for layer in range(len(self.layers) - 1, -1, -1):
            inside = self.level[batch] >= layer
            ids, sims = self._beam(queries, entry, layer, BUILD_BEAM if inside.any() else 1)
            if inside.any():
                own = np.flatnonzero(inside)
                near = np.where(inside[None, :], among, -2)[own]
                width = min(BUILD_BEAM, len(batch))
                best = np.argpartition(-near, width - 1, axis=1)[:, :width]
                peers = np.where(np.take_along_axis(near, best, 1) > -2, batch[best], -1)
                every, all_sims = np.hstack([ids[own], peers]), np.hstack([sims[own], np.take_along_axis(near, best, 1)])
                rank = np.argsort(-all_sims, axis=1)[:, :BUILD_BEAM]
                every, all_sims = np.take_along_axis(every, rank, 1), np.take_along_axis(all_sims, rank, 1)
                chosen = self._spread_out(every, all_sims, NEIGHBOURS)
                self.layers[layer][batch[own], :NEIGHBOURS] = chosen
                self._link_back(layer, batch[own], chosen)
            entry = ids[:, :1].astype(np.int32)

    def _spread_out(self, ids: np.ndarray, sims: np.ndarray, limit: int) -> np.ndarray:
        """Of candidates from near to far, those nearer to the node than to any one chosen before; then the nearest others."""
        rows, width = ids.shape
        vectors = self.unit[np.maximum(ids, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        chosen, count = np.zeros((rows, width), bool), np.zeros(rows, int)
        # For every candidate, how near the nearest one chosen so far is.
        closest = np.full((rows, width), -2, np.float32)
        for k in range(width):
            take = (ids[:, k] >= 0) & (closest[:, k] < sims[:, k]) & (count < limit)
            chosen[:, k] = take
            count += take
            own = np.flatnonzero(take)
            closest[own] = np.maximum(closest[own], between[own, k])
        score = np.where(ids < 0, -9.0, np.where(chosen, 3.0, 0.0) + sims)
        rank = np.argsort(-score, axis=1)[:, :limit]
        out = np.take_along_axis(np.where(ids < 0, -1, ids), rank, 1)
        if out.shape[1] < limit:
            out = np.hstack([out, np.full((rows, limit - out.shape[1]), -1, out.dtype)])
        return out.astype(np.int32)

    def _link_back(self, layer: int, sources: np.ndarray, chosen: np.ndarray) -> None:
        """Sources become neighbours of the nodes chosen for them; a full table keeps those that spread out."""
        table = self.layers[layer]
        to, from_ = chosen.ravel(), np.repeat(sources, chosen.shape[1])
        # Two nodes of a block that chose each other are neighbours already.
        new = (to >= 0) & (table[np.maximum(to, 0)] != from_[:, None]).all(1)
        from_, to = from_[new], to[new]
        order = np.argsort(to, kind="stable")
        to, from_ = to[order], from_[order]
        nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, counts)
        used = (table[nodes] >= 0).sum(1)
        # Tables are filled from the left, so what fits is written behind.
        fits = np.repeat(used + counts <= table.shape[1], counts)
        table[to[fits], (np.repeat(used, counts) + place)[fits]] = from_[fits]
        full = np.flatnonzero(used + counts > table.shape[1])
        for lo in range(0, len(full), BLOCK):
            part = full[lo : lo + BLOCK]
            own, most = nodes[part], min(int(counts[part].max()), 4 * table.shape[1])
            at = first[part][:, None] + np.arange(most)
            extra = np.where(np.arange(most) < counts[part][:, None], from_[np.minimum(at, len(from_) - 1)], -1).astype(np.int32)
            ids = np.hstack([table[own], extra])
            sims = (self.unit[np.maximum(ids, 0)] @ self.unit[own][:, :, None])[:, :, 0]
            sims = np.where(ids < 0, -2, sims)
            rank = np.argsort(-sims, axis=1)
            table[own] = self._spread_out(np.take_along_axis(ids, rank, 1), np.take_along_axis(sims, rank, 1), table.shape[1])

    def _seen(self, rows: int) -> np.ndarray:
        """One mark for each query of a block and each node, all clear."""
        if self._marks is None or len(self._marks) < rows:
            self._marks = np.zeros((rows, len(self.unit)), np.uint8)
        return self._marks

    def _beam(self, queries: np.ndarray, entry: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found from the entries, near first: ids (-1: none) and similarities.

        A beam is a row of sorted numbers: distance in the upper half, then the node, and a last bit that is set once the node's
        neighbours have been looked at.
        """
        table, rows, n = self.layers[layer], len(queries), len(self.unit)
        marks = self._seen(rows).reshape(-1)
        beam = np.full((rows, width), _NONE, np.int64)
        beam[:, : entry.shape[1]] = _coded((self.unit[entry] @ queries[:, :, None])[:, :, 0], entry)
        marked = [(np.arange(rows)[:, None] * n + entry).ravel()]
        marks[marked[0]] = 1
        done = np.empty_like(beam)
        live, own, asking = np.arange(rows), beam, queries
        # Row and mark of each place in the lists of a step.
        places = min(AHEAD, width) * table.shape[1]
        row_of, mark_of = np.repeat(np.arange(rows), places), np.tile(np.arange(1, places + 1, dtype=np.uint8), rows)
        while len(live):
            # Beams are sorted, so the first places that wait are the nearest.
            waiting = np.where(own & 1, width, np.arange(width, dtype=np.int32))
            ahead = np.sort(waiting, axis=1)[:, :AHEAD]
            ended = ahead[:, 0] == width
            if ended.any():
                done[live[ended]] = own[ended]
                go = ~ended
                live, own, asking, ahead = live[go], own[go], asking[go], ahead[go]
                if not len(live):
                    break
            place = np.minimum(ahead, width - 1)
            nodes = np.take_along_axis(own, place, 1)
            np.put_along_axis(own, place, nodes | 1, 1)
            near = table.take(np.where(ahead < width, (nodes & _LOW) >> 1, 0), axis=0)
            near[ahead == width] = -1
            near = near.reshape(len(live), places)
            spot = np.flatnonzero(near >= 0)
            flat = (near + (live * n)[:, None]).take(spot)
            fresh = marks.take(flat) == 0
            flat, spot = flat[fresh], spot[fresh]
            # A node that several of the four lists name stays where its mark was written last.
            mark = mark_of.take(spot)
            marks[flat] = mark
            once = marks.take(flat) == mark
            flat, spot = flat[once], spot[once]
            marked.append(flat)
            if not len(spot):
                continue
            row, ids = row_of.take(spot), near.take(spot)
            sims = np.einsum("pd,pd->p", np.take(self.unit, ids, axis=0), np.take(asking, row, axis=0))
            found = _coded(sims, ids)
            # What is farther than the last of a full beam would fall out again.
            better = found < own[row, -1]
            row, found = row[better], found[better]
            if not len(row):
                continue
            counts = np.bincount(row, minlength=len(live))
            start = np.cumsum(counts) - counts
            more = np.full((len(live), int(counts.max())), _NONE, np.int64)
            more[row, np.arange(len(row)) - start[row]] = found
            own = np.sort(np.hstack([own, more]), axis=1)[:, :width]
        for flat in marked:
            marks[flat] = 0
        none = done == _NONE
        sims = 1 - (done >> 32).astype(np.int32).view(np.float32)
        return np.where(none, -1, (done & _LOW) >> 1).astype(np.int32), np.where(none, np.float32(-2), sims)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest nodes of each query that a beam of this width finds, near first."""
        beam = min(beam, len(self.unit))
        entry = np.full((len(queries), 1), self.start, np.int32)
        for layer in range(len(self.layers) - 1, 0, -1):
            entry = self._beam(queries, entry, layer, 1)[0]
        return self._beam(queries, entry, 0, beam)


def _coded(sims: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Numbers that sort like distances, then like ids, whose neighbours have not been looked at."""
    far = np.maximum(np.float32(1) - sims, np.float32(0)).view(np.int32)
    return (far.astype(np.int64) << 32) | (ids.astype(np.int64) << 1)
