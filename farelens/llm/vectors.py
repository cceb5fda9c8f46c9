"""Near duplicates among vectors: navigable small-world graphs in shards, every shard asked for every vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import frozen, id_or_last, id_or_null
from farelens.llm.components import components
from farelens.llm.hnsw import Graph

#: Shards at least, and vectors in a shard at most (more vectors: more shards).
SHARDS, SHARD_ROWS = 8, 200_000
#: First beam; beam from which on a shard is scanned instead; queries of a block that are audited; share of links an audit must find.
BEAM, WIDEST, AUDITED, RECALL = 64, 512, 16, 0.99
QUERY_BLOCK = 256
#: Links that the audits of a shard must have seen before they widen its beam: fewer do not tell 99 % from less.
JUDGED = 100
#: Similarities that a scan holds at once.
SCANNED = 1 << 18
# Similarities are computed in single precision while searching; links are decided in double.
_SLACK = 1e-4


def _vectors(table: DataFrame, dtype: str) -> DataFrame:
    """b (vec_id, null last), packed vector, or null where it links with nothing; node: hash of the vector."""

    kind = pa.from_numpy_dtype(dtype)

    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            x = lists.values.cast(kind, safe=False).to_numpy(zero_copy_only=False).astype(dtype) + 0  # -0.0 becomes 0.0
            ends = lists.offsets.to_numpy()
            # Components up to each place that are null or not finite, and that are not zero.
            odd, some = (np.append(0, np.cumsum(found)) for found in (~np.isfinite(x), x != 0))
            good = (odd[ends[1:]] == odd[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
            packed, at = x.tobytes(), (ends * x.itemsize).tolist()
            vecs = [packed[lo:hi] if ok else None for lo, hi, ok in zip(at, at[1:], good.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("b"), pa.array(vecs, pa.binary())], ["b", "vec"])

    rows = table.select(id_or_last(F.col("vec_id")).alias("b"), "embedding").mapInArrow(run, "b long, vec binary")
    return rows.withColumn("node", F.xxhash64("vec"))


class _Shard:
    """Vectors of one shard and one dimension: the graph, exact cosines, and components of the links inside."""

    def __init__(self, nodes: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, threshold: float, seed: int):
        self.nodes, self.sizes, self.threshold = nodes, sizes, threshold
        self.exact = vectors.astype(float)
        self.exact /= np.linalg.norm(self.exact / np.abs(self.exact).max(1, keepdims=True), axis=1, keepdims=True) * np.abs(
            self.exact
        ).max(1, keepdims=True)
        self.unit = self.exact.astype(np.float32)
        self.graph = Graph(self.unit, seed)
        self.beam = BEAM
        self.known = self.hit = 0
        self.roots = nodes

    def _scan(self, unit: np.ndarray) -> list[np.ndarray]:
        """Candidates by looking at every vector of the shard, a piece of it for all queries at a time."""
        found: list[list[np.ndarray]] = [[] for _ in unit]
        step = max(1, SCANNED // max(1, len(unit)))
        for lo in range(0, len(self.unit), step):
            sims = unit @ self.unit[lo : lo + step].T
            for k in np.flatnonzero(sims.max(1) >= self.threshold - _SLACK):
                found[k].append((lo + np.flatnonzero(sims[k] >= self.threshold - _SLACK)).astype(np.int32))
        return [np.concatenate([np.empty(0, np.int32), *pieces]) for pieces in found]

    def _searched(self, unit: np.ndarray, beam: int) -> list[np.ndarray]:
        """Candidates from the graph. A beam full of links may hide more: its query is scanned in the shard."""
        if beam >= min(WIDEST, len(self.unit)):
            return self._scan(unit)
        ids, sims = self.graph.search(unit, beam)
        near = (sims >= self.threshold - _SLACK) & (ids >= 0)
        found = [np.empty(0, np.int32)] * len(ids)
        for k in np.flatnonzero(near.any(1)):
            found[k] = ids[k, near[k]]
        full = np.flatnonzero(near.all(1))
        if len(full):
            for k, more in zip(full, self._scan(unit[full]), strict=True):
                found[k] = more
        return found

    def links(self, exact: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """Places of the vectors that link with each query; ``own``: the query's place in this shard, or -1.

        A block whose audited queries miss more than the share allowed is scanned. The audits of all blocks together decide when the beam
        of the next ones widens.
        """
        unit = exact.astype(np.float32)
        found = self._searched(unit, self.beam)
        if self.beam < min(WIDEST, len(self.unit)):
            audit = np.arange(0, len(unit), max(1, len(unit) // AUDITED))
            truth = self._scan(unit[audit])
            known = sum(map(len, truth))
            hit = sum(len(np.intersect1d(found[k], t)) for k, t in zip(audit, truth, strict=True) if len(t))
            self.known, self.hit = self.known + known, self.hit + hit
            if hit < RECALL * known:
                found = self._scan(unit)
            if self.known >= JUDGED and self.hit < RECALL * self.known:
                self.beam *= 2
                self.known = self.hit = 0
        out = []
        for q, places, me in zip(exact, found, own, strict=True):
            if len(places):
                places = places[places != me]
                places = places[self.exact[places] @ q >= self.threshold]
            out.append(places)
        return out

    def join_own(self) -> list[tuple[int, int, list[int]]]:
        """(node, links, roots) of the shard's own vectors; sets ``roots``, the smallest place linked within the shard."""
        parent = np.arange(len(self.nodes))

        def roots(places):
            above = parent[places]
            while (parent[above] != above).any():
                above = parent[above]
            return above

        counts = []
        for lo in range(0, len(self.nodes), QUERY_BLOCK):
            block = np.arange(lo, min(lo + QUERY_BLOCK, len(self.nodes)))
            for me, places in zip(block, self.links(self.exact[block], block), strict=True):
                counts.append(int(self.sizes[places].sum()))
                if len(places):
                    group = np.append(places, me)
                    tops = roots(group)
                    parent[tops] = parent[group] = tops.min()
        places = roots(np.arange(len(self.nodes)))
        self.roots = self.nodes[places]
        return [(int(n), c, [int(r)] if c else []) for n, c, r in zip(self.nodes, counts, self.roots, strict=True)]


def _answers(rows: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """(node, links, roots) of each vector for each shard. The rows of a shard come together, its own vectors first, then queries."""

    def run(batches):
        state: dict = {"shard": None, "graphs": {}}

        def unpack(vecs):
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(vecs):
                by_dim.setdefault(len(v), []).append(k)
            return {d: (k, np.frombuffer(b"".join(vecs[i] for i in k), dtype).reshape(len(k), -1)) for d, k in by_dim.items()}

        def built(pdf, shard):
            out, vecs = [], pdf["vec"].tolist()
            state.update(shard=shard, graphs={})
            for dim, (k, x) in unpack(vecs).items():
                part = pdf.iloc[k]
                one = _Shard(part["node"].to_numpy(np.int64), x, part["size"].to_numpy(np.int64), threshold, seed=shard + 1)
                state["graphs"][dim] = one
                out += one.join_own()
            return out

        def asked(pdf):
            out, nodes, vecs = [], pdf["node"].to_numpy(np.int64), pdf["vec"].tolist()
            for dim, (k, x) in unpack(vecs).items():
                one = state["graphs"].get(dim)
                if one is None:
                    continue
                exact = x.astype(float)
                exact /= np.abs(exact).max(1, keepdims=True)
                exact /= np.linalg.norm(exact, axis=1, keepdims=True)
                for lo in range(0, len(k), QUERY_BLOCK):
                    part = exact[lo : lo + QUERY_BLOCK]
                    for at, places in zip(k[lo : lo + QUERY_BLOCK], one.links(part, np.full(len(part), -1)), strict=True):
                        if len(places):
                            roots = np.unique(one.roots[places]).tolist()
                            out.append((int(nodes[at]), int(one.sizes[places].sum()), roots))
            return out

        frame = lambda out: pd.DataFrame(out, columns=["node", "links", "roots"])
        held: list[pd.DataFrame] = []

        def finish():
            own = pd.concat(held)
            held.clear()
            return frame(built(own, int(own["shard"].iloc[0])))

        for pdf in batches:
            for (shard, kind), part in pdf.groupby(["shard", "kind"], sort=True):
                if held and (kind == 1 or int(held[0]["shard"].iloc[0]) != shard):
                    yield finish()
                if kind == 0:
                    held.append(part)
                elif state["shard"] == shard:
                    yield frame(asked(part))
        if held:
            yield finish()

    return rows.mapInPandas(run, "node long, links long, roots array<long>")


def near_vectors(table: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``table`` (vec_id, embedding).

    Vectors link at a cosine of ``threshold`` or more, in double precision. Equal vectors are one class, searched once. Each shard of
    classes has a graph; every class is a query to every shard. Blocks of queries whose audited ones find less than RECALL of their links
    are scanned, and beams widen until all audits of a shard together find it; a query whose beam is full of links is scanned in the
    shard, so the number of links has no bound. Null, empty and zero vectors and
    those with null or non-finite components link with nothing; vectors of different lengths do not link. A null vec_id comes after
    all others. Links of a shard leave it as one component number, so a group of near copies makes no pairs.
    """
    kind = table.schema["embedding"].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    rows = frozen(_vectors(table, dtype), "vectors")
    classes = (
        rows.filter("vec is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("size"), F.min("b").alias("b"))
    )
    classes = frozen(classes, "classes")
    n = classes.count()
    shards = max(SHARDS, -(-n // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(shards)).cast("int")
    homes = classes.select(shard.alias("shard"), F.lit(0).alias("kind"), "node", "vec", "size")
    others = F.array_remove(F.sequence(F.lit(0), F.lit(shards - 1)), F.col("shard"))
    asked = homes.select(F.explode(others).alias("shard"), F.lit(1).alias("kind"), "node", "vec", "size")
    dealt = homes.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    answers = frozen(_answers(dealt, dtype, threshold), "answers")
    edges = answers.select(F.col("node").alias("u"), F.explode("roots").alias("v"))
    labels = components(edges)
    named = classes.select("node", "b", "size").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("b").alias("least"))
    links = answers.groupBy("node").agg(F.sum("links").alias("links"))
    found = named.join(least, "component").join(links, "node", "left").select(
        "node", "least", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    linked = rows.filter("vec is not null").join(found, "node").select("b", "n_links", "least")
    alone = rows.filter("vec is null").select("b", F.lit(0).cast("long").alias("n_links"), F.col("b").alias("least"))
    return linked.unionByName(alone).select(
        id_or_null(F.col("b")).alias("vec_id"), "n_links", id_or_null(F.col("least")).alias("component_id"),
        (F.col("b") == F.col("least")).alias("kept"),
    )
