"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one graph a shard.

Vectors that are equal after scaling to length one are one representative. A
label is dealt to shards of at most ``SHARD_ROWS`` representatives. A task
builds a shard's graph; then every block of the label's representatives
queries every shard of the label. A query's beam is doubled until its worst
member is no link any more, and all beams are doubled while an audit of the
block (exact search of ``AUDITS`` of its queries in the shard) finds less than
``RECALL`` of the links; a beam as large as the shard is an exact search.
Links are confirmed by the cosine in double precision. A task hands on the
number of each query's links and a star for each of its local components, so a
large group of near copies costs as many rows as it has members.

Defined cases: a vector that is null, empty, of length zero, or has null or
non-finite components, and a row without label, links with nothing; vectors of
different sizes never link; rows that share a vec_id are one node for
components and have counts of their own; a row without vec_id has no
component and is kept; an empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import staged
from barlab.llm.components import components

COSINE = 0.98
SHARD_ROWS = 16_384
BLOCK_ROWS = 1024
#: Links of a node above the lowest layer, twice as many on it; nodes of a layer per node of the next one.
DEGREE = 12
STEP = 12
BUILD_BEAM = 48
FIRST_BEAM = 32
AUDITS = 48
RECALL = 0.995
_AT_ONCE = 4


def unit_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label and the vector scaled to length one as bytes, null if it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, label in zip(batch["embedding"], batch["label"], strict=True):
                items = value.as_py()
                unit = None
                if items and label.is_valid and None not in items:
                    v = np.array(items, dtype=np.float64)
                    top = np.abs(v).max()
                    if np.isfinite(top) and top > 0:
                        v = v / top
                        unit = (v / np.sqrt((v * v).sum()) + 0.0).tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(out, pa.binary())], names=["vec_id", "label", "unit"])

    read = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return read.mapInArrow(run, "vec_id long, label string, unit binary")


class Graph:
    """A hierarchy of neighbour lists over the first ``n``, ``n / STEP``, ... vectors, the lowest layer last."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None) -> None:
        self.x = vectors
        self.layers = layers if layers is not None else []
        if layers is None:
            sizes = [len(vectors)]
            while sizes[-1] > 4 * STEP:
                sizes.append(-(-sizes[-1] // STEP))
            for size in reversed(sizes):
                self._add_layer(size)

    def _add_layer(self, n: int) -> None:
        degree = 2 * DEGREE
        links = np.full((n, degree), -1, dtype=np.int32)
        done = min(n, 2 * degree)
        base = self.x[:done] @ self.x[:done].T
        np.fill_diagonal(base, -2)
        near = np.argsort(-base, axis=1, kind="stable")[:, : max(done - 1, 0)]
        picked = self._diverse(np.arange(done), near, degree)
        links[:done, : picked.shape[1]] = picked
        while done < n:
            upto = min(n, done + min(512, max(64, done // 2)))
            new = np.arange(done, upto)
            found, _ = self._layer(links[:done], self.x[new], self._entries(self.x[new], done), BUILD_BEAM)
            own = self.x[new] @ self.x[new].T
            np.fill_diagonal(own, -2)
            k = min(DEGREE, len(new) - 1)
            own_near = new[np.argpartition(-own, k - 1, axis=1)[:, :k]] if k else np.zeros((len(new), 0), int)
            picked = self._diverse(new, np.concatenate([found, own_near], axis=1), DEGREE)
            links[new, : picked.shape[1]] = picked
            self._link_back(links, new, picked, degree)
            done = upto
        self.layers.append(links)

    def _link_back(self, links: np.ndarray, new: np.ndarray, picked: np.ndarray, degree: int) -> None:
        to, source = picked.ravel(), np.repeat(new, picked.shape[1])
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        source, to = source[order], to[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for begin in range(0, len(nodes), 256):
            part = slice(begin, begin + 256)
            width = int(count[part].max())
            more = np.full((len(nodes[part]), width), -1, dtype=np.int64)
            for i, (f, c) in enumerate(zip(first[part], count[part], strict=True)):
                more[i, :c] = source[f : f + c]
            kept = self._diverse(nodes[part], np.concatenate([links[nodes[part]], more], axis=1), degree)
            links[nodes[part]] = -1
            links[nodes[part], : kept.shape[1]] = kept

    def _diverse(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Of each node's candidates those nearer to it than to any chosen one, then the nearest others."""
        if not candidates.shape[1]:
            return candidates.astype(np.int32)
        candidates = np.where(candidates == nodes[:, None], -1, candidates)
        sims = np.einsum("qd,qkd->qk", self.x[nodes], self.x[candidates])
        sims[candidates < 0] = -3
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * BUILD_BEAM]
        candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
        again = np.zeros(candidates.shape, bool)
        by_id = np.argsort(candidates, axis=1, kind="stable")
        ranked = np.take_along_axis(candidates, by_id, 1)
        same = np.concatenate([np.zeros((len(nodes), 1), bool), ranked[:, 1:] == ranked[:, :-1]], axis=1)
        np.put_along_axis(again, by_id, same, 1)
        open_ = (candidates >= 0) & ~again
        vectors = self.x[candidates]
        nearest = np.full(candidates.shape, -2.0)  # similarity to the closest chosen one
        chosen = np.zeros(candidates.shape, bool)
        number = np.zeros(len(nodes), int)
        for j in range(candidates.shape[1]):
            take = open_[:, j] & (sims[:, j] > nearest[:, j]) & (number < most)
            if take.any():
                chosen[take, j] = True
                number[take] += 1
                nearest[take] = np.maximum(nearest[take], np.einsum("qd,qkd->qk", vectors[take, j], vectors[take]))
        rank = np.where(chosen, 0, np.where(open_, 1, 2)) * candidates.shape[1] + np.arange(candidates.shape[1])
        best = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(open_, best, 1), np.take_along_axis(candidates, best, 1), -1).astype(np.int32)

    def _entries(self, queries: np.ndarray, within: int) -> np.ndarray:
        """Where to enter the next layer: the best nodes of the layers above, found from the top."""
        if not self.layers:
            return np.zeros((len(queries), 1), dtype=np.int64)
        top = self.x[: len(self.layers[0])]
        found = np.argsort(-(queries @ top.T), axis=1, kind="stable")[:, :4]
        for links in self.layers[1:]:
            found, _ = self._layer(links, queries, found, 4)
        return np.where(found < within, found, 0)

    def _layer(self, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes found for each query, all queries side by side."""
        n, m = len(links), len(queries)
        beam = min(beam, n)
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, n + 1), bool)  # the last column takes what isn't there
        ids = np.full((m, beam), -1, dtype=np.int64)
        sims = np.full((m, beam), -np.inf)
        todo = np.zeros((m, beam), bool)

        def merge(own: np.ndarray, found: np.ndarray) -> None:
            found = np.sort(found, axis=1)
            new = (found >= 0) & ~seen[own, found]
            new[:, 1:] &= found[:, 1:] != found[:, :-1]
            seen[own, found] = True
            near = np.einsum("qd,qkd->qk", queries[own[:, 0]], self.x[found])
            near[~new] = -np.inf
            at = own[:, 0]
            every = np.concatenate([sims[at], near], axis=1)
            best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            sims[at] = np.take_along_axis(every, best, 1)
            ids[at] = np.take_along_axis(np.concatenate([ids[at], np.where(new, found, -1)], axis=1), best, 1)
            todo[at] = np.take_along_axis(np.concatenate([todo[at], new], axis=1), best, 1)

        merge(rows, np.asarray(entries, dtype=np.int64))
        wide = min(_AT_ONCE, beam)
        while True:
            active = np.flatnonzero(todo.any(axis=1))
            if not len(active):
                break
            open_ = np.where(todo[active], sims[active], -np.inf)
            pick = np.argpartition(-open_, wide - 1, axis=1)[:, :wide]
            live = np.take_along_axis(todo[active], pick, 1)
            nodes = np.take_along_axis(ids[active], pick, 1)
            todo[active[:, None], pick] = False
            next_ = np.where(live[:, :, None], links[nodes], -1).reshape(len(active), -1).astype(np.int64)
            next_[next_ >= n] = -1
            merge(active[:, None], next_)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def links_of(self, queries: np.ndarray, cosine: float, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray]:
        """All found pairs (query, node) of at least ``cosine``; beams widen until the audit passes."""
        n = len(self.x)
        audited = np.linspace(0, len(queries) - 1, min(AUDITS, len(queries)), dtype=int)
        truth = (queries[audited] @ self.x.T >= cosine).sum()
        beam = FIRST_BEAM
        while True:
            out = self._range(queries, cosine, beam)
            got = np.isin(out[0], audited).sum()
            if beam >= n or got >= recall * truth:
                return out
            beam *= 2

    def _range(self, queries: np.ndarray, cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.arange(len(queries))
        while len(left):
            if beam >= len(self.x):
                for part in np.array_split(left, -(-len(left) // 256)):
                    q, node = np.nonzero(queries[part] @ self.x.T >= cosine)
                    found.append((part[q], node))
                break
            again = []
            for part in np.array_split(left, -(-len(left) // max(1, min(512, (1 << 15) // beam)))):
                ids, sims = self._layer(self.layers[-1], queries[part], self._entries(queries[part], len(self.x)), beam)
                full = sims[:, -1] >= cosine  # the beam holds links only: there may be more
                again.append(part[full])
                q, k = np.nonzero((sims >= cosine) & ~full[:, None])
                found.append((part[q], ids[q, k]))
            left, beam = np.concatenate(again), beam * 2
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2


def _matrix(units: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype=np.float64).reshape(len(units), -1).copy()


def build(part: pd.DataFrame) -> pd.DataFrame:
    """The graph of one shard as one row."""
    part = part.sort_values("place", kind="stable")
    graph = Graph(_matrix(part["unit"]))
    return pd.DataFrame({
        "cell": [part["cell"].iloc[0]], "shard": [part["shard"].iloc[0]], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
        "copies": [part["copies"].to_numpy(np.int64).tobytes()], "vectors": [graph.x.tobytes()],
        "layers": [[x.tobytes() for x in graph.layers]],
    })


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links with the smallest node that it reaches through them."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        np.minimum.at(root, x, root[y])
        np.minimum.at(root, y, root[x])
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _query(cosine: float):
    def run(queries: pd.DataFrame, graphs: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"vec_id": pd.Series([], dtype="int64"), "root": pd.Series([], dtype="int64"), "linked": pd.Series([], dtype="int64")})
        if not len(queries) or not len(graphs):
            return out
        row = graphs.iloc[0]
        ids, copies = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64)
        x = np.frombuffer(row["vectors"]).reshape(len(ids), -1)
        layers = [np.frombuffer(b, np.int32).reshape(-1, 2 * DEGREE) for b in row["layers"]]
        own = queries["vec_id"].to_numpy(np.int64)
        units = _matrix(queries["unit"])
        q, node = Graph(x, layers).links_of(units, cosine)
        exact = np.einsum("kd,kd->k", units[q], x[node]) >= cosine
        other = exact & (own[q] != ids[node])
        q, node = q[other], node[other]
        if not len(q):
            return out
        linked = np.bincount(q, weights=copies[node], minlength=len(own)).astype(np.int64)
        nodes, roots = _stars(own[q], ids[node])
        counts = dict(zip(own.tolist(), linked.tolist(), strict=True))
        return pd.DataFrame({"vec_id": nodes, "root": roots, "linked": [counts.get(v, 0) for v in nodes.tolist()]})

    return run


def near_embeddings(rows: DataFrame, cosine: float = COSINE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    units = staged(unit_vectors(rows), "units")
    # vectors link within a label and a size
    reps = units.where("unit is not null and vec_id is not null").groupBy("label", "unit").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")
    ).withColumn("cell", F.concat_ws(":", F.length("unit"), "label"))
    reps = staged(reps, "vectors")
    sizes = reps.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    dealt = reps.join(sizes, "cell").withColumns({
        "shards": F.ceil(F.col("n") / shard_rows).cast("int"), "blocks": F.ceil(F.col("n") / block_rows).cast("int"),
        "place": F.xxhash64(F.lit("place"), "vec_id"),
    }).withColumns({"shard": F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"), "block": F.pmod(F.col("place"), F.col("blocks")).cast("int")})
    dealt = staged(dealt.select("cell", "vec_id", "unit", "copies", "shards", "blocks", "place", "shard", "block"), "dealt")
    graphs = staged(
        dealt.groupBy("cell", "shard").applyInPandas(build, "cell string, shard int, ids binary, copies binary, vectors binary, layers array<binary>"), "graphs"
    )
    asked = dealt.select("cell", "vec_id", "unit", "block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    blocks = dealt.groupBy("cell").agg(F.max("blocks").alias("blocks"))
    offered = graphs.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = staged(
        asked.groupBy("cell", "shard", "block").cogroup(offered.groupBy("cell", "shard", "block")).applyInPandas(
            _query(cosine), "vec_id long, root long, linked long"
        ), "links",
    )
    parts = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("vec_id").agg(F.sum("linked").alias("linked"))
    members = units.join(reps.select("label", "unit", F.col("vec_id").alias("rep"), "copies"), ["label", "unit"], "left")
    joined = members.join(linked.withColumnRenamed("vec_id", "rep"), "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id"))
    return joined.select(
        "vec_id", (F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
