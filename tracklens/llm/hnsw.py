"""Near-duplicate vectors through HNSW graphs per shard.

Vectors compare within their label (and length) only. Equal vectors are
first made one class. A label's classes are spread by hash over shards of
about ``SHARD`` vectors, and each shard becomes a hierarchical navigable
small-world graph, stored as one row in the shared folder. Then every block
of classes is sent to every shard of its label. A search runs a beam over
the bottom layer and follows the neighbours of each hit, so that a run of
hits is not cut by the beam's width.

Beams are widened by recall audits: after a graph is built, members moved
to just the least cosine that counts are searched for, and the beam doubles
until nearly all of them are found. A query whose beam holds mostly hits
is repeated with a wider one.

Hits are verified by cosine in double precision. A task reports per class
how many vectors it links to, and of the links themselves a spanning
forest: groups of copies stay linear. Components are united over all tasks.

Defined results: vectors that are NULL, empty, zero or hold NULL or
non-finite components, and rows without label or vec_id, link with nothing
and are their own component; repeated rows are separate vectors of one
class; rows that share a vec_id share its component.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import components, stage
from tracklens.llm.vectors import unit, usable, with_hashes

MIN_COSINE = 0.98
SHARD = 16_384  # classes of a graph, about
QUERIES = 1024  # classes of a query block, about
LINKS = 10  # neighbours of a node on upper layers; twice as many on the bottom layer
BUILD_BEAM = 32
FIRST_BEAM = 32
AUDITS = 128  # audit queries per graph
AUDIT_RECALL = 0.99


class Graph:
    """A navigable small-world graph over unit vectors; nodes are row numbers."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(LINKS)).astype(int), 30)
        self.layers: list[dict[int, np.ndarray]] = []
        self.entry, self.beam = -1, FIRST_BEAM
        for node in range(n):
            self._insert(node, int(levels[node]))

    # -- search

    def _beam(self, q: np.ndarray, start: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` best (similarity, node) that a beam meets, best first."""
        near, x = self.layers[layer], self.x
        seen = {i for _, i in start}
        todo = [(-s, i) for s, i in start]
        heapq.heapify(todo)
        best = list(start)
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            s, node = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            fresh = [i for i in near[node].tolist() if i not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for sim, i in zip((x[fresh] @ q).tolist(), fresh, strict=True):
                if len(best) < width:
                    heapq.heappush(best, (sim, i))
                    heapq.heappush(todo, (-sim, i))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, i))
                    heapq.heappush(todo, (-sim, i))
        return sorted(best, reverse=True)

    def _descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(len(self.layers) - 1, to, -1):
            at = self._beam(q, at, 1, layer)
        return at

    def within(self, q: np.ndarray, least: float, beam: int | None = None) -> list[int]:
        """Nodes with a similarity of ``least`` or more."""
        width = min(beam or self.beam, len(self.x))
        start = self._descend(q, 0)
        while True:
            found = self._beam(q, start, width, 0)
            hits = [i for s, i in found if s >= least]
            if 2 * len(hits) < width or width >= len(self.x):
                break
            width = min(2 * width, len(self.x))
        seen, todo = {i for _, i in found}, list(hits)
        while todo:  # neighbours of hits may be hits
            fresh = [i for i in self.layers[0][todo.pop()].tolist() if i not in seen]
            if fresh:
                seen.update(fresh)
                more = np.array(fresh)[self.x[fresh] @ q >= least].tolist()
                hits += more
                todo += more
        return hits

    # -- building

    def _spread(self, node: int, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Neighbours that are closer to ``node`` than to each other come first, then the closest rest."""
        if len(found) <= most:
            return np.array([i for _, i in found], dtype=np.int32)
        ids = [i for _, i in found]
        among = self.x[ids] @ self.x[ids].T
        chosen: list[int] = []
        for k, (sim, _) in enumerate(found):
            if not chosen or sim > among[k, chosen].max():
                chosen.append(k)
                if len(chosen) == most:
                    break
        if len(chosen) < most:
            have = set(chosen)
            chosen += [k for k in range(len(ids)) if k not in have][: most - len(chosen)]
        return np.array([ids[k] for k in chosen], dtype=np.int32)

    def _insert(self, node: int, level: int) -> None:
        q, none = self.x[node], np.empty(0, dtype=np.int32)
        top = len(self.layers) - 1
        if self.entry >= 0:
            at = self._descend(q, min(level, top))
            for layer in range(min(level, top), -1, -1):
                near, most = self.layers[layer], LINKS * (2 if layer == 0 else 1)
                at = self._beam(q, at, BUILD_BEAM, layer)
                near[node] = self._spread(node, at, LINKS)
                for other in near[node].tolist():
                    links = np.append(near[other], np.int32(node))
                    if len(links) > most:
                        sims = self.x[links] @ self.x[other]
                        order = np.argsort(-sims, kind="stable")
                        links = self._spread(other, list(zip(sims[order].tolist(), links[order].tolist(), strict=True)), most)
                    near[other] = links
        for _ in range(top + 1, level + 1):
            self.layers.append({node: none})
        if level > top:
            self.entry = node

    def audit(self, least: float, audits: int = AUDITS, recall: float = AUDIT_RECALL, seed: int = 11) -> float:
        """Widens the beam until members are found from vectors at a cosine of ``least``; returns the last recall."""
        n, dim = self.x.shape
        rng = np.random.default_rng(seed)
        picked = np.unique(np.linspace(0, n - 1, min(n, audits)).astype(int))
        noise = rng.standard_normal((len(picked), dim))
        member = self.x[picked].astype(np.float64)
        noise -= (noise * member).sum(axis=1, keepdims=True) * member
        size = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
        moved = least * member + math.sqrt(1 - least * least) * np.divide(noise, size, out=np.zeros_like(noise), where=size > 1e-9)
        moved = moved.astype(np.float32)
        while True:
            found = sum(i in self.within(q, least - 1e-4) for i, q in zip(picked.tolist(), moved, strict=True)) / len(picked)
            if found >= recall or self.beam >= n:
                return found
            self.beam = min(2 * self.beam, n)


def _build(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep", "cid"])
        raw = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        graph = Graph(unit(raw))
        recall = graph.audit(least)
        blob = pickle.dumps((graph, raw.astype(pdf["embedding"].iloc[0].dtype), pdf["cid"].to_numpy(), pdf["copies"].to_numpy()))
        first = pdf.iloc[0]
        return pd.DataFrame([(first["label"], first["dim"], first["shard"], graph.beam, recall, blob)], columns=["label", "dim", "shard", "beam", "recall", "graph"])

    return run


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    first = pdf.iloc[0]
    blob = pickle.dumps((np.stack(pdf["embedding"].to_numpy()), pdf["cid"].to_numpy(), pdf["copies"].to_numpy()))
    return pd.DataFrame([(first["label"], first["dim"], first["block"], first["shards"], blob)], columns=["label", "dim", "block", "shards", "queries"])


class Forest:
    """Union of links, keeping those that unite something."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def unite(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _search(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                graph, raw, ids, copies = pickle.loads(batch.column(0)[i].as_py())
                q_raw, q_ids, _ = pickle.loads(batch.column(1)[i].as_py())
                q_unit, exact = unit(q_raw.astype(np.float64)), unit(raw.astype(np.float64))
                forest, rows = Forest(), []
                for q, cid, own in zip(q_unit.astype(np.float32), q_ids.tolist(), q_unit, strict=True):
                    hits = np.array(graph.within(q, least - 1e-4), dtype=int)
                    hits = hits[ids[hits] != cid]
                    hits = hits[exact[hits] @ own >= least]
                    if len(hits):
                        rows.append((cid, cid, int(copies[hits].sum())))
                        rows += [(cid, other, 0) for other in ids[hits].tolist() if forest.unite(cid, other)]
                cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])

    return run


def vector_classes(vectors: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows that take part, as ``vec_id, label, h1, h2``, and their classes, both staged."""
    rows = with_hashes(
        vectors.select("vec_id", "label", "embedding").filter(
            usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
        )
    )
    classes = rows.groupBy("label", "dim", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")
    )
    return rows.drop("embedding"), stage(classes.withColumn("cid", F.monotonically_increasing_id()), name)


def near_duplicates(vectors: DataFrame, least: float = MIN_COSINE, shard: int = SHARD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``."""
    rows, classes = vector_classes(vectors, "hnsw-classes")
    sizes = classes.groupBy(F.col("label").alias("_l"), F.col("dim").alias("_d")).agg(F.count("*").alias("n"))
    spread = classes.join(sizes, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d"))).select(
        "label", "dim", "cid", "rep", "copies", "embedding",
        F.ceil(F.col("n") / shard).cast("long").alias("shards"),
        F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("n") / shard)).alias("shard"),
        F.pmod(F.xxhash64("rep", F.lit(2)), F.ceil(F.col("n") / QUERIES)).alias("block"),
    )
    label = vectors.schema["label"].dataType.simpleString()
    graphs = stage(
        spread.groupBy("label", "dim", "shard").applyInPandas(
            _build(least), f"label {label}, dim int, shard long, beam long, recall double, graph binary"
        ),
        "hnsw-graphs",
    )
    blocks = spread.groupBy("label", "dim", "block").applyInPandas(
        _pack, f"label {label}, dim int, block long, shards long, queries binary"
    )
    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    pairs = sent.join(graphs, ["label", "dim", "shard"]).repartition("label", "dim", "shard", "block")
    found = stage(pairs.select("graph", "queries").mapInArrow(_search(least), "a long, b long, n long"), "hnsw-found")
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("near"))
    roots = components(found.filter("a <> b").select("a", "b"), "hnsw")
    member = (
        classes.select("label", "dim", "h1", "h2", "cid", "rep", "copies")
        .join(links, "cid", "left")
        .join(roots, F.col("cid") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "cid"))
    )
    smallest = member.groupBy(F.col("root").alias("_r")).agg(F.min("rep").alias("low"))
    member = stage(
        member.join(smallest, F.col("root") == F.col("_r")).select(
            "label", "dim", "h1", "h2", "low", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        ),
        "hnsw-member",
    )
    linked = rows.join(member, ["label", "dim", "h1", "h2"]).select("vec_id", "n_links", F.col("low").alias("component_id"))
    alone = vectors.filter(
        ~usable(F.col("embedding")) | F.col("label").isNull() | F.col("vec_id").isNull()
    ).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
