"""Embedding near-duplicates: hierarchical navigable small-world graphs, one per shard."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stored, table
from .lines import bounded
from .simhash import forest

THRESHOLD = 0.93
#: Vectors of a shard; links of a node above the ground layer (twice as many on it); beam while building.
SHARD, LINKS, BUILD_BEAM = 8192, 16, 48
#: First beam of a search, queries of an audit at most, links that it has to see, and the recall that it asks for.
BEAM, AUDIT, AUDIT_LINKS, RECALL = 32, 512, 400, 0.995
LOCKSTEP = 256


class Graph:
    """A navigable small-world graph over unit vectors. Nodes enter in batches; a batch's members search together."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], tops: np.ndarray):
        self.x, self.layers, self.tops = vectors, layers, tops

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> Graph:
        n = len(vectors)
        rng = np.random.default_rng(seed)
        tops = np.minimum(np.floor(-np.log(rng.random(n)) / np.log(LINKS)), 6).astype(int) if n else np.zeros(0, int)
        if n:
            tops[0] = tops.max()
        layers = [np.full((n, LINKS * (1 if k else 2)), -1, np.int32) for k in range(int(tops.max()) + 1 if n else 1)]
        g = cls(vectors.astype(np.float32), layers, tops)
        lo = 0
        while lo < n:
            hi = min(n, lo + max(1, min(LOCKSTEP, lo)))
            g._enter(np.arange(lo, hi))
            lo = hi
        g._bridge()
        return g

    def _enter(self, new: np.ndarray) -> None:
        lo, q = int(new[0]), self.x[new]
        at = np.zeros((len(new), 1), np.int32)
        for k in range(len(self.layers) - 1, -1, -1):
            mine = np.flatnonzero(self.tops[new] >= k)
            if lo:
                at, sims = self._beam(q, at, k, BUILD_BEAM if k <= self.tops[new].max() else 1)
            if len(mine):
                ids = np.broadcast_to(new[mine], (len(mine), len(mine))).astype(np.int32)
                own = q[mine] @ q[mine].T
                np.fill_diagonal(own, -2)
                if lo:
                    ids, own = np.concatenate([at[mine], ids], 1), np.concatenate([sims[mine], own], 1)
                width = min(ids.shape[1], BUILD_BEAM)
                best = np.argsort(-own, 1, kind="stable")[:, :width]
                self._connect(new[mine], np.take_along_axis(ids, best, 1), np.take_along_axis(own, best, 1), k)
            at = at if lo else np.zeros((len(new), 1), np.int32)

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Which of each row's candidates (best first) become links: those nearer to the row's node than to any link before."""
        v = self.x[np.maximum(ids, 0)]
        among = v @ v.transpose(0, 2, 1)
        keep, held, worst = np.zeros(ids.shape, bool), np.zeros(len(ids), int), np.full(ids.shape, -2, np.float32)
        for j in range(ids.shape[1]):
            take = (sims[:, j] > -1.5) & (ids[:, j] >= 0) & (worst[:, j] < sims[:, j]) & (held < most)
            keep[:, j] = take
            held += take
            if take.any():
                np.maximum(worst, among[:, j], out=worst, where=take[:, None])
        spare = ~keep & (sims > -1.5) & (ids >= 0)
        fill = np.cumsum(spare, 1) <= (most - keep.sum(1))[:, None]
        return keep | (spare & fill)

    def _connect(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> None:
        layer = self.layers[k]
        keep = self._chosen(ids, sims, LINKS)
        row, col = np.nonzero(keep)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        layer[nodes[row], place] = ids[row, col]
        # the other way: all that come to a node at once, the best of them and of its links stay
        source, target = nodes[row], ids[row, col]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        others, first, count = np.unique(target, return_index=True, return_counts=True)
        coming = np.full((len(others), int(count.max(initial=0))), -1, np.int32)
        coming[np.repeat(np.arange(len(others)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        known = layer[others]
        coming[(coming[:, :, None] == known[:, None, :]).any(2)] = -1
        both = np.concatenate([known, coming], 1)
        s = np.where(both < 0, -2, np.einsum("okd,od->ok", self.x[np.maximum(both, 0)], self.x[others]))
        best = np.argsort(-s, 1, kind="stable")[:, : 2 * layer.shape[1]]
        both, s = np.take_along_axis(both, best, 1), np.take_along_axis(s, best, 1)
        stay = self._chosen(both, s, layer.shape[1])
        both = np.where(stay, both, -1)
        layer[others] = np.take_along_axis(both, np.argsort(~stay, 1, kind="stable")[:, : layer.shape[1]], 1) if both.shape[1] >= layer.shape[1] else both

    def _beam(self, q: np.ndarray, start: np.ndarray, k: int, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` best nodes found for each query on layer k, best first (-1 where fewer), and their similarities."""
        n, layer, rows = len(self.x), self.layers[k], np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)
        ids = np.where(start < 0, n, start)
        dup = np.zeros(ids.shape, bool)
        order = np.argsort(ids, 1, kind="stable")
        np.put_along_axis(dup, order[:, 1:], np.diff(np.take_along_axis(ids, order, 1), axis=1) == 0, 1)
        ids = np.where(dup, n, ids)
        seen[rows, ids] = True
        sims = np.where(ids == n, -2, np.einsum("qkd,qd->qk", self.x[np.minimum(ids, n - 1)], q)).astype(np.float32)
        open_ = ids < n
        while True:
            order = np.argsort(-sims, 1, kind="stable")[:, :beam]
            ids, sims, open_ = (np.take_along_axis(v, order, 1) for v in (ids, sims, open_))
            busy = np.flatnonzero(open_.any(1))
            if not len(busy):
                break
            pick = np.argsort(~open_[busy], 1, kind="stable")[:, :expand]
            live = np.take_along_axis(open_[busy], pick, 1)
            open_[busy[:, None], pick] = False
            near = layer[np.where(live, np.take_along_axis(ids[busy], pick, 1), 0)]
            near = np.where((near < 0) | ~live[..., None], n, near).reshape(len(busy), -1)
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near[seen[busy[:, None], near]] = n
            seen[busy[:, None], near] = True
            s = np.where(near == n, -2, np.einsum("qkd,qd->qk", self.x[np.minimum(near, n - 1)], q[busy])).astype(np.float32)
            more = np.full((len(q), near.shape[1]), n, ids.dtype)
            more_s = np.full(more.shape, -2, np.float32)
            more[busy], more_s[busy] = near, s
            ids, sims = np.concatenate([ids, more], 1), np.concatenate([sims, more_s], 1)
            open_ = np.concatenate([open_, more < n], 1)
        return np.where(ids == n, -1, ids), sims

    def near(self, q: np.ndarray, least: float, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs found at similarity `least` or more. Where a beam fills up with such nodes, the search goes on from all
        of them along the ground layer until it meets no other; `own` is each query's own node, where it has one, and starts its search."""
        pairs = []
        for lo in range(0, len(q), LOCKSTEP):
            part = np.arange(lo, min(len(q), lo + LOCKSTEP))
            at = np.zeros((len(part), 1), np.int32)
            for k in range(len(self.layers) - 1, 0, -1):
                at, _ = self._beam(q[part], at, k, 2)
            if own is not None:
                at = np.concatenate([at, own[part, None]], 1)
            ids, sims = self._beam(q[part], at, 0, beam, max(4, min(beam // 16, 64)))
            full = (sims >= least).all(1) & (ids >= 0).all(1)
            r, c = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
            pairs.append((part[r], ids[r, c]))
            for i in np.flatnonzero(full):
                found = self._flooded(q[part[i]], least, ids[i])
                pairs.append((np.full(len(found), part[i]), found))
        return tuple(np.concatenate(v) for v in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))

    def _flooded(self, q: np.ndarray, least: float, start: np.ndarray) -> np.ndarray:
        """All nodes at `least` or more that links join to `start` through such nodes, `start` included."""
        seen, found, edge = np.zeros(len(self.x), bool), [start], start
        seen[start] = True
        while len(edge):
            near = self.layers[0][edge].ravel()
            near = np.unique(near[near >= 0])
            near = near[~seen[near]]
            seen[near] = True
            edge = near[self.x[near] @ q >= least]
            found.append(edge)
        return np.concatenate(found)

    def _bridge(self) -> None:
        """A link more for nodes that a walk from the first node wouldn't meet: from the nearest met node that has none yet."""
        more, met = np.full((len(self.x), 1), -1, np.int32), np.zeros(len(self.x), bool)

        def walk(edge: np.ndarray) -> None:
            while len(edge):
                met[edge] = True
                near = np.concatenate([self.layers[0][edge].ravel(), more[edge, 0]])
                near = np.unique(near[near >= 0])
                edge = near[~met[near]]

        walk(np.zeros(min(1, len(self.x)), int))
        for node in np.flatnonzero(~met):
            if not met[node]:
                more[np.argmax(np.where(met & (more[:, 0] < 0), self.x @ self.x[node], -2)), 0] = node
                walk(np.array([node]))
        if (more >= 0).any():
            self.layers[0] = np.concatenate([self.layers[0], more], 1)

    def _planted(self, least: float, most: int) -> np.ndarray:
        """Nodes turned by angles up to that of `least`: queries of which at least one link is known."""
        rng = np.random.default_rng(len(self.x))
        x = self.x[rng.permutation(len(self.x))[:most]].astype(np.float64)
        aside = rng.normal(size=x.shape)
        aside -= (aside * x).sum(1, keepdims=True) * x
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-30)
        cos = rng.uniform(least, 1, (len(x), 1))
        q = cos * x + np.sqrt(1 - cos**2) * aside
        return (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)

    def audited(self, q: np.ndarray, least: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """near() of all queries with the first beam at which the graph finds RECALL of the links of a sample, and that beam.

        Brute force answers the sample only. Queries are drawn until they have AUDIT_LINKS links, those with `own` not counted, or are
        AUDIT; if their links are fewer, planted queries join them. A walk from the first node meets every node, so a beam as
        wide as the graph misses nothing; a graph that fails even then is an error."""
        order, drawn, truths, seen = np.random.default_rng(len(q)).permutation(len(q)), 0, [], 0

        def truth(queries: np.ndarray, own: np.ndarray | None) -> set:
            r, c = np.nonzero(queries @ self.x.T >= least)
            return {(i, j) for i, j in zip(r.tolist(), c.tolist()) if own is None or own[i] != j}

        while drawn < min(len(q), AUDIT) and seen < AUDIT_LINKS:
            block = order[drawn : drawn + 64]
            mine = None if own is None else own[block]
            truths.append((q[block], mine, truth(q[block], mine)))
            drawn, seen = drawn + len(block), seen + len(truths[-1][2])
        if seen < AUDIT_LINKS:
            planted = self._planted(least, AUDIT_LINKS)
            truths.append((planted, None, truth(planted, None)))
        links, beam = sum(len(t) for *_, t in truths), BEAM
        while True:
            found = sum(len(t & set(zip(*(v.tolist() for v in self.near(sample, least, beam, mine))))) for sample, mine, t in truths)
            if found >= RECALL * links:
                return *self.near(q, least, beam, own), beam
            if beam >= len(self.x):
                raise RuntimeError(f"the graph finds {found} of {links} links of its sample")
            beam = min(2 * beam, len(self.x))

    def saved(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, tops=self.tops, **{f"layer{k}": v for k, v in enumerate(self.layers)}, **more)
        return out.getvalue()


def load(raw: bytes) -> tuple[Graph, dict]:
    z = dict(np.load(io.BytesIO(raw)))
    x = z["exact"] / np.linalg.norm(z["exact"], axis=1, keepdims=True)
    return Graph(x.astype(np.float32), [z[f"layer{k}"] for k in range(sum(n.startswith("layer") for n in z))], z["tops"]), z | {"unit": x}


def _built(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("rep")
    exact = np.stack(group["embedding"].to_numpy()).astype(np.float64)
    graph = Graph.build(exact / np.linalg.norm(exact, axis=1, keepdims=True))
    raw = graph.saved(exact=exact, rep=group["rep"].to_numpy(np.int64), copies=group["copies"].to_numpy(np.int64))
    return pd.DataFrame({"label": group["label"].iloc[:1], "dim": group["dim"].iloc[:1], "shard": group["shard"].iloc[:1], "graph": [raw]})


def _searched(threshold: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, left, right in zip(*(batch.column(k) for k in range(3))):
                g, a = load(left.as_py())
                h, b = (g, a) if same.as_py() else load(right.as_py())
                own = np.arange(len(g.x), dtype=np.int32) if same.as_py() else None
                u, v, _ = h.audited(g.x, np.float32(threshold - 1e-4), own)
                if own is not None:
                    u, v = np.minimum(u, v), np.maximum(u, v)
                    u, v = np.unique(np.stack([u, v])[:, u < v], axis=1)
                good = np.einsum("ij,ij->i", a["unit"][u], b["unit"][v]) >= threshold
                u, v = u[good], v[good]
                # counts on both sides, and a forest in place of the links themselves
                n, shift = len(g.x), 0 if own is not None else len(g.x)
                rep = a["rep"] if own is not None else np.concatenate([a["rep"], b["rep"]])
                links = np.bincount(u, b["copies"][v], len(rep)) + np.bincount(v + shift, a["copies"][u], len(rep))
                order = np.argsort(rep, kind="stable")
                rank = np.empty(len(rep), int)
                rank[order] = np.arange(len(rep))
                root = rep[order][forest(len(rep), rank[u], rank[v + shift])[rank]]
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], names=["rep", "links", "root"])

    return search


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Vectors of one label (and length) are compared. Equal vectors are one node that counts its copies. A label's
    nodes go by hash to shards of about `shard`, as many as its count asks for; each shard is built once into a graph, stored, and
    searched by every shard of its label, a pair of shards a row. Candidates are verified in double precision.
    Null, zero or non-finite vectors, those with null components and those without label or vec_id link with
    nothing. Rows that repeat a vec_id count as vectors of their own and share a component.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & (norm > 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    nodes = rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = stored(nodes.withColumn("dim", F.size("embedding")), "vectors")
    sizes = stored(nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")), "sizes")
    dealt = nodes.join(bounded(sizes), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int"))
    kind = vectors.schema["label"].dataType.simpleString()
    graphs = stored(dealt.select("label", "dim", "shard", "rep", "copies", "embedding").groupBy("label", "dim", "shard").applyInPandas(_built, f"label {kind}, dim int, shard int, graph binary"), "graphs")
    names = graphs.select("label", "dim", "shard")
    pairs = names.join(sizes, ["label", "dim"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shard")))).drop("shards")
    other = graphs.select("label", "dim", F.col("shard").alias("other"), F.col("graph").alias("right"))
    both = pairs.join(graphs, ["label", "dim", "shard"]).join(other, ["label", "dim", "other"]).select("label", "dim", "shard", "other", (F.col("shard") == F.col("other")).alias("same"), F.col("graph").alias("left"), F.when(F.col("shard") != F.col("other"), F.col("right")).alias("right"))
    spread = both.repartition("label", "dim", "shard", "other").select("same", "left", "right")
    found = stored(spread.mapInArrow(_searched(threshold), "rep long, links long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    group = components(found.select("rep", "root").toDF("u", "v"), "embeddings")
    known = nodes.select("label", "embedding", "rep", "copies").join(counts, "rep", "left").join(group, F.col("rep") == group.node, "left")
    known = stored(known.select("label", "embedding", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "known")
    k = known.select(F.col("label").alias("k_label"), F.col("embedding").alias("k_embedding"), "links", "component")
    good = rows.where("fit").join(k, (F.col("label") == F.col("k_label")) & (F.col("embedding") == F.col("k_embedding"))).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of a label, and what they reach.
ORACLE = r"""
with recursive v as (
  select vec_id, label, embedding::double[] as e, sqrt(list_sum([x * x for x in embedding::double[]])) as norm from embeddings
), pairs as (
  select a.vec_id as u, b.vec_id as w from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach as (
  select vec_id as node, vec_id as other from v union select r.node, p.w from reach r join pairs p on p.u = r.other
), least as (
  select node, min(other) as component_id from reach group by node
), counts as (
  select u, count(*) as n from pairs group by u
)
select v.vec_id, coalesce(n, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept from v left join counts on u = v.vec_id join least on node = v.vec_id
"""
