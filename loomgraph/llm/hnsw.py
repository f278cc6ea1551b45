"""Embedding near-dedup: hierarchical navigable small-world graphs per shard.

Equal vectors are one class, searched once and counted with its weight.  Classes are
dealt to shards, whose size in bytes is bounded, by a hash of their id.  Each shard
builds a layered graph.  Every pair of shards meets once: the vectors of one are looked
up in the other's graph, and within a shard each vector looks for those of smaller id.
A link found counts for both its vectors, so numbers of links are symmetric.

A search keeps a beam of the best nodes; while all of a beam links, or while an audit
against brute force misses links, the beam is widened.  Audits hold sampled queries and
``PLANTED`` ones, rows of the shard turned by up to the angle of a link in a random
direction, so each audit has true links to find however sparse the data are.  Links are
confirmed by cosine in double precision wherever single precision leaves a doubt.  A
task returns each vector's number of links and a spanning set of edges, and holds the
pairs of one slice of queries at a time; components are the union of those edges.

Searches of a task run in step, as array operations over all its queries.
"""

from __future__ import annotations

import io
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64
from .components import connected_components

COSINE = 0.9
#: Shards at least, and bytes of a shard's index at most, about.
SHARDS, SHARD_BYTES = 8, 96 << 20
#: Neighbours of a node; beams of building and of the first search.
DEGREE, BUILD_BEAM, SEARCH_BEAM = 12, 32, 16
#: Queries of a task that are audited, planted queries beside them, and the recall that
#: both must reach.
AUDITS, PLANTED, RECALL = 64, 192, 0.99
#: Numbers held at once by a slice of queries, pairs that an audit keeps of queries with many
#: links, and edges that are kept before they are reduced to spanning ones.
CELLS, AUDIT_PAIRS, EDGES = 4_000_000, 1_000_000, 1_000_000

_log = logging.getLogger(__name__)


# ---------------------------------------------------------------------- graph
@dataclass
class Layer:
    nodes: np.ndarray  # rows of the shard, by place in this layer
    near: np.ndarray  # (nodes, 2 * DEGREE) places, -1 where free


def _search(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``beam`` places of a layer for each query, searched in step.

    ``x``: unit vectors by place; ``entry``: (queries, k) places, -1 where free.
    Returns places (-1 where free) and cosines, best first."""
    n_q, n = len(q), len(x)
    seen = np.zeros((n_q, n + 1), bool)
    seen[:, n] = True  # stands for "no place"
    at = np.where(entry < 0, n, entry)
    place = np.full((n_q, beam), n)
    cos = np.full((n_q, beam), -np.inf, np.float32)
    done = np.ones((n_q, beam), bool)
    width = max(2, beam // 8)

    def merge(who: np.ndarray, new: np.ndarray) -> None:
        """Adds places ``new`` (len(who), k) to the beams of the queries ``who``."""
        new = np.sort(new, 1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        fresh = ~seen[who[:, None], new]
        new = np.where(fresh, new, n)
        seen[who[:, None], new] = True
        sims = np.einsum("qd,qkd->qk", q[who], x[np.minimum(new, n - 1)])
        sims[new == n] = -np.inf
        all_cos = np.concatenate([cos[who], sims], 1)
        best = np.argsort(-all_cos, 1, kind="stable")[:, :beam]
        cos[who] = np.take_along_axis(all_cos, best, 1)
        place[who] = np.take_along_axis(np.concatenate([place[who], new], 1), best, 1)
        done[who] = np.take_along_axis(np.concatenate([done[who], new == n], 1), best, 1)

    merge(np.arange(n_q), at)
    active = np.arange(n_q)
    while len(active):
        open_ = ~done[active]
        # The first ``width`` open entries of each beam, which is in order.
        rank = np.cumsum(open_, 1)
        take = open_ & (rank <= width)
        some = take.any(1)
        active, take = active[some], take[some]
        if not len(active):
            break
        done[active] |= take
        nodes = np.where(take, place[active], n)
        # Gather the taken entries to the left: at most ``width`` of them.
        left = np.argsort(~take, 1, kind="stable")[:, :width]
        nodes = np.take_along_axis(nodes, left, 1)
        hop = np.where((nodes == n)[:, :, None], n, near[np.minimum(nodes, n - 1)]).reshape(len(active), -1)
        hop[hop < 0] = n
        merge(active, hop)
    return np.where(place == n, -1, place), cos


def _choose(x: np.ndarray, own: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
    """For each node, up to ``keep`` of its candidates: nearest first, passing over one
    that is nearer to a chosen neighbour than to the node, then filled up."""
    n = len(own)
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == own[:, None]] = -1
    v = x[np.maximum(cand, 0)]
    sims = np.einsum("nd,nkd->nk", x[own], v)
    sims[cand < 0] = -np.inf
    order = np.argsort(-sims, 1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    between = np.einsum("nid,njd->nij", v, v)
    chosen = np.zeros(cand.shape, bool)
    for j in range(cand.shape[1]):
        clash = (chosen & (between[:, :, j] > sims[:, j, None])).any(1)
        chosen[:, j] = (cand[:, j] >= 0) & ~clash & (chosen.sum(1) < keep)
    # Fill up with the nearest of the rest.
    rest = (cand >= 0) & ~chosen
    rest &= np.cumsum(rest, 1) <= (keep - chosen.sum(1))[:, None]
    chosen |= rest
    left = np.argsort(~chosen, 1, kind="stable")[:, :keep]
    out = np.where(np.take_along_axis(chosen, left, 1), np.take_along_axis(cand, left, 1), -1)
    if out.shape[1] < keep:
        out = np.concatenate([out, np.full((n, keep - out.shape[1]), -1)], 1)
    return out


class ShardIndex:
    """HNSW over the unit vectors of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, layers: list[Layer] | None = None, weights: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors
        self.weights = np.ones(len(ids), np.int64) if weights is None else weights
        self.unit = _unit(vectors).astype(np.float32)
        self.layers = layers if layers is not None else self._build()

    def _build(self) -> list[Layer]:
        n = len(self.ids)
        u = (mix64(self.ids.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(float) / 2**53
        level = np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(DEGREE)).astype(int)
        layers: list[Layer] = []
        for top in range(level.max() if n else -1, -1, -1):
            nodes = np.flatnonzero(level >= top)
            if top and len(nodes) < 4 and not layers:
                continue
            layers.append(self._build_layer(nodes, layers))
        return layers

    def _build_layer(self, nodes: np.ndarray, above: list[Layer]) -> Layer:
        x, n = self.unit[nodes], len(nodes)
        near = np.full((n, 2 * DEGREE), -1)
        place_of = np.full(len(self.ids), -1)
        place_of[nodes] = np.arange(n)
        # Nodes of the layer above go first, so that entries lie in the graph.
        order = np.arange(n)
        if above:
            inside = np.isin(nodes, above[-1].nodes)
            order = np.concatenate([np.flatnonzero(inside), np.flatnonzero(~inside)])
        ready = 0
        while ready < n:
            batch = order[ready : ready + max(32, min(512, ready))]
            found = np.full((len(batch), 0), -1)
            if ready:
                if above and ready >= len(above[-1].nodes):
                    entry = place_of[self._descend(x[batch], above)]
                else:
                    entry = np.repeat(order[:1][None], len(batch), 0)
                found, _ = _search(x, near, x[batch], entry, min(BUILD_BEAM, ready))
            sims = x[batch] @ x[batch].T
            np.fill_diagonal(sims, -np.inf)
            k = min(DEGREE, len(batch) - 1)
            mates = batch[np.argpartition(-sims, k - 1, 1)[:, :k]] if k > 0 else np.full((len(batch), 0), -1)
            links = _choose(x, batch, np.concatenate([found, mates], 1), DEGREE)
            self._link(x, near, batch, links)
            ready += len(batch)
        return Layer(nodes, near)

    @staticmethod
    def _link(x: np.ndarray, near: np.ndarray, batch: np.ndarray, links: np.ndarray) -> None:
        a, b = np.repeat(batch, links.shape[1]), links.ravel()
        a, b = a[b >= 0], b[b >= 0]
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])  # both ways
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        who, first, count = np.unique(src, return_index=True, return_counts=True)
        for lo in range(0, len(who), 2048):
            w, f, c = who[lo : lo + 2048], first[lo : lo + 2048], np.minimum(count[lo : lo + 2048], 64)
            new = np.full((len(w), c.max()), -1)
            col = np.arange(c.max())[None]
            mask = col < c[:, None]
            new[mask] = dst[(f[:, None] + col)[mask]]
            near[w] = _choose(x, w, np.concatenate([near[w], new], 1), near.shape[1])

    def _descend(self, q: np.ndarray, layers: list[Layer]) -> np.ndarray:
        """Entry rows for the layer below ``layers``: the nearest nodes of the last one."""
        entry = np.repeat(layers[0].nodes[:1][None], len(q), 0)
        for layer in layers:
            place_of = np.full(len(self.ids), -1)
            place_of[layer.nodes] = np.arange(len(layer.nodes))
            found, _ = _search(self.unit[layer.nodes], layer.near, q, np.where(entry >= 0, place_of[entry], -1), min(6, len(layer.nodes)))
            entry = np.where(found >= 0, layer.nodes[np.maximum(found, 0)], -1)
        return entry

    def _exact(self, q: np.ndarray, rows_q: np.ndarray, rows: np.ndarray, cos: np.ndarray, least: float) -> np.ndarray:
        """Which pairs (query, row) link; ``cos`` in single precision.

        That is off by less than ``_doubt``; pairs nearer to ``least`` are told in double."""
        out = cos >= least + self._doubt
        open_ = np.flatnonzero(~out)
        step = max(1, CELLS // q.shape[1])
        for lo in range(0, len(open_), step):
            part = open_[lo : lo + step]
            out[part] = np.einsum("kd,kd->k", q[rows_q[part]], _unit(self.vectors[rows[part]])) >= least
        return out

    @property
    def _doubt(self) -> float:
        """Twice the largest error of a single-precision product of unit vectors."""
        return (self.unit.shape[1] + 4) * 2.0**-23

    def _brute(self, q: np.ndarray, who: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row): all links of the queries ``who``, slice by slice."""
        step = max(1, CELLS // max(1, len(self.ids)))
        for lo in range(0, len(who), step):
            part = who[lo : lo + step]
            cos = q[part].astype(np.float32) @ self.unit.T
            a, b = np.nonzero(cos >= least - self._doubt)
            cos, a = cos[a, b], part[a]
            keep = self._exact(q, a, b, cos, least)
            yield a[keep], b[keep]

    def _planted(self, least: float) -> np.ndarray:
        """Unit vectors that link with a row each: sampled rows, turned at random."""
        rng = np.random.default_rng(len(self.ids))
        x = _unit(self.vectors[rng.permutation(len(self.ids))[:PLANTED]])
        side = rng.normal(size=x.shape)
        side -= np.einsum("kd,kd->k", side, x)[:, None] * x
        # Of one component, nothing is at right angles: such rows stay as they are.
        size = np.sqrt((side * side).sum(1, keepdims=True))
        c = rng.uniform(least + 0.01 * (1 - least), 1, (len(x), 1))
        return np.where(size > 1e-9, c * x + np.sqrt(1 - c * c) * side / np.maximum(size, 1e-9), x)

    def links(self, q: np.ndarray, least: float, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """(query, row, seen, hit): links found for unit vectors ``q``, by slices of queries.

        ``own``: ids of the queries, where they are vectors of this shard: each then links
        with rows of smaller ids only.  ``seen`` and ``hit`` add up to the audited true
        links and those of them that the search finds."""
        if not len(q) or not len(self.ids):
            return
        n = len(self.ids)
        order = np.argsort(mix64(np.arange(len(q), dtype=np.uint64)), kind="stable")
        audit = order[:AUDITS]
        asked = np.concatenate([q[audit], self._planted(least)])
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size, held = np.zeros(len(asked), np.int64), 0
        for a, b in self._brute(asked, np.arange(len(asked)), least):
            size += np.bincount(a, minlength=len(asked))
            few = size[a] < SEARCH_BEAM
            # Pairs of queries with many links are kept up to a bound: they are judged apart.
            kept.append((a[few], b[few]))
            if held < AUDIT_PAIRS:
                kept.append((a[~few], b[~few]))
                held += int((~few).sum())
        key = np.sort(np.concatenate([a * n + b for a, b in kept]))
        linked, few = np.unique(key // n), size[key // n] < SEARCH_BEAM
        beam = SEARCH_BEAM
        while True:
            found = [a * n + b for a, b in self._range(asked, linked, least, beam)]
            hits = np.isin(key, np.concatenate(found), assume_unique=True) if found else np.zeros(len(key), bool)
            # Planted queries, and those with few links, are judged apart from large groups.
            planted = key // n >= len(audit)
            recall = min((x.mean() for x in (hits[few & ~planted], hits[few & planted], hits[~few]) if len(x)), default=1.0)
            if recall >= RECALL or beam >= n:
                break
            beam *= 2
        yield np.zeros(0, int), np.zeros(0, int), len(key), int(hits.sum())
        for a, b in self._range(q, np.arange(len(q)), least, beam):
            keep = slice(None) if own is None else own[a] > self.ids[b]
            yield a[keep], b[keep], 0, 0

    def _range(self, q: np.ndarray, todo: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of the links of the queries ``todo``, by slices."""
        n = len(self.ids)
        while len(todo):
            if beam * 4 >= n:
                yield from self._brute(q, todo, least)
                return
            wide = []
            # A step of a search looks at the neighbours of up to an eighth of the beam.
            looks = 2 * DEGREE * max(2, beam // 8) * q.shape[1]
            step = max(1, min(1024, 4 * CELLS // (n + 1), 8 * CELLS // looks))
            for lo in range(0, len(todo), step):
                part = todo[lo : lo + step]
                x = q[part].astype(np.float32)
                above, base = self.layers[:-1], self.layers[-1]
                entry = self._descend(x, above) if above else np.zeros((len(x), 1), int)
                found, cos = _search(self.unit, base.near, x, entry, beam)
                full = cos[:, -1] >= least - self._doubt  # all of the beam links: look wider
                wide.append(part[full])
                a, k = np.nonzero((cos >= least - self._doubt) & ~full[:, None])
                near, b, a = cos[a, k], found[a, k], part[a]
                keep = self._exact(q, a, b, near, least)
                yield a[keep], b[keep]
            todo, beam = np.concatenate(wide), beam * 4

    def to_bytes(self) -> bytes:
        to = io.BytesIO()
        parts = {f"{k}{i}": getattr(layer, k).astype(np.int32) for i, layer in enumerate(self.layers) for k in ("nodes", "near")}
        np.savez(to, ids=self.ids, vectors=self.vectors, weights=self.weights, **parts)
        return to.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> ShardIndex:
        z = np.load(io.BytesIO(blob))
        layers = [Layer(z[f"nodes{i}"].astype(np.int64), z[f"near{i}"].astype(np.int64)) for i in range((len(z.files) - 3) // 2)]
        return cls(z["ids"], z["vectors"], layers, z["weights"])


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    # Scaled first, so that huge and tiny components neither overflow nor vanish.
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id reached) with the same components as the links (u, v)."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]


# ---------------------------------------------------------------------- Spark
def vector_classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(members: id, class; classes: id, v, weight): equal vectors are one class, named
    by its smallest id; its weight is the number of its ids.

    Null, zero and empty vectors and ones with null or non-finite components are left
    out, so are rows without an id.  Counting is by partial aggregates, so a vector
    with a third of all rows gathers nowhere.
    """
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = good.where(fits).withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")))
    rows = materialise(good, "vectors")
    keyed = materialise(rows.groupBy("h", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("weight")), "vector-classes")
    members = rows.select("h", "id").join(keyed, "h").select("id", "class", "weight").distinct()
    classes = rows.join(keyed, "h").where(F.col("id") == F.col("class")).select("id", "v", "weight").dropDuplicates(["id", "v"])
    return materialise(members, "members"), classes


def near_vectors(classes: DataFrame, least: float = COSINE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links by class and task: id, n; edges: u, v; audits by task: true links seen, of
    them hit) of ``vector_classes``.

    A link counts for both its classes, for each as often as the other has ids.  Vectors
    of different lengths never link: a shard holds one length.
    """
    good = materialise(classes.withColumn("d", F.size("v")), "class-vectors")
    # Of a vector: itself, its unit vector in single precision, its neighbours.
    number = 4 if good.schema["v"].dataType.elementType.simpleString() == "float" else 8
    size = good.agg(F.sum(F.col("d") * (number + 4) + 5 * 2 * DEGREE).alias("bytes")).first()["bytes"] or 0
    shards = max(SHARDS, -(-size // SHARD_BYTES))
    good = good.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        index = ShardIndex(pdf["id"].to_numpy(), np.stack(pdf["v"].to_list()), weights=pdf["weight"].to_numpy())
        return pd.DataFrame({"d": [key[0]], "shard": [key[1]], "index": [index.to_bytes()]})

    # An index fits one task: about SHARD_BYTES, dealt by hash.
    built = materialise(good.groupBy("d", "shard").applyInPandas(build, "d int, shard int, index binary"), "hnsw")
    # Every pair of shards once; which of the two is asked takes turns, so that each index
    # goes to about half of the others.
    names = built.select("d", "shard")  # two numbers a shard
    pairs = names.withColumnRenamed("shard", "i").join(names.withColumnRenamed("shard", "j"), "d").where("i <= j")
    turned = (F.col("i") + F.col("j")) % 2 == 1
    pairs = materialise(pairs.select("d", F.when(turned, F.col("j")).otherwise(F.col("i")).alias("of"), F.when(turned, F.col("i")).otherwise(F.col("j")).alias("by")), "shard-pairs")
    asked = good.join(pairs.withColumnRenamed("by", "shard"), ["d", "shard"]).select("d", "of", F.col("shard").alias("by"), "id", "v", "weight")
    served = built.join(pairs.withColumnRenamed("of", "shard"), ["d", "shard"]).select("d", F.col("shard").alias("of"), "by", "index")

    def ask(key: tuple, queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "n", "u", "v", "seen", "hit"]
        if not len(queries) or not len(index):
            return pd.DataFrame({c: [] for c in columns})
        shard = ShardIndex.from_bytes(index["index"].iloc[0])
        del index
        ids, weights = queries["id"].to_numpy(), queries["weight"].to_numpy()
        n, m = np.zeros(len(ids), np.int64), np.zeros(len(shard.ids), np.int64)
        edges, kept, seen, hit = [], 0, 0, 0
        for a, b, s, h in shard.links(_unit(np.stack(queries["v"].to_list())), least, ids if key[1] == key[2] else None):
            seen, hit = seen + s, hit + h
            if not len(a):
                continue
            n += np.bincount(a, weights=shard.weights[b], minlength=len(n)).astype(np.int64)
            m += np.bincount(b, weights=weights[a], minlength=len(m)).astype(np.int64)
            edges.append(_spanning(ids[a], shard.ids[b]))
            kept += len(edges[-1][0])
            if kept > EDGES:
                edges = [_spanning(*(np.concatenate(x) for x in zip(*edges, strict=True)))]
                kept = len(edges[0][0])
        u, v = _spanning(*(np.concatenate(x) for x in zip(*edges, strict=True))) if edges else (ids[:0], ids[:0])
        rows = [pd.DataFrame({"id": i[k > 0], "n": k[k > 0]}) for i, k in ((ids, n), (shard.ids, m))]
        rows += [pd.DataFrame({"u": u, "v": v}), pd.DataFrame({"seen": [seen], "hit": [hit]})]
        return pd.concat([r.reindex(columns=columns).astype("Int64") for r in rows])

    got = asked.groupBy("d", "of", "by").cogroup(served.groupBy("d", "of", "by")).applyInPandas(ask, "id long, n long, u long, v long, seen long, hit long")
    got = materialise(got, "links")
    return got.where("id is not null").select("id", "n"), got.where("u is not null").select("u", "v"), got.where("seen is not null").select("seen", "hit")


def audited_recall(audits: DataFrame) -> tuple[float, int]:
    """Recall over the audited true links of all tasks, and their number."""
    seen, hit = audits.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("hit"), F.lit(0))).first()
    return (hit / seen if seen else 1.0), seen


def dedup_vectors(vectors: DataFrame, least: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows without an id have no links and null component.  Repeated rows are each
    returned with their id's links, which don't count them.  An id should name one
    vector; one that names several ties them, and their links are taken together.
    """
    members, classes = vector_classes(vectors, id_col, vec_col)
    links, edges, audits = near_vectors(classes, least)
    recall, seen = audited_recall(audits)
    _log.log(logging.INFO if recall >= 0.9 else logging.WARNING, "recall %.4f over %d audited links", recall, seen)
    counts = materialise(links.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "class"), "link-counts")
    # An id with several vectors ties their classes together.
    tied = members.groupBy("id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("id")
    edges = edges.union(members.join(tied, "id", "left_semi").select(F.col("id").alias("u"), F.col("class").alias("v")))
    parts = materialise(connected_components(edges), "class-components")
    own = members.join(counts, "class", "left").join(parts.withColumnRenamed("id", "class"), "class", "left")
    own = own.select("id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "class").alias("component"))
    own = materialise(own.groupBy("id").agg(F.sum("n").alias("n"), F.min("component").alias("component")), "vector-links")
    out = vectors.select(F.col(id_col).cast("long").alias("id")).join(own, "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("component", "id") == F.col("id")).alias("kept"),
    )
