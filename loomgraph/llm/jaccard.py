"""N-gram Jaccard join: a count-vector R-tree over shingle sets.

Every document becomes the set of its distinct five-word shingles.  Two
documents link when ``100 * |A & B| >= threshold * |A | B|``.

1. *Copies first.*  Documents with the same set are one class; only one
   representative goes on, and copies get their class's answer by a join.
2. *Cells.*  A class meets others in the cells of its ``KEYS`` smallest shingle
   hashes that are not very common (all of them, if it has fewer).  Two sets with
   Jaccard at least 0.8 share none of them with a chance of about 0.4 ** KEYS (1e-8)
   at most: unshared shingles are a fifth of the union, and half of a pool may be
   passed over; sets of at most ``POOL`` shingles that link always share one.  Shingles of more than ``COMMON`` classes
   (boilerplate) are passed over unless they are over ``MOSTLY`` per cent of a document's pool.
3. *Points.*  Shingles are hashed into ``GROUPS`` groups and counted; the sum of the
   coordinate minima of two such points bounds the overlap of their sets.  Only pairs
   that this bound leaves are verified, exactly, by their sets.
4. *Pivots.*  In each cell every class meets a few pivots, linearly many pairs.  This
   alone gathers groups of copies, however large.
5. *R-tree.*  Where a cell still holds several components, an R-tree over its points
   finds the pairs.  Its boxes, level over level, keep the largest count of each group,
   so that the sum of minima of a point and a box bounds every overlap below it.  Cells over ``BLOCK`` classes are split
   by set size and into pairs of blocks, so no task gathers a whole cell, and blocks
   whose sizes are too far apart to link never meet.

Components of the links are found by alternating stars; nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, broadcast_if_small, materialise, shingle_hashes, text_slices, word_hashes, word_spans
from .components import connected_components

WIDTH = 5
THRESHOLD = 80
#: Smallest hashes looked at, and taken as cells, of each class.
POOL, KEYS = 40, 20
#: Classes from which on a shingle counts as common.
COMMON = 100
#: Per cent of a pool above which its common shingles are cells as well.  A set that links
#: through common shingles alone has four fifths of them, so 16 or fewer of a pool of 40
#: with a chance of 3.5e-8.
MOSTLY = 40
#: Orders by which pivots are chosen, told by the cell's key.
PIVOTS = 4
#: Hash groups of a count vector, points of a block, and children of a box.
GROUPS, BLOCK, LEAF = 256, 2_048, 8
#: Steps of set size: sets that link lie in one step or in neighbouring ones.
STEP = 1.25
#: Ids that may be broadcast to pick texts (8 bytes each, counted before).
BROADCAST_IDS = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; without words, empty."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets)
    n = len(offsets) - 1
    hashes, at = shingle_hashes(word_hashes(low, starts, ends), rows, n, width)
    out = []
    for r in range(n):
        a = np.sort(hashes[at[r] : at[r + 1]])
        out.append(a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a)
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def count_vector(shingles: np.ndarray) -> bytes:
    """How many shingles each group has: bytes, or 32-bit numbers where those don't fit."""
    counts = np.bincount((shingles % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def _points(vectors: pa.Array) -> np.ndarray:
    rows = [np.frombuffer(b, np.uint8 if len(b) == GROUPS else np.uint32) for b in vectors.to_pylist()]
    return np.stack(rows).astype(np.uint32) if rows else np.zeros((0, GROUPS), np.uint32)


def shingle_summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, digest of the set, its POOL smallest hashes, its count vector)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(a) for a in sets], pa.int64()),
                        pa.array([hashlib.md5(a.tobytes()).digest() for a in sets], pa.binary()),
                        _lists([a[:POOL] for a in sets]),
                        pa.array([count_vector(a) for a in sets], pa.binary()),
                    ],
                    names=["id", "n", "digest", "pool", "counts"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(scan, "id long, n long, digest binary, pool array<long>, counts binary")


def cells(classes: DataFrame) -> DataFrame:
    """(key, id, n, known): the cells in which a class (id, n, pool) meets others, and how
    often its pool's hashes are met in all: the more, the more central the class."""
    keyed = classes.select("id", "n", F.posexplode("pool").alias("pos", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = keyed.join(shared, "key").withColumn("common", (F.col("c") > COMMON).cast("int"))
    # A class has at most POOL rows here, so these windows stay small.
    by_class = Window.partitionBy("id")
    met = met.withColumn("before", F.coalesce(F.sum("common").over(by_class.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = met.withColumns({"all_common": F.sum("common").over(by_class), "known": F.sum("c").over(by_class)})
    rank = F.when(F.col("common") == 1, F.col("before")).otherwise(F.col("pos") - F.col("before"))
    mostly = F.col("all_common") * 100 > F.least("n", F.lit(POOL)) * MOSTLY
    return met.where((rank < KEYS) & ((F.col("common") == 0) | mostly)).select("key", "id", "n", "known")


def size_step(n: str = "n") -> Column:
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(STEP))).cast("long")


def shingles_of(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """(id, shingles) of the documents listed in ``wanted`` (id).

    ``rows`` is its counted size: up to BROADCAST_IDS ids, 8 bytes each, travel to the
    texts, beyond that texts and ids meet by a shuffle."""
    picked = docs.select("id", "text").join(broadcast_if_small(wanted.select("id"), rows, BROADCAST_IDS), "id").select("id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(shingle_sets(data, offsets))], names=["id", "shingles"])

    return picked.mapInArrow(scan, "id long, shingles array<long>")


def bounded(pairs: DataFrame, points: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) that the summed minima of their count vectors leave."""
    side = lambda c, to: points.select(F.col("id").alias(c), F.col("counts").alias(to))
    met = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _points(batch.column(2)), _points(batch.column(3))
            both, total = (x.sum(1, dtype=np.int64) for x in (np.minimum(a, b), a + b))
            keep = pa.array(both * 100 >= (total - both) * threshold)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["u", "v"])

    return met.mapInArrow(scan, "u long, v long")


def verify(docs: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) that link, by exact intersection of their shingle sets.

    Each document's set is made once and written.  Pairs meet the sets by two joins, row
    by row, so a class with many partners is gathered nowhere, and adaptive execution may
    split it."""
    pairs = materialise(pairs, "candidates")
    ids = materialise(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "candidate-ids")
    sets = materialise(shingles_of(docs, ids, ids.count()), "candidate-sets")
    a = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    both = F.size(F.array_intersect("a", "b"))
    met = a.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    return met.where(both * 100 >= (F.size("a") + F.size("b") - both) * threshold).select("u", "v").distinct()


# --------------------------------------------------------------------- R-tree
class CountTree:
    """R-tree over count vectors, packed by size and then by group counts.

    A box holds the largest count of each group, and the range of sizes, of up to ``LEAF``
    points or boxes below it; levels go up to a handful of boxes."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        self.order = np.lexsort((counts[:, 1 % counts.shape[1]], counts[:, 0], sizes)) if len(sizes) else np.zeros(0, int)
        self.levels = [(sizes[self.order], sizes[self.order], counts[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            low, high, box = self.levels[-1]
            cuts = np.arange(0, len(low), LEAF)
            self.levels.append((np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(box, cuts, axis=0)))

    def search(self, size: int, count: np.ndarray, threshold: int) -> np.ndarray:
        """Points that may link with a set of this size and these counts."""
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            low, high, box = (x[at] for x in self.levels[k])
            fits = (low * threshold <= size * 100) & (high * 100 >= size * threshold)
            at, low, box = at[fits], low[fits], box[fits]
            # Overlap o of sets n, m links if 100 o >= threshold (n + m - o); below a box m
            # is at least its smallest size, and at least what the threshold leaves.
            least = np.maximum(low, -(-size * threshold // 100))
            bound = np.minimum(box, count).sum(1, dtype=np.int64)
            at = at[bound * (100 + threshold) >= threshold * (size + least)]
            if k:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[k - 1][0])]
        return self.order[at]


def _tree_pairs(group: pa.Table, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    ids, comps = group.column("id").to_numpy(), group.column("component").to_numpy()
    sizes, side = group.column("n").to_numpy(), group.column("side").to_numpy()
    counts = _points(group.column("counts"))
    key = group.column("key")[0].as_py()
    cells_of = np.full((len(ids), POOL), np.iinfo(np.int64).max)
    for i, own in enumerate(group.column("keys").to_pylist()):
        cells_of[i, : len(own)] = own
    out_u, out_v = [], []
    one_block = not side.any()
    base = np.flatnonzero(side == 0)
    tree = CountTree(sizes[base], counts[base])
    for q in base if one_block else np.flatnonzero(side == 1):
        hit = base[tree.search(sizes[q], counts[q], threshold)]
        hit = hit[comps[hit] != comps[q]]
        before = cells_of[q][cells_of[q] < key]
        hit = hit[~np.isin(cells_of[hit], before).any(1)]
        if one_block:
            hit = hit[ids[hit] < ids[q]]
        out_u.append(np.full(len(hit), ids[q]))
        out_v.append(ids[hit])
    return (np.concatenate(out_u), np.concatenate(out_v)) if out_u else (np.zeros(0, np.int64),) * 2


def tree_candidates(points: DataFrame, met: DataFrame, threshold: int) -> DataFrame:
    """Pairs of different components that the R-tree of their cell lets pass, each in the
    first cell that both are in.

    ``points`` has (id, counts); ``met`` (key, id, n, component), cells with several
    components only."""
    # At most POOL cells a class.
    points = materialise(points.join(met.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys")), "id"), "placed-points")
    # Cells of one block stay whole; larger ones are split by step of size, then by hash.
    size = met.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    placed = met.join(size, "key").withColumn("level", F.when(F.col("c") <= BLOCK, 0).otherwise(size_step()))
    steps = materialise(placed.groupBy("key", "level").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")), "cell-steps")
    near = steps.withColumn("at", F.explode(F.array(*[F.col("level") + k for k in (-1, 0, 1)])))
    near = near.join(steps.select("key", F.col("level").alias("at"), F.col("blocks").alias("others")), ["key", "at"])
    code = lambda level, k: F.col(level) * (1 << 32) + F.col(k)
    dealt = (
        placed.join(near, ["key", "level"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
        .withColumns({"own": code("level", "own"), "other": code("at", "other")})
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "component")
    )
    dealt = dealt.join(points, "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                u, v = _tree_pairs(pa.Table.from_batches(held), threshold)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1), batch.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if (now := tuple(k[:, s])) != last:
                    yield from flush()
                    held, last = [], now
                held.append(batch.slice(s, e - s))
        yield from flush()

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(search, "u long, v long")


def jaccard_components(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Null and empty texts have no shingles and link with nothing; equal sets link
    whatever their texts.  A repeated row is returned as often as it comes.  Rows
    without an id keep a null component.  ``threshold`` is at least 80 per cent:
    below that the cells are no longer sure to meet.
    """
    if threshold < 80:
        raise ValueError("the cells are laid out for a threshold of at least 80")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = materialise(shingle_summaries(docs, id_col, text_col), "shingles")
    classes = materialise(found.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("pool").alias("pool"), F.first("counts").alias("counts")), "classes")
    met = materialise(cells(classes), "cells")
    # Pivots: of each cell and size class, the most central class, which links with most
    # of a group of near copies, and the one that comes first in one of a few orders.
    placed = met.withColumn("level", size_step())
    order = F.struct(F.xxhash64("id", F.pmod("key", F.lit(PIVOTS))), F.col("id"), F.col("n"))
    centre = F.struct("known", "id", "n")
    pivots = placed.groupBy("key", "level").agg(F.min(order).alias("p"), F.max(centre).alias("q"))
    one = lambda p: F.struct(p["id"].alias("v"), p["n"].alias("m"))
    pivots = pivots.select("key", "level", F.inline(F.array_distinct(F.array(one(F.col("p")), one(F.col("q"))))))
    # Sets that link lie in one size class or in neighbouring ones.
    pivots = materialise(pivots.select("key", F.explode(F.array(*[F.col("level") + k for k in (-1, 0, 1)])).alias("level"), "v", "m"), "pivots")
    pairs = placed.join(pivots, ["key", "level"]).where((F.col("id") != F.col("v")) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * threshold)).select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v")).distinct()
    points = classes.select("id", "counts")
    links = materialise(verify(texts, bounded(pairs, points, threshold), threshold), "pivot-links")
    parts = connected_components(links)
    # Cells that still hold several components.
    parts = materialise(parts, "pivot-components")
    known = materialise(met.join(parts, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component")), "known")
    open_cells = materialise(known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "open-cells")
    rest = verify(texts, tree_candidates(points, known.join(open_cells, "key"), threshold), threshold)
    parts = materialise(connected_components(links.union(rest)), "components")
    by_set = materialise(classes.select("digest", "id").join(parts, "id", "left").select("digest", F.coalesce("component", "id").alias("class_component")), "sets")
    out = found.join(by_set, "digest", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("class_component"))).otherwise(F.col("id")).alias("component_id"),
    )
