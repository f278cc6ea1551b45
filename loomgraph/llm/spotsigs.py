"""Document fingerprints: SpotSigs.

A signature is a chain: a common word (anchor) and the next ``CHAIN`` words that
are not common.  Boilerplate such as menus has few anchors, so signatures follow
the prose.  A text's fingerprint is the size of its signature set and the set's
``SKETCH`` smallest 40-bit hashes, sorted, in hexadecimal.  Sets up to that size
are whole, so their likeness is their exact Jaccard; larger ones are estimated
from the smallest hashes of the union.

A text of any length also takes chains of neighbouring words at every word, under
their own tag, and one with too few words for that the hash of all its words; an empty
text has none.  Two
texts without signatures are alike (1.0) and unlike all others (0.0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, hash_words, mix64, runs, text_slices, word_hashes, word_spans
from .ordering import NO_ID, range_bounds, slices_of

CHAIN = 2
SKETCH = 256
_BITS = 40
#: Tag of chains at every word.
_PLAIN = np.uint64(0xD6E8FEB86659FD93)

#: Anchors, the commonest words of the four languages.
ANCHORS = (
    "a an and are as at be by for from had has he in is it not of on or that the this to was were with you "
    "le la les de des du et en un une que qui dans pour par sur au aux est pas avec "
    "der die das und zu den von mit ist im nicht ein eine auf für dem sich als auch "
    "el los las y del se por con no su para es al lo como más"
).split()

_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_anchor_hashes = np.sort(hash_words([w.encode() for w in ANCHORS]))


def signature_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct signatures (below 2**40) of each text."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets, _BREAK)
    n = len(offsets) - 1
    words = word_hashes(low, starts, ends)
    at = runs(rows, n)
    place = np.searchsorted(_anchor_hashes, words)
    common = _anchor_hashes[np.minimum(place, len(_anchor_hashes) - 1)] == words
    content = np.flatnonzero(~common)
    where = np.searchsorted(content, np.arange(len(words)), "right")  # first content word after each word
    last = np.searchsorted(content, at[1:])  # end of each row's content words
    chained = common & (where + CHAIN <= last[rows]) if len(words) else np.zeros(0, bool)
    sig = words * np.uint64(0x9E3779B97F4A7C15)
    for k in range(CHAIN):
        if len(content):
            sig += mix64(words[content[np.minimum(where + k, len(content) - 1)]] + np.uint64(k + 1))
    sig = mix64(sig) >> np.uint64(64 - _BITS)
    # Chains of neighbouring words, for texts with few anchors.
    plain = words.copy()
    for k in range(1, CHAIN + 1):
        plain[: max(0, len(words) - k)] += mix64(words[k:] + np.uint64(k + 1))
    plain = mix64(plain ^ _PLAIN) >> np.uint64(64 - _BITS)
    out = []
    for r in range(n):
        s, e = at[r], at[r + 1]
        own = sig[s:e][chained[s:e]]
        if e > s:
            own = np.concatenate([own, plain[s : e - CHAIN]]) if e - s > CHAIN else mix64(words[s:e].cumsum(dtype=np.uint64)[-1:]) >> np.uint64(64 - _BITS)
        out.append(np.unique(own))
    return out


def fingerprint(signatures: np.ndarray) -> str:
    return f"{len(signatures)}:" + "".join(f"{int(x):010x}" for x in signatures[:SKETCH])


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two signature sets as their fingerprints tell it.

    Pruned: sets whose sizes alone keep them below ``least`` give 0.0 unread."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    x, y = a[:SKETCH], b[:SKETCH]
    if len(a) <= SKETCH and len(b) <= SKETCH:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(a) + len(b) - both)
    union = np.union1d(x, y)[:SKETCH]
    both = np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True)
    return len(both) / len(union)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_signatures, signatures array<long> (the sketch), fingerprint) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                sets = signature_sets(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:SKETCH].astype(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([fingerprint(s) for s in sets])],
                    names=["id", "n_signatures", "signatures", "fingerprint"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(scan, "id long, n_signatures long, signatures array<long>, fingerprint string")


def similar_documents(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(u, v, likeness): representatives of different fingerprints at least ``least`` alike.

    Fingerprints are partitioned by set length into bands of ratio ``least``; a pair
    lies in one band or two neighbouring ones, and must share one of the first
    signatures that a likeness this high leaves no way to miss.  Equal fingerprints
    are one class, met through its smallest id.
    """
    one = prints.where("n_signatures > 0").groupBy("fingerprint").agg(F.min("id").alias("id"), F.first("n_signatures").alias("n"), F.first("signatures").alias("s"))
    band = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(least)))
    prefix = F.size("s") - F.ceil(F.size("s") * least).cast("int") + 1
    rows = one.withColumn("band", band).withColumn("key", F.explode(F.slice("s", F.lit(1), F.greatest(prefix, F.lit(1)))))
    held = rows.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("s").alias("su"), "band", "key")
    asks = rows.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("s").alias("sv"), F.explode(F.array("band", F.col("band") + 1)).alias("band"), "key")
    met = held.join(asks, ["band", "key"]).where("u <> v and least(nu, nv) >= %r * greatest(nu, nv)" % least)
    met = met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.when(F.col("u") > F.col("v"), F.col("su")).otherwise(F.col("sv")).alias("a"), F.when(F.col("u") > F.col("v"), F.col("sv")).otherwise(F.col("su")).alias("b")).dropDuplicates(["u", "v"])
    union = F.slice(F.array_sort(F.array_union("a", "b")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("a", "b"), union))
    return met.select("u", "v", (shared / F.size(union)).alias("likeness")).where(F.col("likeness") >= least)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last third (rounded down) of the code points replaced by
    as many first ones of the next document in descending id order; the last one's
    next is the first.  Null texts are empty; rows without an id come last; rows with
    equal ids follow by text, descending.  A single document is its own next.

    One shuffle of the texts: rows go to contiguous id slices, the first document of
    each slice also to the slice before it in this order, as a guest.
    """
    slices = slices_of(docs)
    low, high = range_bounds(docs, id_col, slices)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).fill_null(NO_ID).to_numpy()
            part = np.searchsorted(low, key, "right") - 1
            names = ["slice", "guest", "k", "id", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.zeros(len(key), np.int8)), pa.array(key), batch.column(0), batch.column(1)], names=names)
            first = np.flatnonzero(key == high[part])
            if len(first):
                guests = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array((part[first] + 1) % len(low), pa.int32()), pa.array(np.ones(len(first), np.int8)), pa.array(key[first]), guests.column(0), guests.column(1)], names=names)

    placed = rows.mapInArrow(place, "slice int, guest byte, k long, id long, text string")
    placed = placed.repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "guest", F.desc("k"), F.desc("text"))

    def work(ids: list, texts: list[str], count: int) -> pa.RecordBatch:
        """Results of the first ``count`` rows; each row's next follows it."""
        own = signature_sets(*_flat(texts))
        edited = [t[: len(t) - (k := len(t) // 3)] + texts[i + 1][:k] for i, t in enumerate(texts[:count])]
        new = signature_sets(*_flat(edited))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:count], pa.int64()),
                pa.array([len(t) for t in texts[:count]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([fingerprint(s) for s in own[:count]]),
                pa.array([fingerprint(s) for s in new]),
                pa.array([likeness(own[i], new[i]) for i in range(count)]),
                pa.array([likeness(own[i], own[i + 1]) for i in range(count)]),
            ],
            names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, part, done = [], [], 0, None, False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (0, 1, 3, 4)]
            for p, guest, i, text in zip(*columns, strict=True):
                if p != part:
                    ids, texts, size, part, done = [], [], 0, p, False
                if done:
                    continue
                ids.append(i), texts.append(text)
                size += len(text)
                done = bool(guest)
                if len(ids) > 1 and (done or size > CHUNK_BYTES):
                    yield work(ids, texts, len(ids) - 1)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return placed.mapInArrow(scan, schema)
