"""Packing: shortest-pack-first over the length histogram.

Documents become token ids with an end id and are cut into pieces of at most the
sequence length.  Only the histogram of piece lengths (one count per length) is
planned on the driver: lengths are placed longest first, each into the pack that is
shortest so far among those with room, as counts of packing patterns.  Every piece
then finds its place by its rank among pieces of its length.  Ranks come from counts
by (length, bucket) and from row numbers within those small buckets, so no length
gathers in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh_name, materialise, quoted
from .segments import ByteLevelIds

LENGTH = 1024
END_ID = 0
#: Pieces of a ranking bucket, about.
BUCKET = 50_000

_tokenizers: dict[tuple[str, str], ByteLevelIds] = {}


def _tokenizer(path: str, ranks: str) -> ByteLevelIds:
    if (path, ranks) not in _tokenizers:
        _tokenizers[path, ranks] = ByteLevelIds(path, ranks)
    return _tokenizers[path, ranks]


def cut_pieces(docs: DataFrame, path: str, ranks: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc, row, start, length, ids_crc32, doc_tokens[, ids]) of every piece.

    Null and empty texts are one piece, the end id alone.  ``row`` tells rows with the
    same document id apart."""
    extra = ", ids array<int>" * ids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path, ranks)
        for batch in batches:
            docs_, rows, start, size, crc, total, own = [], [], [], [], [], [], []

            def flush() -> pa.RecordBatch:
                columns = [pa.array(docs_, pa.int64()), pa.array(rows, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
                if ids:
                    columns.append(pa.array(own, pa.list_(pa.int32())))
                out = pa.RecordBatch.from_arrays(columns, names=["doc", "row", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids])
                for x in (docs_, rows, start, size, crc, total, own):
                    x.clear()
                return out

            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                got = encode(text) if text else np.zeros(0, "<u4")
                n = len(got) + 1
                raw = got.tobytes() + END_ID.to_bytes(4, "little")
                for at in range(0, n, length):
                    k = min(length, n - at)
                    docs_.append(doc), rows.append(row), start.append(at), size.append(k), total.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + k)]))
                    if ids:
                        own.append(np.frombuffer(raw[4 * at : 4 * (at + k)], "<u4").astype(np.int32))
                if len(docs_) > 20_000:
                    yield flush()
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc long, row long, start long, length int, ids_crc32 long, doc_tokens long{extra}")


@dataclass
class Plan:
    """Slots of pieces: those of one length with ranks from ``rank`` on go to the
    sequences from ``sequence`` on, at ``offset``.  Ordered by length and rank."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    sequences: int


def plan_packing(histogram: dict[int, int], cap: int = LENGTH) -> Plan:
    """Shortest-pack-first over counts of lengths 1..cap."""
    # Packs by their free room: (how many, their lengths in order).
    room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(cap + 1)]
    for length in range(cap, 0, -1):
        left = histogram.get(length, 0)
        free = cap  # the shortest packs have the most room
        while left:
            while free >= length and not room[free]:
                free -= 1
            if free < length:
                room[cap - length].append((left, (length,)))
                break
            count, pattern = room[free].pop()
            taken = min(count, left)
            if count > taken:
                room[free].append((count - taken, pattern))
            room[free - length].append((taken, (*pattern, length)))
            left -= taken
    slots, sequence = [], 0
    rank = dict.fromkeys(histogram, 0)
    for free in range(cap + 1):
        for count, pattern in room[free]:
            offset = 0
            for length in pattern:
                slots.append((length, rank[length], sequence, offset, cap - free))
                rank[length] += count
                offset += length
            sequence += count
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequence)


def pack_pieces(pieces: DataFrame, cap: int = LENGTH) -> DataFrame:
    """``pieces`` with sequence_id, offset, sequence_tokens and padded_length.

    A sequence whose tokens are a power of two is left at that length; others are
    padded to ``cap``.  ``pieces`` must be a written table, read alike each time, with
    the columns of ``cut_pieces``; further ones are kept, but none of the new names.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(counts, cap)
    buckets = max(1, -(-sum(counts.values()) // BUCKET))
    bucket, within, base, rank_, n = (fresh_name(x, pieces.columns) for x in ("bucket", "within", "base", "rank", "n"))
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64("row", "start"), F.lit(buckets)).cast("int"))
    # Where each bucket's ranks begin: at most cap x buckets small rows, by length.
    sizes = dealt.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialise(sizes.select("length", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base)), "ranks")
    numbered = dealt.withColumn(within, F.row_number().over(Window.partitionBy("length", bucket).orderBy("doc", "row", "start")) - 1)
    ranked = numbered.join(sizes, ["length", bucket]).withColumn(rank_, F.col(base) + F.col(within))
    keep = [f for f in pieces.schema.fields]
    key = plan.length << 40 | plan.rank
    sequence, offset, used, first = plan.sequence, plan.offset, plan.used, plan.rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy()
            length = batch.column(batch.schema.get_field_index("length")).to_numpy().astype(np.int64)
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            tokens = used[at]
            padded = np.where(tokens & (tokens - 1), cap, tokens)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at]), pa.array(tokens), pa.array(padded)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset", "sequence_tokens", "padded_length"],
            )

    new = [StructField(c, LongType()) for c in ("sequence_id", "offset", "sequence_tokens", "padded_length")]
    return ranked.select(*[quoted(f.name) for f in keep], rank_).mapInArrow(place, StructType([*keep, *new]))


def pack_documents(docs: DataFrame, path: str, ranks: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Pieces of all documents in packed sequences; with ``ids`` also their tokens.

    Null and empty texts are a piece of the end id alone.  Repeated rows, and rows without
    an id, are packed each by itself; pieces of equal length take their places by id, row
    and start."""
    pieces = materialise(cut_pieces(docs, path, ranks, length, id_col, text_col, ids), "pieces")
    packed = pack_pieces(pieces, length)
    named = packed.withColumnRenamed("doc", id_col).withColumn("length", F.col("length").cast("long"))
    return named.drop("row")
