"""Token-ID files: static range asymmetric numeral system.

A file holds documents in ascending id order.  Its symbols share one frequency
table, counted over all tokens of the file.  Tokens are cut into independent blocks;
a block's tokens are dealt in turn to interleaved lanes, each a coder of its own, so
that one array operation advances all lanes of all blocks.  Checkpoints (the place
and states of each block) and checksums let any block be decoded on its own.

Layout, little-endian: magic, header length, crc32 of the header, header, lane words.
The header holds counts, the frequency table, document ids and lengths, and for each
block its lanes' end states and word counts, and the crc32 of its ids.  All parts of
the header are zlib streams.  The writer ends a file with a line end, which readers
ignore.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, materialise, new_path
from .ordering import NO_ID, range_bounds, slices_of
from .segments import SpaceSegments, library_segments

END_ID = 1
MAGIC = b"LMRANS1\n"
#: Bits of the frequency scale; tokens of a block; lanes of a block; tokens of a file, about.
SCALE_BITS, BLOCK, LANES, FILE_TOKENS = 20, 32_768, 32, 2_000_000
_LOW = np.uint64(1 << 31)
_U = np.uint64


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS, at least 1 for each symbol seen."""
    total, scale = counts.sum(), 1 << SCALE_BITS
    seen = counts > 0
    f = np.where(seen, np.maximum(1, np.floor(counts * (scale / total))), 0).astype(np.int64)
    while (left := scale - f.sum()) != 0:
        if left > 0:
            f[np.argmax(counts)] += left
        else:
            # Takes from the largest, never below one.
            for k in np.argsort(-f)[: max(1, -left)]:
                take = min(f[k] - 1, -left)
                f[k] -= take
                left += take
                if not left:
                    break
    return f


def _pad(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, lanes of all blocks) symbols, and the number of steps of each lane."""
    blocks = max(1, -(-len(ids) // BLOCK))
    steps = BLOCK // LANES
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[: len(ids)] = ids
    fill = np.zeros(blocks * BLOCK, bool)
    fill[: len(ids)] = True
    count = fill.reshape(blocks, steps, LANES).sum(1).ravel()
    return grid.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, -1), count


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, each id's place among them, and how often each comes."""
    if not len(ids) or ids.max() >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    return (seen := np.flatnonzero(counts)), (np.cumsum(counts > 0) - 1)[ids], counts[seen]


def encode(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray) -> bytes:
    """A file of the documents' ids, concatenated in ``ids``."""
    symbols, dense, counts = _dense(ids)
    freq = quantise(counts) if len(symbols) else np.zeros(0, np.int64)
    start = np.concatenate(([0], np.cumsum(freq)[:-1])) if len(symbols) else freq
    grid, count = _pad(dense)
    steps = int(count.max(initial=0))
    lanes, whole = grid.shape[1], int(count.min(initial=BLOCK))
    state = np.full(lanes, _LOW)
    f_of, c_of = freq.astype(_U), start.astype(_U)
    # A row a step: the lanes' low halves, and which of them leave their lane.
    halves, leave = np.zeros((steps, lanes), np.uint32), np.zeros((steps, lanes), bool)
    for row, t in enumerate(range(steps - 1, -1, -1)):
        live = slice(None) if t < whole else np.flatnonzero(count > t)
        s = grid[t, live]
        f, x = f_of[s], state[live]
        full = x >= f << _U(63 - SCALE_BITS)
        halves[row, live], leave[row, live] = x & _U(0xFFFFFFFF), full
        x = np.where(full, x >> _U(32), x)
        # (x // f << SCALE_BITS) + x % f + c, with one division.
        state[live] = x + x // f * (_U(1 << SCALE_BITS) - f) + c_of[s]
    words, used = halves.T[leave.T], leave.sum(0)
    check = [zlib.crc32(ids[at : at + BLOCK].astype("<u4").tobytes()) for at in range(0, max(1, len(ids)), BLOCK)]
    parts = [
        np.array([len(ids), len(docs), len(symbols), SCALE_BITS, BLOCK, LANES], "<i8"), symbols.astype("<u4"), freq.astype("<u4"),
        docs.astype("<i8"), lengths.astype("<u4"), state.astype("<u8"), used.astype("<u4"), np.array(check, "<u4"),
    ]
    packed = [zlib.compress(p.tobytes(), 6) for p in parts]
    header = b"".join(struct.pack("<I", len(p)) + p for p in packed)
    return MAGIC + struct.pack("<II", len(header), zlib.crc32(header)) + header + words.astype("<u4").tobytes()


class TokenFile:
    """A file's header; blocks are decoded on demand."""

    def __init__(self, blob: bytes):
        size, crc = struct.unpack_from("<II", blob, len(MAGIC))
        at = len(MAGIC) + 8
        header = blob[at : at + size]
        if blob[: len(MAGIC)] != MAGIC or zlib.crc32(header) != crc:
            raise ValueError("not a token file, or its header is damaged")
        parts, k = [], 0
        for kind in ("<i8", "<u4", "<u4", "<i8", "<u4", "<u8", "<u4", "<u4"):
            (n,) = struct.unpack_from("<I", header, k)
            parts.append(np.frombuffer(zlib.decompress(header[k + 4 : k + 4 + n]), kind))
            k += 4 + n
        (self.n, _, _, self.bits, self.block, self.lanes), self.symbols, self.freq, self.docs, self.lengths, self.states, used, self.check = parts
        self.word_end = np.cumsum(used.astype(np.int64))
        self.word_start = self.word_end - used
        self.words = np.frombuffer(blob, "<u4", int(used.sum()), at + size)
        self.start = np.concatenate(([0], np.cumsum(self.freq.astype(np.int64))[:-1])) if len(self.freq) else self.freq.astype(np.int64)
        self.slot = np.repeat(np.arange(len(self.freq)), self.freq)

    @property
    def blocks(self) -> int:
        return len(self.check)

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the blocks [first, last), checked against their checksums."""
        last = self.blocks if last is None else last
        lo, hi = first * self.block, min(self.n, last * self.block)
        size = np.clip(hi - np.arange(first, last) * self.block, 0, self.block)
        lane = np.arange(self.lanes)
        count = ((size[:, None] - lane[None] + self.lanes - 1) // self.lanes).ravel()
        pick = slice(first * self.lanes, last * self.lanes)
        state, at = self.states[pick].copy(), self.word_end[pick] - 1
        steps = self.block // self.lanes
        grid = np.zeros((steps, len(state)), np.int64)
        mask, bits = _U((1 << int(self.bits)) - 1), _U(int(self.bits))
        freq, start = self.freq.astype(_U), self.start.astype(_U)
        all_lanes, whole = np.arange(len(state)), int(count.min(initial=self.block))
        for t in range(int(count.max(initial=0))):
            live = all_lanes if t < whole else np.flatnonzero(count > t)
            x = state[live]
            low = x & mask
            s = self.slot[low.astype(np.int64)]
            grid[t, live] = s
            x = freq[s] * (x >> bits) + low - start[s]
            need = x < _LOW
            w = live[need]
            x[need] = x[need] << _U(32) | self.words[at[w]]
            at[w] -= 1
            state[live] = x
        blocks = last - first
        dense = grid.reshape(steps, blocks, self.lanes).transpose(1, 0, 2).reshape(-1)
        ids = self.symbols[dense[: hi - lo]] if self.n else np.zeros(0, "<u4")
        for k in range(blocks):
            if zlib.crc32(ids[k * self.block : (k + 1) * self.block].astype("<u4").tobytes()) != self.check[first + k]:
                raise ValueError(f"block {first + k} fails its checksum")
        return ids


# ---------------------------------------------------------------------- Spark
_encoders: dict[str, SpaceSegments] = {}


def _segments(path: str) -> SpaceSegments:
    if path not in _encoders:
        _encoders[path] = library_segments(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all documents and writes token files in ascending id order to ``out``.

    One shuffle of the texts, into contiguous id slices; file names follow the order.
    Null texts are empty; rows without an id come first; equal ids follow by text.
    """
    slices = slices_of(docs)
    low, _ = range_bounds(docs, id_col, slices)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds = low

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).fill_null(NO_ID).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, key, "right") - 1, pa.int32()), pa.array(key), batch.column(1)], names=["slice", "k", "text"])

    ordered = rows.mapInArrow(deal, "slice int, k long, text string").repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "k", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _segments(path)
        end = np.array([END_ID], "<u4").tobytes()
        ids, keys, lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(ids), "<u4")
            blob = encode(raw, np.array(keys, np.int64), np.array(lengths, np.int64))
            ids.clear(), keys.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

        for batch in batches:
            own, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK_BYTES):
                    size += len(texts[hi])
                    hi += 1
                for k, parts in zip(own[lo:hi], segments.look_up(texts[lo:hi]), strict=True):
                    raw = b"".join(parts) + end
                    ids.append(raw), keys.append(k), lengths.append(len(raw) // 4)
                    held += len(raw) // 4
                    if held >= FILE_TOKENS:
                        yield flush()
                        held = 0
                lo = hi
        if ids:
            yield flush()

    blobs = ordered.mapInArrow(pack, "blob binary")
    # One file a row; the text writer copies a value's bytes as they are.
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(out)


def read_token_files(spark, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) read back from token files."""
    files = spark.read.format("binaryFile").load(folder).where(F.col("length") > 0).select("path", "content")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(blob)
                raw = file.decode().astype("<u4").tobytes()
                ends = np.cumsum(file.lengths.astype(np.int64))
                starts = ends - file.lengths
                columns = [
                    pa.array([name] * len(ends)), pa.array([None if k == NO_ID else k for k in file.docs.tolist()], pa.int64()), pa.array(starts), pa.array(file.lengths.astype(np.int64)),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([np.frombuffer(raw[4 * a : 4 * b], "<u4").astype(np.int32) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "at", "n_tokens", "ids_crc32", *["ids"] * ids])

    rows = files.mapInArrow(scan, "file string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    # Files follow the order by task and place; a row a file gives where each begins.
    totals = files.mapInArrow(_file_totals, "file string, tokens long")
    before = Window.orderBy(*file_order()).rowsBetween(Window.unboundedPreceding, -1)
    begins = materialise(totals.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("begin")), "file-starts")
    out = rows.join(begins, "file")
    return out.select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def file_order(file: str = "file") -> list[Column]:
    """Task and place of a written file, as numbers: their digits may grow in number."""
    name = F.element_at(F.split(F.col(file), "/"), -1)
    return [F.regexp_extract(name, p, 1).cast("long") for p in (r"^part-(\d+)", r"-c(\d+)")] + [name]


def _file_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0)
        totals = [int(TokenFile(b).n) for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([names, pa.array(totals, pa.int64())], names=["file", "tokens"])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes token files for all documents and reads them back."""
    out = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, out, path, id_col, text_col)
    return read_token_files(docs.sparkSession, out)
