"""Shared plumbing: durable intermediate tables and vectorised text scans.

Text is scanned as UTF-8 bytes in bounded slices, so a task holds a few
megabytes of work space whatever the partition size.  Words are maximal runs
of bytes other than space and ``\\x09-\\x0d``.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 1 << 20
#: Bytes of a word from which on it is hashed by itself.
LONG_WORD = 512

_U = np.uint64
#: Odd base of the polynomial word hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


#: Rows of an Arrow batch between Spark and Python, where the session has Spark's own
#: default: whole texts are long, and both sides hold a batch or two for each core.
BATCH_ROWS, _DEFAULT_ROWS = 1_000, "10000"


# --------------------------------------------------------------------- tables
def bound_batches(spark: SparkSession) -> None:
    """Makes Arrow batches small in sessions that leave their size at the default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset in a local
    session (tests) a temporary folder is made once and set on the context.  On a cluster
    that is an error: no other machine could read such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage durably: a lost executor re-reads files, it does not recompute
    the stages above.
    """
    bound_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column has it, in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def with_text(docs: DataFrame, text_col: str, new: list[str]) -> tuple[DataFrame, list[StructField]]:
    """``docs`` without columns of the names ``new``, under names of their places, with the
    text as the last column; and the fields that the places stand for.  (Functions over
    Arrow batches can't be given columns with dots and backticks in their names.)"""
    gone = {c.lower() for c in new}
    keep = [f for f in docs.schema.fields if f.name.lower() not in gone]
    places = [F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(keep)]
    return docs.select(*places, F.col(quoted(text_col)).cast("string").alias("text")), keep


def quoted(name: str) -> str:
    """A column's name between backticks, for names with dots and backticks too."""
    return "`" + name.replace("`", "``") + "`"


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Mark ``df`` for broadcast only when its counted rows are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def training_rows(labels: DataFrame, label: str, split: int, folds: int, bound: int | None = None) -> DataFrame:
    """Labelled ids (doc_id, label) outside the held-out fold: all, or at most ``bound``.

    The held-out fold is ``crc32(doc_id as text) mod folds = split``.  With a bound rows are
    taken in hash order, so the sample is the same on every run; ``bound`` is
    the documented limit on what a classifier is fitted on.
    """
    key = F.crc32(F.col("doc_id").cast("string"))
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(F.pmod(key, F.lit(folds)) != split)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    return rows if bound is None else rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


# ------------------------------------------------------------- Arrow batches
def text_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of at most ``limit`` bytes.

    Yields (first row, end row, bytes, offsets).  A single longer text makes a
    run of its own.  Null texts are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def rows_as_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


# ----------------------------------------------------------------- word scans
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit words."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, size: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < size:
        size = max(size, CHUNK_BYTES + 1)
        base = np.full(size, _BASE if kind == "up" else _BASE_INV, _U)
        base[0] = 1
        have = np.cumprod(base, dtype=_U)
        if size <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word.  Words never cross rows."""
    space = (_SPACE if breaks is None else breaks)[data]
    before = np.ones(len(data) + 1, bool)
    before[1:] = space
    cuts = offsets[:-1]
    cuts = cuts[cuts < len(data)]
    first = before[:-1].copy()
    first[cuts] = True
    starts = np.flatnonzero(~space & first)
    after = np.ones(len(data) + 1, bool)
    after[:-1] = space
    last = after[1:].copy()
    ends_at = offsets[1:] - 1
    ends_at = ends_at[ends_at >= 0]
    last[ends_at[ends_at < len(data)]] = True
    ends = np.flatnonzero(~space & last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end]: a polynomial over random byte
    codes, divided by the power at its start, then finalised.  Words of ``LONG_WORD``
    bytes on, where polynomials modulo 2**64 have collisions whatever the codes (Thue-Morse
    words), are hashed one by one."""
    n = len(data)
    up = _power_table("up", n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE_CODE[data] * up[:n], out=total[1:])
    raw = (total[ends] - total[starts]) * _power_table("down", n + 1)[starts]
    out = mix64(raw + (ends - starts).astype(_U))
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def hash_words(words: list[bytes]) -> np.ndarray:
    """word_hashes() of single words, for lists such as anchors."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def runs(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets of each row's words in arrays ordered by row."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words, with offsets by row.

    A row with fewer words, but at least one, has one shingle: all its words.
    """
    at = runs(rows, n_rows)
    count = np.diff(at)
    mult = [_U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(width)]
    full = np.zeros(len(hashes), _U)
    if len(hashes) >= width:
        body = full[: len(hashes) - width + 1]
        for k in range(width):
            body += hashes[k : len(hashes) - width + 1 + k] * mult[k]
    have = np.maximum(count - width + 1, 0)
    keep = np.zeros(len(hashes), bool)
    pos = np.arange(len(hashes)) - at[rows] if len(hashes) else np.zeros(0, np.int64)
    keep[:] = pos < have[rows]
    for r in np.flatnonzero((count > 0) & (count < width)):
        s = at[r]
        value = _U(0)
        with np.errstate(over="ignore"):
            for k in range(count[r]):
                value += hashes[s + k] * mult[k]
            full[s] = value + _U(count[r])
        keep[s] = True
    out_rows = rows[keep]
    return mix64(full[keep]), runs(out_rows, n_rows)
