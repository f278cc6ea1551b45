"""Quality classifier: Bradley-Terry ranking of documents.

A document's strength is linear in surface features of its whole text.  The
weights are learned from preference pairs (a document marked good is preferred
to one marked bad) by logistic loss on feature differences; an intercept cancels
out, so a cut is chosen over the strengths of all fitted rows and mapped to the
score 0.7.

Fitting uses every labelled document outside the held-out fold, in blocks of rows within
which pairs are drawn.  Features are computed from whole texts without a shuffle of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import LOWER, materialise, runs, text_slices, training_rows, with_text, word_hashes, word_spans

#: Labelled ids up to which other texts are passed over by a broadcast of the ids; with
#: more, features of all texts are made and joined.
FILTER_ROWS = 200_000
#: Rows of a block of labelled documents, and those of the rarer class in each.
BLOCK_ROWS, RARE_ROWS = 2_048, 64
#: Bins in which strengths are counted for the cut.
BINS = 1_024
#: Preference pairs drawn for each labelled document of the commoner class.
PAIRS_PER_ROW = 8

FEATURES = (
    "log_words", "word_bytes", "upper", "digit", "symbol", "bang", "pipe", "sentence", "newline",
    "upper_words", "symbol_words", "pipe_words", "repeats", "top_word", "distinct_words",
    "distinct_spans", "distinct_lines", "longest_word",
)

_CLASS = np.zeros((6, 256), np.int64)
_CLASS[0, 0x41:0x5B] = 1
_CLASS[1, 0x30:0x3A] = 1
_CLASS[2, [ord(c) for c in "#$%&*@~^=<>[]{}\\/_+|"]] = 1
_CLASS[3, ord("!")] = 1
_CLASS[4, ord(".")] = 1
_CLASS[5, 0x0A] = 1
_LINE_BREAK = np.zeros(256, bool)
_LINE_BREAK[0x0A] = True


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest one, by row."""
    distinct, top = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for r in range(len(at) - 1):
        if at[r + 1] > at[r]:
            run = np.sort(hashes[at[r] : at[r + 1]])
            edges = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True])))
            distinct[r], top[r] = len(edges) - 1, np.diff(edges).max()
    return distinct, top


def feature_matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature rows of the texts data[offsets[i]:offsets[i + 1]]; empty: zeros."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(np.float64)
    starts, ends, rows = word_spans(data, offsets)
    at = runs(rows, n)
    words = np.diff(at).astype(np.float64)
    hashes = word_hashes(LOWER[data], starts, ends)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)
    counts = [_sums(_CLASS[k][data], offsets) for k in range(6)]
    # Of each word: capitals after its first byte, symbols, a lone pipe.
    in_word = lambda k: (lambda t: t[ends] - t[starts])(np.concatenate(([0], np.cumsum(_CLASS[k][data]))))
    upper, symbol = in_word(0), in_word(2) + in_word(3)
    length = ends - starts
    lone = (length == 1) & (data[starts] == ord("|")) if len(starts) else np.zeros(0, bool)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    distinct, top = _distinct(hashes, at)
    span = hashes.copy()
    span[:-1] += hashes[1:] * np.uint64(3)
    span[:-2] += hashes[2:] * np.uint64(5)
    spans, _ = _distinct(span, at)
    line_starts, line_ends, line_rows = word_spans(data, offsets, _LINE_BREAK)
    line_at = runs(line_rows, n)
    lines, _ = _distinct(word_hashes(data, line_starts, line_ends), line_at)
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    part = lambda x, of: np.where(of > 0, x / np.maximum(of, 1), 0.0)
    damp = lambda x: np.log1p(20 * x)
    return np.column_stack([
        np.log1p(words), np.log1p(part(size, words)), damp(counts[0] / per_byte), damp(counts[1] / per_byte),
        damp(counts[2] / per_byte), damp(counts[3] / per_byte), damp(part(lone_sum := _sums(lone, at), words)),
        damp(counts[4] / per_word), damp(counts[5] / per_word),
        damp(_sums((upper >= 2) & (upper * 2 > length), at) / per_word), damp(_sums(symbol > 0, at) / per_word),
        np.sqrt(lone_sum / per_word), damp(_sums(again, at) / per_word), part(top, words),
        np.log(np.maximum(distinct, 1)) - 0.8 * np.log(per_word), part(spans, words),
        part(lines, np.diff(line_at).astype(np.float64)), np.log1p(longest),
    ])


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features array<double>) of every row; null text counts as empty."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                x = feature_matrix(data, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), flat], names=[id_col, "features"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(scan, f"{id_col} {id_type}, features array<double>")


@dataclass
class Ranking:
    """A fitted strength: ``weights . (x - mean) / scale``, and its cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    quantile: float
    #: Steepness of the score around the cut.
    slope: float = 1.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + np.log(0.7 / 0.3)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _blocks(rows: DataFrame, size: dict[int, int]) -> DataFrame:
    """(x, good, own): labelled rows (doc_id, label, features) in blocks of about
    ``BLOCK_ROWS``, as bytes.  Rows of the rarer class come into as many blocks as it takes
    to have some in each; ``own`` marks a row's first place."""
    blocks = -(-sum(size.values()) // BLOCK_ROWS)
    rare = min(size, key=lambda k: (size[k], k))
    copies = min(blocks, -(-RARE_ROWS * blocks // size[rare]))
    places = F.sequence(F.lit(0), F.when(F.col("label") == rare, F.lit(copies - 1)).otherwise(F.lit(0)))
    dealt = rows.select("*", F.explode(places).alias("copy")).withColumn("block", F.pmod(F.xxhash64("doc_id") + F.col("copy"), F.lit(blocks)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", kind="stable")
        x = np.array(part["features"].tolist(), np.float64)
        return pd.DataFrame([{"block": part["block"].iloc[0], "x": x.tobytes(), "good": (part["label"].to_numpy() == 1).tobytes(), "own": (part["copy"].to_numpy() == 0).tobytes()}])

    packed = dealt.groupBy("block").applyInPandas(pack, "block long, x binary, good binary, own binary")
    return materialise(packed, "quality-blocks")


def _summed(blocks: DataFrame, read: Callable[[int, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """What ``read`` tells of every block (its number, features, marks, own): sums, but for
    names that begin with min or max.  A task's blocks are one row to the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, np.ndarray] = {}
        for batch in batches:
            for block, x, good, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                good = np.frombuffer(good, bool)
                _merge(got, read(block, np.frombuffer(x, np.float64).reshape(len(good), -1), good, np.frombuffer(own, bool)))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array([v.ravel().tolist() for v in got.values()], pa.list_(pa.float64()))], names=["name", "v"])

    total: dict[str, np.ndarray] = {}
    for r in blocks.select("block", "x", "good", "own").mapInArrow(scan, "name string, v array<double>").collect():
        _merge(total, {r["name"]: np.array(r["v"], np.float64)})
    return total


def _merge(into: dict[str, np.ndarray], more: dict[str, np.ndarray]) -> None:
    for k, v in more.items():
        join = np.minimum if k.startswith("min") else np.maximum if k.startswith("max") else np.add
        into[k] = join(into[k], v) if k in into else np.asarray(v, np.float64)


def _pairs(block: int, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Preference pairs of a block: every row of the commoner class in ``PAIRS_PER_ROW``."""
    rng = np.random.default_rng([7, block])
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    n = PAIRS_PER_ROW * max(len(a), len(b)) if len(a) and len(b) else 0
    return np.resize(rng.permutation(a), n), rng.permutation(np.resize(rng.permutation(b), n))


def _cut(blocks: DataFrame, strength: Callable[[np.ndarray], np.ndarray], size: dict[int, int]) -> tuple[float, float]:
    """The cut that best balances both classes over all rows, and the share below it.

    Every strength is counted, in bins; those around the best cut are divided once more."""
    ends = _summed(blocks, lambda _k, x, _g, own: {"min": strength(x[own]).min(initial=np.inf), "max": strength(x[own]).max(initial=-np.inf)})
    lo, hi = float(ends["min"].item()), float(ends["max"].item())
    for _ in range(2):
        width = max(hi - lo, 1e-12) / BINS

        def count(_k: int, x: np.ndarray, good: np.ndarray, own: np.ndarray, lo: float = lo, width: float = width) -> dict[str, np.ndarray]:
            s, good = strength(x[own]), good[own]
            # Bin 0 is below the range, the last above it.
            at = np.clip(np.floor((s - lo) / width), -1, BINS).astype(np.int64) + 1
            least, most = np.full(BINS + 2, np.inf), np.full(BINS + 2, -np.inf)
            np.minimum.at(least, at, s)
            np.maximum.at(most, at, s)
            return {"good": np.bincount(at[good], minlength=BINS + 2), "bad": np.bincount(at[~good], minlength=BINS + 2), "min": least, "max": most}

        got = _summed(blocks, count)
        # gain[j]: bins from j + 1 on are accepted.
        below, bad = np.cumsum(got["good"])[:-1], np.cumsum(got["bad"])[:-1]
        gain = 1 - below / size[1] + bad / size[0]
        best = np.flatnonzero(gain >= gain.max() - 1e-9)
        j = int(best[len(best) // 2])
        lo, hi = lo + (j - 2) * width, lo + (j + 2) * width
    under, over = got["max"][: j + 1].max(), got["min"][j + 1 :].min()
    cut = (under + over) / 2 if np.isfinite([under, over]).all() else over if np.isfinite(over) else under
    return float(cut), float((below[j] + bad[j]) / sum(size.values()))


def learn_ranking(docs: DataFrame, labels: DataFrame, split: int = 2, folds: int = 4, ridge: float = 1e-3) -> Ranking:
    """Bradley-Terry fit on every labelled row outside the held-out fold.

    Only doc_id and text are read besides the labels; lang, source and doc_id are no
    features.  Of rows that share an id one counts, of repeated labels the largest; rows
    without an id or a label are not fitted on.  Each Newton step is one pass over the
    rows' features, which gives sums alone to the driver.

    With one class only (or no rows) nothing can be ranked: all strengths are 0 and the cut
    puts every score at the class seen (at 0.7 without rows).
    """
    marked = materialise(training_rows(labels, "quality", split, folds), "quality-marks")
    texts = docs.select("doc_id", "text")
    if marked.count() <= FILTER_ROWS:
        texts = texts.join(F.broadcast(marked.select("doc_id")), "doc_id", "left_semi")
    # Texts stay where they are: their features are joined with the labels.
    rows = with_features(texts).groupBy("doc_id").agg(F.min("features").alias("features")).join(marked.hint("merge"), "doc_id")
    rows = materialise(rows.select("doc_id", (F.col("label") > 0).cast("int").alias("label"), "features"), "quality-features")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    width = len(FEATURES)
    if len(size) < 2:
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 1.0 if 0 in size else 0.0, 0.0)
    blocks = _blocks(rows, size)
    got = _summed(blocks, lambda _k, x, _g, own: {"x": x[own].sum(0), "xx": (x[own] ** 2).sum(0)})
    n = sum(size.values())
    mean = got["x"] / n
    scale = np.maximum(np.sqrt(np.maximum(got["xx"] / n - mean**2, 0)), 1e-6)
    w = np.zeros(width)
    for _ in range(50):  # Newton steps on the mean logistic loss

        def slope(block: int, x: np.ndarray, good: np.ndarray, _o: np.ndarray, w: np.ndarray = w) -> dict[str, np.ndarray]:
            won, lost = _pairs(block, good)
            z = np.clip((x - mean) / scale, -8, 8)
            d = z[won] - z[lost]
            p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
            return {"pairs": np.array([len(d)]), "grad": d.T @ p, "hess": (d * (p * (1 - p))[:, None]).T @ d}

        got = _summed(blocks, slope)
        pairs = max(got["pairs"].item(), 1)
        step = np.linalg.solve(got["hess"].reshape(width, width) / pairs + ridge * np.eye(width), ridge * w - got["grad"] / pairs)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    ranking = Ranking(mean, scale, w, 0.0, 0.0)
    ranking.cut, ranking.quantile = _cut(blocks, Ranking(mean, scale, w, 0.0, 0.0).strength, size)
    return ranking


def score_documents(docs: DataFrame, ranking: Ranking, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a quality score in [0, 1] appended as column ``to``.

    Null texts are empty, and empty ones have features of zero.  Every row is scored by its
    text alone, repeated ones alike; a score of exactly 0.7 is accepted.  A column of
    ``docs`` named as ``to`` is replaced.
    """
    docs, kept = with_text(docs, text_col, [to])
    fields = [*kept, StructField(to, DoubleType())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ranking.score(feature_matrix(data, offsets)))], names=[f.name for f in fields])

    return docs.mapInArrow(scan, StructType(fields))
