"""Toxicity: a learned lexicon matched with Levenshtein automata over a trie.

Terms are whole words, or word stems written ``stem*``.  They are learned from
labelled documents as words and prefixes that occur in toxic documents and
almost never elsewhere.  A word of a text is looked up by walking the lexicon
trie together with the automaton of "at most one edit", so that misspelled terms
are found; fuzzy matching of a term is kept only where the clean part of the
fitted sample shows no clash with ordinary words.  Where a stem's fuzzy matching
clashes, the words that it stands for are taken beside it if theirs doesn't.

Each hit is weighed by its context window: hits between an opening quotation mark and
its closing one, or near words of reporting, count as quotation and are weighed apart
from plain abuse, those of words and those of stems alike.  Apostrophes are no marks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import broadcast_if_small, materialise, training_rows, with_text

#: Largest number of labelled documents that the lexicon and weights are fitted on.
FIT_ROWS = 12_000
#: Largest lexicon kept, by evidence; words taken beside a stem for their edits come on top.
MAX_TERMS = 2_000
#: Lengths of the stems that are tried.
STEM_LENGTHS = (4, 5, 6, 7)
#: Shortest whole word and stem that may match with one edit.
FUZZY_WORD, FUZZY_STEM = 5, 4
#: Words on either side of a hit that its context window spans.
WINDOW = 6
#: A stem counts as evidence in documents where it makes up this share of the words.
DENSE = 0.006
#: Words that a shorter text is taken to have where shares of stems are reckoned.
LEAST_WORDS = 50
#: Words remembered by a task before its look-up memory starts anew.
MEMORY = 200_000
#: Moves of the automaton remembered by a task.
MOVES = 100_000

#: Words of reporting in the four languages, and quotation marks.
REPORTING = frozenset("said says wrote quote quoted called term word dit écrit mot sagte schrieb wort dijo escribió palabra".split())
CLOSING = {'"': '"', "'": "'’", "`": "`'", "“": "”", "„": "“”", "”": "”", "‘": "’", "‚": "‘’", "«": "»", "»": "«", "‹": "›", "›": "‹"}

_WORD = re.compile(r"[^\W\d_]+")
_NONE: set[int] = set()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


# ------------------------------------------------------------------ automaton
class LexiconAutomaton:
    """The product of a lexicon trie and "at most ``edits`` edits".

    A state is the set of (trie node, edits used) that a prefix can reach; states
    are made when first met, so ordinary words leave the automaton after a few
    letters.  ``match(word)`` gives (term index, edits), the fewest edits first
    and then the longest term, or None.
    """

    def __init__(self, terms: list[str], fuzzy: Iterable[bool]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.fuzzy_below: list[bool] = [False]
        for k, (term, loose) in enumerate(zip(terms, fuzzy, strict=True)):
            node = 0
            self.fuzzy_below[0] |= loose
            for c in term.rstrip("*"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.fuzzy_below.append(False)
                node = self.next[node][c]
                self.fuzzy_below[node] |= loose
            (self.stem_at if term.endswith("*") else self.word_at)[node] = k
        self.loose = list(fuzzy)
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.start = self._close({(0, 0)})

    def _close(self, items: set[tuple[int, int]]) -> frozenset:
        """Adds the nodes reached by leaving out a letter of the term."""
        best: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, used = todo.pop()
            if best.get(node, 2) <= used:
                continue
            best[node] = used
            if used == 0 and self.fuzzy_below[node]:
                todo += [(n, 1) for n in self.next[node].values() if self.fuzzy_below[n]]
        return frozenset(best.items())

    def step(self, state: frozenset, c: str) -> frozenset:
        got = self.moves.get((state, c))
        if got is None:
            out: set[tuple[int, int]] = set()
            for node, used in state:
                if c in self.next[node]:
                    out.add((self.next[node][c], used))
                if used == 0 and self.fuzzy_below[node]:
                    out.add((node, 1))  # a letter too many
                    out.update((n, 1) for n in self.next[node].values() if self.fuzzy_below[n])  # another letter
            got = self._close(out)
            if len(self.moves) > MOVES:
                self.moves.clear()
            self.moves[state, c] = got
        return got

    def reached(self, word: str) -> list[tuple[int, int, int]]:
        """(edits, minus the term's length, term index) of every term that matches."""
        state, found = self.start, []
        for c in word:
            state = self.step(state, c)
            if not state:
                break
            for node, used in state:
                k = self.stem_at.get(node)
                if k is not None and (not used or self.loose[k]):
                    found.append((used, -len(self.terms[k]), k))
        else:
            for node, used in state:
                k = self.word_at.get(node)
                if k is not None and (not used or self.loose[k]):
                    found.append((used, -len(self.terms[k]), k))
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        found = self.reached(word)
        if not found:
            return None
        used, _, k = min(found)
        return k, used


class _Memory(dict):
    """word -> match, filled through the automaton."""

    def __init__(self, automaton: LexiconAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str):
        got = self[word] = self.automaton.match(word)
        return got


# --------------------------------------------------------------------- scores
@dataclass
class ToxicModel:
    terms: list[str] = field(default_factory=list)
    fuzzy: list[bool] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0, 0, 0, 0, 0]))
    #: Score of every document where nothing could be learned.
    base: float | None = None


def _is_mark(text: str, at: int) -> bool:
    """A quotation mark, and no apostrophe within a word."""
    return text[at] in CLOSING and not (0 < at < len(text) - 1 and text[at - 1].isalnum() and text[at + 1].isalnum())


def _opens(text: str, at: int) -> bool:
    """Whether the mark begins a quotation, by what stands around it."""
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    if text[at] in "«‹":
        return not before.isalnum()
    return after != "" and not after.isspace() and (before == "" or not (before.isalnum() or before in ".,;:!?…)]"))


def _closes(text: str, at: int) -> bool:
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    return not after.isalnum() and (text[at] in "»›" or not before.isspace())


def between_marks(text: str, start: int, end: int, low: int, high: int) -> bool:
    """Whether text[start:end] stands between an opening mark from ``low`` on and its
    closing one before ``high``, with no other mark between."""
    k = next((i for i in range(start - 1, low - 1, -1) if _is_mark(text, i)), None)
    if k is None or not _opens(text, k):
        return False
    m = next((i for i in range(end, high) if _is_mark(text, i)), None)
    return m is not None and text[m] in CLOSING[text[k]] and _closes(text, m)


def hit_features(text: str, memory: _Memory) -> tuple[float, float, float, float, float, list[tuple[int, int]]]:
    """Damped counts of abuse and quotation by whole words, their damped share, abuse and
    quotation by stems, and the hits.  Stems also occur in ordinary words, so only many of
    them, and a high share of the text, count together."""
    # All places are those of the lower-cased text: lower-casing may change lengths.
    text = text.lower()
    words = _WORD.findall(text)
    # Most texts have no hit: distinct words first, places only if needed.
    hits = {w: m for w in set(words) if (m := memory[w]) is not None}
    if not hits:
        return 0.0, 0.0, 0.0, 0.0, 0.0, []
    abuse = quoted = stems = quoted_stems = 0.0
    terms = memory.automaton.terms
    spans = [m.span() for m in _WORD.finditer(text)]
    found = []
    for i, w in enumerate(words):
        m = hits.get(w)
        if m is None:
            continue
        found.append(m)
        worth = 1.0 if m[1] == 0 else 0.8
        stem = terms[m[0]].endswith("*")
        lo, hi = max(0, i - WINDOW), min(len(spans), i + WINDOW + 1)
        # A mark just before the first word and just after the last one count as well.
        low, high = spans[lo - 1][1] if lo else 0, spans[hi][0] if hi < len(spans) else len(text)
        if any(x in REPORTING for x in words[lo:i]) or between_marks(text, *spans[i], low, high):
            if stem:
                quoted_stems += worth
            else:
                quoted += worth
        elif stem:
            stems += worth
        else:
            abuse += worth
    n = len(words)
    dense = lambda k: np.log1p(k) * np.log1p(200 * k / max(n, LEAST_WORDS))
    return np.log1p(abuse), np.log1p(quoted), np.log1p(50 * (abuse + quoted) / n), dense(stems), dense(quoted_stems), found


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge * np.eye(z.shape[1])
        step = np.linalg.solve(hess, z.T @ (p - y) / len(z) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _terms_of(text: str) -> set[str]:
    """Words of a text, and the stems that are dense in it."""
    words, stems = Counter(words_of(text)), Counter()
    for w, k in words.items():
        for n in STEM_LENGTHS:
            if len(w) > n:
                stems[w[:n] + "*"] += k
    least = DENSE * sum(words.values())
    return {w for w in words if len(w) <= 40} | {s for s, k in stems.items() if k >= least}


def pick_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[str]:
    return _pick_terms(counts, toxic, clean)[0]


def _pick_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """Terms, and words left out for stems, both by evidence, from (term, toxic documents, clean documents) counts.

    Kept: at least 3 toxic documents, at most 2 % of its documents clean (10 % for
    a stem) and a z-score of 4 or more.  Stems are decided first: a stem is kept only
    if it joins several words and no kept shorter stem covers it.  A word is left out
    only if a stem that covers it is among the terms returned.
    """
    if not toxic:
        return [], []
    rate = toxic / (toxic + clean)
    scored = []
    for term, t, c in counts:
        z = (t - (t + c) * rate) / np.sqrt(max((t + c) * rate * (1 - rate), 1e-9))
        if t >= 3 and c <= (0.1 if term.endswith("*") else 0.02) * (t + c) and z >= 4:
            scored.append((z, term, t))
    scored.sort(key=lambda x: (-x[0], x[1]))
    stems = sorted(((term, t) for _, term, t in scored if term.endswith("*")), key=lambda x: (len(x[0]), x[0]))
    words = [(term, t) for _, term, t in scored if not term.endswith("*")]
    most: Counter[str] = Counter()  # toxic documents of a stem's commonest word
    for w, t in words:
        for n in STEM_LENGTHS:
            if n <= len(w):
                most[w[:n] + "*"] = max(most[w[:n] + "*"], t)
    cut: set[str] = set()
    while True:
        held: dict[str, int] = {}

        def covered(body: str, t: int) -> bool:
            """A shorter stem says it, and more."""
            return any(held.get(body[:n] + "*", 0) >= 1.15 * t for n in STEM_LENGTHS if n <= len(body))  # noqa: B023

        for term, t in stems:
            if term not in cut and most[term] < 0.9 * t and not covered(term[:-1], t):
                held[term] = t
        stay = held.keys() | {w for w, t in words if not covered(w, t)}
        kept = [term for _, term, _ in scored if term in stay][:MAX_TERMS]
        # A stem beyond the bound covers nothing: decide anew without it.
        beyond = held.keys() - set(kept)
        if not beyond:
            return kept, [w for w, _ in words if w not in stay]
        cut |= beyond


def learn_toxicity(docs: DataFrame, labels: DataFrame, split: int = 1, folds: int = 3, bound: int = FIT_ROWS) -> ToxicModel:
    """Fit lexicon and weights on at most ``bound`` labelled documents outside
    the held-out fold.  Only their ids and texts are read besides the labels.

    Without toxic or without clean rows nothing is learned: every document then
    scores 1 if all labels seen are toxic, else 0.  Of repeated labels of an id the
    largest counts; null texts are empty; rows that share an id are all fitted on.
    """
    sample = training_rows(labels, "toxic", split, folds, bound)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Read four times below, so written once: the sampled texts alone.
    rows = materialise(rows.join(broadcast_if_small(sample, bound, FIT_ROWS), "doc_id").select("label", "text"), "toxic-sample")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return ToxicModel(base=1.0 if toxic else 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}

        def flush() -> pa.RecordBatch:
            terms = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))], names=["term", "t", "c"])
            seen[0].clear(), seen[1].clear()
            return out

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(_terms_of(text))
                if len(seen[0]) > 300_000:
                    yield flush()
        yield flush()

    totals = rows.mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # Terms of at least 3 toxic documents and few clean ones: bounded by the sample.
    counts = [(r["term"], r["t"], r["c"]) for r in totals.where("t >= 3 and c <= 0.1 * (t + c)").collect()]
    terms, left_out = _pick_terms(counts, toxic, clean)

    def unclashing(terms: list[str], trial: list[bool]) -> list[bool]:
        """Which of the terms on trial match with an edit in next to no clean document."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, n = LexiconAutomaton(terms, trial), Counter()
            known: dict[str, set[int]] = {}
            for batch in batches:
                for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if label:
                        continue
                    met: set[int] = set()
                    for w in set(words_of(text)):
                        if w not in known:
                            found = automaton.reached(w)
                            # All terms on trial count, also those behind a better one that may go.
                            known[w] = {k for _, _, k in found} if found and min(found)[0] else _NONE
                        met |= known[w]
                    n.update(met)
                    if len(known) > MEMORY:
                        known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["k", "n"])

        clash = {r["k"]: r["n"] for r in rows.mapInArrow(probe, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
        return [t and clash.get(k, 0) <= 0.0005 * clean for k, t in enumerate(trial)]

    # Words whose stems take them over are tried as well.
    tried = terms + left_out
    trial = [len(t.rstrip("*")) >= (FUZZY_STEM if t.endswith("*") else FUZZY_WORD) for t in tried]
    loose = dict(zip(tried, unclashing(tried, trial), strict=True))
    terms += [w for w in left_out if loose[w] and not any(loose.get(w[:n] + "*") for n in STEM_LENGTHS if n <= len(w))]
    fuzzy = [loose[t] for t in terms]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(LexiconAutomaton(terms, fuzzy))
        for batch in batches:
            got = [(label, *hit_features(text, memory)[:5]) for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([float(g[i]) for g in got]) for i in range(6)], names=["label", "a", "q", "d", "s", "r"])

    # At most `bound` rows of six numbers come back, in any order; sorted, sums are alike on every run.
    got = rows.mapInArrow(measure, "label double, a double, q double, d double, s double, r double").collect()
    m = np.array(sorted((r["label"], r["a"], r["q"], r["d"], r["s"], r["r"]) for r in got))
    return ToxicModel(terms, fuzzy, _logistic(m[:, 1:], m[:, 0]))


def score_documents(docs: DataFrame, model: ToxicModel, text_col: str = "text", to: str = "score", spans: bool = False) -> DataFrame:
    """``docs`` with a toxicity score in [0, 1] as column ``to``.

    With ``spans`` also the matched terms (term, edits), in order of place, as ``hits``.
    Null and empty texts have no hits and get the score of a text without hits; every row
    is scored by its text alone, repeated ones alike.  Columns of ``docs`` with the names
    of the new ones are replaced.
    """
    new = [StructField(to, DoubleType())]
    if spans:
        new.append(StructField("hits", ArrayType(StructType([StructField("term", StringType()), StructField("edits", IntegerType())]))))
    docs, kept = with_text(docs, text_col, [f.name for f in new])
    fields = [*kept, *new]
    terms, fuzzy, weights, base = model.terms, model.fuzzy, model.weights, model.base

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(LexiconAutomaton(terms, fuzzy))
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                *x, found = hit_features(text or "", memory) if terms else (0.0, 0.0, 0.0, 0.0, 0.0, [])
                z = weights[0] + weights[1:] @ np.array(x)
                scores.append(base if base is not None else float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
                if spans:
                    hits.append([{"term": terms[t], "edits": e} for t, e in found])
                if len(memory) > MEMORY:
                    memory.clear()
            out = [*batch.columns[:-1], pa.array(scores, pa.float64())]
            if spans:
                out.append(pa.array(hits, pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.mapInArrow(scan, StructType(fields))
