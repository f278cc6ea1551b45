"""BPE encoding and decoding: speculate and verify.

A word's tokens are first guessed by greedy longest match.  The guess is the true
encoding if every token encodes to itself and every adjacent pair is compatible,
that is, if merging the two tokens' symbols gives just those two.  Compatibility of
all distinct pairs of a batch is tested at once with array operations: the boundary
of a pair is followed back through the merges that made its two sides, and no merge
across it may come earlier than the ones within.  Only words that fail are merged
exactly.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES
from .segments import SpaceSegments, WordRules, byte_letters, pack_ids, vocabulary_path

END = "</w>"
#: Rank of a pair without a merge.
NEVER = 1 << 40
#: Longest word that is merged in step with others.
SHORT = 48
#: Words remembered by one task.
WORD_MEMORY = 600_000


class PairTable:
    """(left, right) -> rank of their merge, by open addressing over arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            # Of several for one slot, the first takes it.
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.keys[at[put]], self.ranks[at[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.full(len(keys), NEVER, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            got = self.keys[at]
            hit = got == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            go = ~hit & (got >= 0)
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out


class WordBpe:
    """A vocabulary of word-end BPE as arrays, with speculative encoding of words.

    Words are byte strings."""

    def __init__(self, path: str):
        with open(vocabulary_path(path), encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids: dict[str, int] = model["vocab"]
        n = self.size = max(ids.values()) + 1
        self.tokens = [""] * n
        for token, i in ids.items():
            self.tokens[i] = token
        #: Rank of the merge that makes a token (-1: a symbol), its two sides, and what each merge makes.
        self.made, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.makes = np.full(len(model["merges"]) + 1, -1, np.int64)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        keys = np.empty(len(model["merges"]), np.int64)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, t = ids[a], ids[b], ids[a + b]
            self.ranks.setdefault((x, y), (rank, t))
            keys[rank], self.makes[rank] = x * n + y, t
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = rank, x, y
        self._pairs = PairTable(keys)
        self.letters = byte_letters()
        value = {c: b for b, c in enumerate(self.letters)}
        self.symbol = np.array([ids[c] for c in self.letters])
        self.last_symbol = np.array([ids[c + END] for c in self.letters])
        # The vocabulary as a trie over bytes: next node, token inside and at the end of a word.
        steps: list[dict[int, int]] = [{}]
        inside, ending = [-1], [-1]
        for token, i in ids.items():
            closes = token.endswith(END)
            body = token[: -len(END)] if closes else token
            if not body or any(c not in value for c in body):
                continue
            node = 0
            for c in body:
                node_next = steps[node].get(value[c])
                if node_next is None:
                    node_next = steps[node][value[c]] = len(steps)
                    steps.append({}), inside.append(-1), ending.append(-1)
                node = node_next
            (ending if closes else inside)[node] = i
        self.step = np.full((len(steps), 256), -1, np.int32)
        for node, to in enumerate(steps):
            if to:
                self.step[node, list(to)] = list(to.values())
        self.step = self.step.ravel()
        self.accept = np.stack([np.array(inside), np.array(ending)])
        self.single = self._self_encoding()

    def compatible(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the symbols of x and y never merges across them, up to
        merges of rank ``limit``."""
        ok = np.ones(len(x), bool)
        at = np.arange(len(x))
        x, y = x.copy(), y.copy()
        # Ranks at which the present sides go into larger ones.
        ends_x = np.full(len(x), NEVER) if limit is None else limit.copy()
        ends_y = ends_x.copy()
        while len(at):
            rank = self._pairs(x * self.size + y)
            # On a tie the merge further left goes first.
            clash = (rank < ends_x) & (rank <= ends_y) & (rank < NEVER)
            if limit is not None:
                clash &= rank < limit[at]
            ok[at[clash]] = False
            made_x, made_y = self.made[x], self.made[y]
            go = ~clash & (np.maximum(made_x, made_y) >= 0)
            back = made_x > made_y
            # The side that was made last is taken apart.
            ends_x, ends_y = np.where(back, made_x, ends_x)[go], np.where(back, ends_y, made_y)[go]
            x, y, at = np.where(back, self.right[x], x)[go], np.where(back, y, self.left[y])[go], at[go]
        return ok

    def _self_encoding(self) -> np.ndarray:
        merged = np.flatnonzero(self.made >= 0)
        good = np.ones(self.size, bool)
        good[merged] = self.compatible(self.left[merged], self.right[merged], self.made[merged])
        for t in merged[np.argsort(self.made[merged])]:
            good[t] &= good[self.left[t]] and good[self.right[t]]
        return good

    def guess(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words data[start:end] in step: (word, token) in
        order of place within each word."""
        who, pos = np.arange(len(start)), start.copy()
        words, tokens, turns = [], [], []
        turn = 0
        while len(who):
            node, at = np.zeros(len(who), np.int64), pos.copy()
            best, best_end = np.full(len(who), -1), pos.copy()
            live = np.arange(len(who))
            while len(live):
                nxt = self.step[node[live] * 256 + data[at[live]]]
                live, nxt = live[nxt >= 0], nxt[nxt >= 0]
                node[live] = nxt
                at[live] += 1
                final = at[live] == end[who[live]]
                token = self.accept[final.astype(np.int64), nxt]
                hit = token >= 0
                best[live[hit]], best_end[live[hit]] = token[hit], at[live[hit]]
                live = live[~final]
            words.append(who), tokens.append(best), turns.append(np.full(len(who), turn))
            go = best_end < end[who]
            who, pos = who[go], best_end[go]
            turn += 1
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, token = np.concatenate(words), np.concatenate(tokens)
        order = np.lexsort((np.concatenate(turns), word))
        return word[order], token[order]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one long word: always the lowest rank, leftmost first."""
        symbols = [*self.symbol[list(word[:-1])].tolist(), int(self.last_symbol[word[-1]])]
        after, before = [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]
        heap: list[tuple] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (got := self.ranks.get((symbols[i], symbols[after[i]]))):
                heapq.heappush(heap, (got[0], i, symbols[i], symbols[after[i]], got[1]))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of its sides is gone
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i), offer(before[i])
        return [s for s in symbols if s >= 0]

    def merge_all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Exact merging of short words of about one length, in step."""
        n, width = len(start), int((end - start).max())
        col = np.arange(width)[None]
        length = end - start
        sym = np.full((n, width + 1), -1, np.int64)
        sym[:, :width] = np.where(col < length[:, None], self.symbol[data[np.minimum(start[:, None] + col, len(data) - 1)]], -1)
        sym[np.arange(n), length - 1] = self.last_symbol[data[end - 1]]
        rank = np.full((n, width), NEVER, np.int64)
        pair = sym[:, 1:] >= 0
        rank[pair] = self._pairs((sym[:, :-1] * self.size + sym[:, 1:])[pair])
        live = np.arange(n)
        while len(live):
            low = rank[live].argmin(1)
            some = rank[live, low] < NEVER
            live, low = live[some], low[some]
            if not len(live):
                break
            made = self.makes[rank[live, low]]
            # Close the gap behind the merged symbol.
            src = col + (col > low[:, None])
            body = np.take_along_axis(sym[live], np.concatenate([src, np.full((len(live), 1), width)], 1), 1)
            ranks = np.take_along_axis(np.concatenate([rank[live], np.full((len(live), 1), NEVER)], 1), src, 1)
            r = np.arange(len(live))
            body[r, low] = made
            for side in (low - 1, low):
                ok = side >= 0
                ok[ok] &= body[r[ok], side[ok] + 1] >= 0
                ranks[r[side >= 0], side[side >= 0]] = NEVER
                ranks[r[ok], side[ok]] = self._pairs(body[r[ok], side[ok]] * self.size + body[r[ok], side[ok] + 1])
            sym[live], rank[live] = body, ranks
        return [s[s >= 0] for s in sym]

    def encode_words(self, words: list[bytes]) -> tuple[list[np.ndarray], int]:
        """Ids of each word, and how many needed exact merging."""
        if not words:
            return [], 0
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words])
        start = np.concatenate(([0], end[:-1]))
        word, token = self.guess(data, start, end)
        bad = np.zeros(len(words), bool)
        bad[word[~self.single[token]]] = True
        inner = word[1:] == word[:-1]
        pairs, back = np.unique(token[:-1][inner] * self.size + token[1:][inner], return_inverse=True)
        ok = self.compatible(pairs // self.size, pairs % self.size)
        bad[word[:-1][inner][~ok[back]]] = True
        out: list = np.split(token, np.searchsorted(word, np.arange(1, len(words))))
        failing = np.flatnonzero(bad)
        length = (end - start)[failing]
        for i in failing[length > SHORT]:
            out[i] = np.array(self.merge(words[i]))
        short = failing[length <= SHORT]
        short = short[np.argsort(end[short] - start[short], kind="stable")]
        for lo in range(0, len(short), 4096):
            part = short[lo : lo + 4096]
            for i, got in zip(part, self.merge_all(data, start[part], end[part]), strict=True):
                out[i] = got
        return out, len(failing)


class SpeculativeEncoder:
    """Encoding and decoding of texts, by the vocabulary's own rules: canonical
    composition, lower case, the word pattern, byte letters, word-end BPE."""

    def __init__(self, path: str):
        self.bpe, self.rules = WordBpe(path), WordRules(path)
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.spoken = [" " + t for t in self.bpe.tokens]
        self.segments = _PairSegments(self._encode_segments, [s.encode() for s in self.rules.special])
        self.exact = 0

    def _encode_segments(self, segments: list[bytes]) -> list[tuple[bytes, bytes]]:
        if len(self.words) > WORD_MEMORY:
            self.words.clear()
        plans = [self.rules.plan(s) for s in segments]
        todo = list({w: None for plan in plans for w in plan if w.__class__ is bytes and w not in self.words})
        got, exact = self.bpe.encode_words(todo)
        self.exact += exact
        if todo:
            flat = np.concatenate(got)
            packed, spoken, at = flat.astype("<u4").tobytes(), self.spoken, 0
            tokens = flat.tolist()
            for w, ids in zip(todo, got, strict=True):
                end = at + len(ids)
                self.words[w] = packed[4 * at : 4 * end], "".join([spoken[i] for i in tokens[at:end]]).encode()
                at = end
        out, words = [], self.words
        for plan in plans:
            if len(plan) == 1 and plan[0].__class__ is bytes:
                out.append(words[plan[0]])
                continue
            parts = [words[p] if p.__class__ is bytes else (pack_ids([p]), b" " + self.rules.library.id_to_token(p).encode()) for p in plan]
            out.append((b"".join([a for a, _ in parts]), b"".join([b for _, b in parts])))
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit, decoded text in UTF-8) of each text.

        Decoding joins the tokens with spaces, as the library does without a decoder."""
        out = []
        for parts in self.segments.look_up(texts):
            out.append((b"".join([a for a, _ in parts]), b"".join([b for _, b in parts])[1:]))
        return out


class _PairSegments(SpaceSegments):
    @staticmethod
    def join(a, b):
        return a[0] + b[0], a[1] + b[1]


_encoders: dict[str, SpeculativeEncoder] = {}


def encoder(path: str) -> SpeculativeEncoder:
    """One encoder per worker process and vocabulary, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = SpeculativeEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row; null text is empty.

    With ``texts`` also the ids (array<int>) and the decoded text.  No shuffle."""
    extra = ", ids array<int>, decoded string" * texts

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            all_texts = [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(all_texts):
                hi, size = lo, 0
                while hi < len(all_texts) and (hi == lo or size + len(all_texts[hi]) <= CHUNK_BYTES):
                    size += len(all_texts[hi])
                    hi += 1
                got = enc.encode(all_texts[lo:hi])
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([len(a) // 4 for a, _ in got], pa.int64()),
                    pa.array([sha256(a).hexdigest() for a, _ in got]),
                    pa.array([sha256(b).hexdigest() for _, b in got]),
                ]
                if texts:
                    columns += [pa.array([np.frombuffer(a, "<u4").astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([b.decode() for _, b in got])]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * texts])
                lo = hi

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(scan, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
