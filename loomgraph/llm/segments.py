"""Tokenising whole texts through a bounded memory of their segments.

A text is cut where no token can cross; each distinct segment is encoded once and
remembered, as its ids in little-endian unsigned 32-bit form, so that a text's ids
are a join of byte strings.  The memory starts anew when it is full; results never
depend on it.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from itertools import filterfalse

import numpy as np
import regex

#: Segments remembered by one task.
MEMORY = 1_000_000


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def library_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(path))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pack_ids(ids: Iterable[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class SpaceSegments:
    """Ids of texts under a tokenizer that drops white space.

    Segments are the runs between ASCII white space.  ASCII capitals are folded
    beforehand, as the vocabulary's own normaliser does; texts with its special
    tokens are not folded, since those are matched before normalising.  Trailing
    ASCII punctuation after an ASCII letter is a segment of its own.
    """

    _MARKS = b".,;:!?"
    _TAIL = re.compile(rb"^(.*[a-z])([.,;:!?]+)$", re.S)

    def __init__(self, encode_all: Callable[[list[bytes]], list[bytes]], specials: list[bytes], memory: int = MEMORY):
        self.encode_all, self.memory, self.limit = encode_all, {}, memory
        self.specials = specials

    def _learn(self, segments: set[bytes]) -> None:
        memory = self.memory
        cut, cores = {}, set()
        for s in segments:
            m = s[-1] in self._MARKS and self._TAIL.match(s)
            if m:
                cut[s] = m.groups()
                cores.update(m.groups())
            else:
                cores.add(s)
        cores = [c for c in cores if c not in memory]
        memory.update(zip(cores, self.encode_all(cores), strict=True))
        for s, (a, b) in cut.items():
            memory[s] = self.join(memory[a], memory[b])

    @staticmethod
    def join(a, b):
        return a + b

    def split(self, text: str) -> list[bytes]:
        raw = text.encode()
        if not any(s in raw for s in self.specials):
            raw = raw.lower()
        return raw.split()

    def look_up(self, texts: list[str]) -> list[list]:
        """For each text, the encoded segments in order."""
        parts = [self.split(t) for t in texts]
        if len(self.memory) > self.limit:
            self.memory.clear()
        new = set(filterfalse(self.memory.__contains__, set().union(*parts)))
        if new:
            self._learn(new)
        get = self.memory.__getitem__
        return [list(map(get, p)) for p in parts]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the
    next free code point from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordRules:
    """The word vocabulary's own way from a segment to words: special tokens, canonical
    composition, lower case, the word pattern."""

    #: Fixed value: the vocabulary's word pattern.
    _PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Characters on which this Python's tables and the library's are sure to agree.
    _SURE = re.compile(r"[\x21-\x7e\xa1-\u024f]*")

    def __init__(self, path: str):
        self.library = library_tokenizer(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}

    def words(self, text: str) -> list[bytes]:
        """Words, as bytes, of a text without special tokens."""
        if self._SURE.fullmatch(text):
            return [w.encode() for w in self._PATTERN.findall(unicodedata.normalize("NFC", text).lower())]
        # Rarer scripts: the library's own normaliser and splitter.
        got = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([self.byte_of[c] for c in w]) for w, _ in got]

    def plan(self, segment: bytes) -> list:
        """The words (bytes) and special tokens (ids) of a segment, in order."""
        if segment.isalpha():  # ASCII letters only
            return [segment.lower()]
        text, plan = segment.decode(), []
        for piece in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if piece in self.special:
                plan.append(self.special[piece])
            elif piece:
                plan += self.words(piece)
        return plan


def library_segments(path: str) -> EagerSegments:
    """Segments whose words are encoded by the tokenizers library's own model."""
    rules = WordRules(path)
    tokenize = rules.library.model.tokenize
    table = {b: c for b, c in enumerate(rules.letters) if chr(b) != c}

    def encode(segment: bytes) -> bytes:
        if segment.isalpha():  # ASCII letters only: one word
            return array("I", [t.id for t in tokenize(segment.decode().lower())]).tobytes()
        ids: list[int] = []
        for w in rules.plan(segment):
            if w.__class__ is bytes:
                ids += [t.id for t in tokenize(w.decode() if w.isalpha() else w.decode("latin-1").translate(table))]
            else:
                ids.append(w)
        return array("I", ids).tobytes()

    return EagerSegments(encode, [s.encode() for s in rules.special])


class EagerSegments(SpaceSegments):
    """Segments that are encoded one by one, each when it is first asked for."""

    def __init__(self, encode: Callable[[bytes], bytes], specials: list[bytes], memory: int = MEMORY):
        super().__init__(lambda segments: list(map(encode, segments)), specials, memory)
        self.memory = _Memory(encode)

    def look_up(self, texts: list[str]) -> list[list]:
        if len(self.memory) > self.limit:
            self.memory.clear()
        get = self.memory.__getitem__
        return [list(map(get, self.split(t))) for t in texts]


class _Memory(dict):
    def __init__(self, encode: Callable[[bytes], bytes]):
        self.encode = encode

    def __missing__(self, segment: bytes) -> bytes:
        m = segment[-1] in SpaceSegments._MARKS and SpaceSegments._TAIL.match(segment)
        ids = self[segment] = self[m[1]] + self[m[2]] if m else self.encode(segment)
        return ids


class ByteLevelIds:
    """Ids of texts under the byte-level vocabulary.

    Texts are merged by the ranks of the same vocabulary, which gives the ids of the
    tokenizers library (the tests hold them together); texts with a special token go
    to the library itself.
    """

    def __init__(self, path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary_path(ranks_path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.library = path, None

    def __call__(self, text: str) -> np.ndarray:
        if "<|" in text:
            self.library = self.library or library_tokenizer(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
