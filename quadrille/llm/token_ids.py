"""Token ids of a byte-level vocabulary for whole slices of texts.

The library's split into pre-tokens is done for all texts of a slice at once, on their bytes; only pre-tokens that a worker
hasn't met yet go through the library, and all others take their ids from what it answered before.  The answer is that of the
library for every text (special strings inside texts are their ids, as its default is)."""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import regex
import tiktoken

from quadrille.llm import _text, token_counts

SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
_CUTS = [b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"]  # what an apostrophe takes with it


def character_classes() -> np.ndarray:
    """The class of every code point under the vocabularies' split pattern."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{token_counts._SPACE}]+")):
        for m in regex.finditer(pattern, chars):
            a, b = ord(chars[m.start()]), ord(chars[m.end() - 1])
            out[a : b + 1] = code
    return out


def byte_classes(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """For each byte of valid UTF-8 the class of its character."""
    out = classes[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            point[more] = (point[more] << 6) | (data[lead[more] + k] & 0x3F)
        kind = classes[point]
        for k in range(4):
            more = size > k
            out[lead[more] + k] = kind[more]
    return out


def pre_tokens(data: np.ndarray, segments: np.ndarray, special: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first bytes of all pre-tokens; segments are the ascending first bytes of the texts' parts, `special` says which are special strings."""
    n = len(data)
    kind = byte_classes(data, classes)
    first = np.ones(n, dtype=bool)
    first[1:] = kind[1:] != kind[:-1]
    first[segments] = True
    if special.any():
        for a, b in zip(segments[special].tolist(), np.append(segments, n)[1:][special].tolist()):
            kind[a:b], first[a + 1 : b] = SPECIAL, False
    begins_part = np.zeros(n + 1, dtype=bool)
    begins_part[segments] = begins_part[n] = True
    runs = np.flatnonzero(first)
    ends = np.append(runs[1:], n)
    k = kind[runs]
    # white space before a word leaves its last character to it, if that is a space, or lets it stand alone
    gaps = np.flatnonzero((k == SPACE) & ~begins_part[ends])
    last = ends[gaps] - 1
    for _ in range(2):
        last -= (data[last] & 0xC0) == 0x80
    first[last] = True
    takes = ends[gaps][data[last] == 0x20]
    first[takes] = False
    # an apostrophe at the begin of a pre-token takes one of the endings with it
    mark = np.flatnonzero((k == OTHER) & (ends - runs == 1) & (data[runs] == 0x27) & first[runs] & ~begins_part[ends])
    at, stop = runs[mark], ends[np.minimum(mark + 1, len(runs) - 1)]
    for end in _CUTS:
        fits = at + len(end) < stop
        for i, c in enumerate(end, 1):
            fits &= data[np.minimum(at + i, n - 1)] == c
        cut = at[fits]
        first[cut + 1] = False
        rest = cut + 1 + len(end)
        first[rest[rest < n]] = True
    return np.flatnonzero(first)


class Numbers:
    """Numbers of 64-bit hashes in order of their coming: a table with linear probing that is searched and filled for whole arrays."""

    def __init__(self, bits: int = 21):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    @property
    def full(self) -> bool:
        return 2 * self.n > len(self.keys)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it has none."""
        slot = self._slots(h)
        key = self.keys[slot]
        out = np.where(key == h, self.values[slot], -1)
        rest = np.flatnonzero((key != h) & (key != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            key = self.keys[slot[rest]]
            hit = key == h[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Number distinct hashes that aren't there yet."""
        while 2 * (self.n + len(h)) > len(self.keys):
            old, values = self.keys, self.values
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(old[old != 0], values[old != 0])
        self._put(h, self.n + np.arange(len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        slot = self._slots(h)
        while len(h):
            _, one = np.unique(slot, return_index=True)
            one = one[self.keys[slot[one]] == 0]
            self.keys[slot[one]], self.values[slot[one]] = h[one], values[one]
            left = np.ones(len(h), dtype=bool)
            left[one] = False
            h, values, slot = h[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)


class TokenIds:
    """The vocabulary at `path`, and the ids of up to a million pre-tokens that were met so far."""

    def __init__(self, path: str, classes: np.ndarray):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level vocabularies with the usual split are read")
        self.classes = classes
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.find_special = regex.compile(b"|".join(map(regex.escape, self.special))).finditer if self.special else None
        self.size = 1 + max([*spec["model"]["vocab"].values(), *self.special.values()])
        self.lengths = np.zeros(self.size, dtype=np.int64)
        self.lengths[list(spec["model"]["vocab"].values())] = [len(w) for w in spec["model"]["vocab"]]
        self.merge = self._merges(spec["model"], path)
        self._forget()

    def _merges(self, model: dict, path: str):
        """What merges one pre-token: by ranks, where the ids are in the order of the merges, as usual; else by the library of .json files."""
        vocab, symbols = model["vocab"], token_counts.byte_symbols()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if all(a < b for a, b in zip(made, made[1:])) and not any(vocab[c] >= made[0] for c in symbols) and len(made) + len(symbols) == len(vocab):
            ranks = {bytes(symbols[c] for c in word): i for word, i in vocab.items()}
            return tiktoken.Encoding("ranks", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        return lambda word: library.encode(word, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.numbers = Numbers()
        self.text, self.begins, self.ids, self.firsts = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _merged(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token; those of letters after a space are merged as one text, which is split between them again."""
        plain = [i for i, w in enumerate(words) if w[:1] == b" " and (w[1:].isalpha() or w[1:].decode().isalpha())]
        out: list[list[int] | None] = [None] * len(words)
        got = self.merge(b"".join(words[i] for i in plain).decode())
        ends = np.cumsum(self.lengths[got]) if got else np.zeros(0, np.int64)
        stops = np.cumsum([len(words[i]) for i in plain])
        cut = np.searchsorted(ends, stops) + 1
        if len(plain) and cut[-1] == len(got) and (ends[cut - 1] == stops).all():
            for i, a, b in zip(plain, [0, *cut[:-1].tolist()], cut.tolist()):
                out[i] = got[a:b]
        return [o if o is not None else [self.special[w]] if w in self.special else self.merge(w.decode()) for o, w in zip(out, words)]

    def _learn(self, hashes: np.ndarray, new: list[bytes]) -> None:
        got = self._merged(new)
        ends = lambda rows: np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32)])
        self.firsts = np.concatenate([self.firsts, self.firsts[-1] + ends(got)])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(new), np.uint8)])
        self.begins = np.concatenate([self.begins, self.begins[-1] + ends(new)])
        self.numbers.add(hashes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, and each text's first one."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        segments = offsets[:-1][np.diff(offsets) > 0]
        special = np.zeros(len(segments), dtype=bool)
        if any(s in raw for s in self.special):
            hits = [(m.start(), m.end()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in self.find_special(raw, a, b)]
            begin, end = np.array(hits, dtype=np.int64).reshape(-1, 2).T
            segments = np.unique(np.concatenate([segments, begin, end[end < n]]))
            special = np.isin(segments, begin)
        first = pre_tokens(data, segments, special, self.classes)
        ends = np.append(first[1:], n)
        hashes = _text.word_hashes(data, first, ends) | np.uint64(1)
        if self.numbers.full:
            self._forget()
        at = self.numbers.find(hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, example, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at[missing] = self.numbers.n + which
            example = missing[example]
            self._learn(new, [raw[a:b] for a, b in zip(first[example].tolist(), ends[example].tolist())])
        # hashes aren't taken on trust: every pre-token is compared with the one whose ids it gets, byte for byte
        size = ends - first
        if (size != self.begins[at + 1] - self.begins[at]).any() or (self.text[_text.ranges(self.begins[at], size)] != data).any():
            got = self._merged([raw[a:b] for a, b in zip(first.tolist(), ends.tolist())])
            sizes, ids = np.fromiter(map(len, got), np.int64, len(got)), np.fromiter(chain.from_iterable(got), np.uint32)
        else:
            sizes = self.firsts[at + 1] - self.firsts[at]
            ids = self.ids[_text.ranges(self.firsts[at], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[np.searchsorted(first, offsets)]
