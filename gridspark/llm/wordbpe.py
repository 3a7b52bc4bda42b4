"""Whole-text ids of the public BPE tokenizers, each distinct word encoded by the library once.

These tokenizers cut a text into words by a pattern and encode each word by itself, so the ids of a text are those of its
words in a row. A task keeps the ids of the words it has met, and of the runs between two spaces; the library's model encodes
what is new. A cache has a limit; what it forgets is encoded again, so the limit changes no id. Texts that hold a special string go to
the library whole, since it finds those strings before it cuts."""

from __future__ import annotations

import json
import os
import sys
from array import array

import numpy as np
import regex

#: The pattern by which byte-level tokenizers cut where their file only says ``use_regex``: a fixed value.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Signs that are a word of their own after letters.
SIGNS = frozenset(".,;:!?")
_ENCODERS: dict[str, TextEncoder] = {}


class _Odd(Exception):
    """A run that can't be encoded apart from its neighbours."""


class _Cache(dict):
    """What ``make`` gave for a key. A full cache becomes the old one, which still answers until the next is full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


def _byte_letters() -> dict[int, str]:
    """The printable letter for each byte: the byte itself where it prints, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class TextEncoder:
    """``encode(text)`` gives the same ids as ``Tokenizer.encode(text, add_special_tokens=False)``, as '<u4' bytes."""

    def __init__(self, path: str, cache_words: int = 500_000):
        from tokenizers import Tokenizer

        if sys.byteorder != "little":
            raise RuntimeError("ids are written in the machine's byte order, which must be little-endian")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.lower, pattern = _shape(spec)
        self.pattern = regex.compile(pattern)
        self.letters = _byte_letters()
        self.words = _Cache(self._word, cache_words)
        self.firsts = _Cache(self._first_run, cache_words // 4)
        self.runs = _Cache(self._lower_run if self.lower else self._spaced_run, cache_words)

    def _word(self, word: str) -> bytes:
        tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in tokens]).tobytes()

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def _lower_run(self, run: str) -> bytes:
        if run.isascii() or max(run) < "\u0250":
            low = run.lower()  # Latin letters below 0250 are composed already and have one lower case each
        else:
            low = self.tokenizer.normalizer.normalize_str(run)
        if low.isalpha():
            return self._word(low) if low == run else self.runs[low]
        if low[-1:] in SIGNS and low[:-1].isalpha():
            return self.runs[low[:-1]] + self.words[low[-1]]
        return b"".join([self.runs[p] if p.isascii() and p.isalpha() else self.words[p] for p in self.pattern.findall(low)])

    def _spaced_run(self, run: str) -> bytes:
        """The ids of a space and a run that neither starts nor ends with white space."""
        if run.isalpha():
            return self._word(" " + run)
        if not run or run[0].isspace() or run[-1].isspace():
            raise _Odd
        if run[-1] in SIGNS and run[:-1].isalpha():
            return self.runs[run[:-1]] + self.words[run[-1]]
        first, *rest = self.pattern.findall(" " + run)
        return (self.runs[first[1:]] if rest else self._word(first)) + b"".join([self.words[p] for p in rest])

    def _first_run(self, run: str) -> bytes:
        """The ids of a run at the beginning of a line."""
        if not run or run[0].isspace() or run[-1].isspace():
            raise _Odd
        return self._word(run) if run.isalpha() else self._cut(run)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        for mark in self.special:
            if mark in text:
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.lower:
            return b"".join(map(self.runs.__getitem__, text.replace("\n", " ").split(" ")))
        out: list[bytes] = []
        try:
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                out.append(self.firsts[first])
                out += map(self.runs.__getitem__, rest)
                out.append(self.words["\n"])
            return b"".join(out[:-1])
        except _Odd:
            return self._cut(text)


def encoder(path: str) -> TextEncoder:
    """The encoder of this Python worker, which keeps its caches from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def _shape(spec: dict) -> tuple[bool, str]:
    """Whether words are lower-cased before the cut, and the cut's pattern; other kinds of tokenizer are refused."""
    before, normal = spec["pre_tokenizer"], spec["normalizer"]
    if before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and normal is None:
        return False, BYTE_LEVEL_PATTERN
    parts = before.get("pretokenizers", [])
    if [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["invert"] and parts[0]["behavior"] == "Removed" and not parts[1]["use_regex"]:
        if [n["type"] for n in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            return True, parts[0]["pattern"]["Regex"]
    raise ValueError("this tokenizer does not encode word by word")
