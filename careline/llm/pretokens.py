"""Byte-level BPE by distinct pre-tokens, in numpy.

A block of texts becomes one array of code points. Token starts follow from changes of
character class, by the rule of the vocabulary's pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

so no regular expression runs over the text. Equal pre-tokens get one code (by a 64-bit
hash, then checked character by character), and only distinct ones meet the merges.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd

#: Characters of a block; a longer text is cut between pre-tokens.
BLOCK = 3_000_000
#: Bytes of pre-tokens and ids that a worker remembers, about; the table starts anew beyond it.
REMEMBERED = 32_000_000
#: Bytes of an entry of that table besides characters and ids, about.
ENTRY = 300

WHITE, SPACE, LETTER, NUMBER, OTHER = range(5)
# fixed values: characters with the property White_Space other than the space
WHITE_SPACE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
               0x202F, 0x205F, 0x3000]
# fixed values: suffixes split after an apostrophe
SUFFIXES = ["s", "t", "m", "d", "re", "ve", "ll"]
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[WHITE_SPACE] = WHITE
    kinds[0x20] = SPACE
    return kinds


@lru_cache(1)
def multipliers() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, 8192, np.uint64) | np.uint64(1)


def _starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where pre-tokens start; ``first`` has the starts of the parts."""
    kind = classes()[chars]
    group = np.maximum(kind, SPACE)
    start = np.empty(len(chars), bool)
    start[0] = True
    np.not_equal(group[1:], group[:-1], out=start[1:])
    start[first] = True
    fresh = np.zeros(len(chars), bool)
    fresh[first] = True
    runs = np.flatnonzero(start & (group != SPACE) & ~fresh)
    after = runs[group[runs - 1] == SPACE]  # a run behind white space
    start[after - 1] = True  # its last character stands alone,
    start[after[kind[after - 1] == SPACE]] = False  # or leads the run if it is a space
    marks = np.flatnonzero((chars == 0x27) & start)
    if len(marks):
        part_end = np.append(first[1:], len(chars))
        end = part_end[np.searchsorted(first, marks, "right") - 1]
        for suffix in SUFFIXES:
            n = len(suffix)
            m = marks[marks + n < end]
            for i, c in enumerate(suffix):
                m = m[chars[m + 1 + i] == ord(c)]
            start[m + 1] = False
            more = m + n + 1
            start[more[more < len(chars)]] = True
    return np.flatnonzero(start)


def distinct(chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of spans that follow each other without gaps or not, equal for equal characters, and
    the place of the first span of each code. Spans are compared by hash, then by character."""
    first = np.cumsum(length) - length
    off = np.arange(int(length.sum())) - np.repeat(first, length)
    inside = chars if len(off) == len(chars) else chars[np.repeat(start, length) + off]
    for seed in range(1, 9):
        mixed = (inside + np.uint64(seed)) * multipliers()[(off + 64 * seed) & 8191]
        hashed = np.add.reduceat(mixed, first) ^ (length.astype(np.uint64) << np.uint64(40))
        codes, _ = pd.factorize(hashed)
        rep = np.empty(codes.max() + 1, np.int64)
        rep[codes[::-1]] = np.arange(len(codes))[::-1]
        if (length[rep[codes]] == length).all() and np.array_equal(
                inside[np.repeat(first[rep[codes]], length) + off], inside):
            return codes, rep
    raise RuntimeError("unequal spans share every hash")


@dataclass
class Block:
    """Pre-tokens of some texts. ``codes`` has one number per pre-token, ``words`` the
    pre-token of each number, ``text_of`` the text that each pre-token belongs to."""

    words: list[str]
    codes: np.ndarray
    text_of: np.ndarray


def pre_tokens(parts: list[tuple[int, str]]) -> Block:
    """``parts``: (number of the text, piece of it), in order and not empty. A part that is the
    special token is one pre-token."""
    joined = "".join(p for _, p in parts)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(p) for _, p in parts])
    first = np.cumsum(sizes) - sizes
    start = _starts(chars, first)
    special = [i for i, (_, p) in enumerate(parts) if p == SPECIAL]
    if special:
        inside = np.zeros(len(chars), bool)
        for i in special:
            inside[first[i] + 1:first[i] + sizes[i]] = True
        start = start[~inside[start]]
    length = np.diff(start, append=len(chars))
    codes, rep = distinct(chars, start, length)
    words = [joined[a:b] for a, b in zip(start[rep].tolist(), (start + length)[rep].tolist())]
    which = np.searchsorted(first, start, "right") - 1
    return Block(words, codes, np.array([i for i, _ in parts])[which])


_SAFE_CUT = re.compile(r"\S(?= \S)")


def blocks(texts: list[str | None], size: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """Lists of parts of about ``size`` characters. A special token is a part; a long text is
    cut in front of a single space, where a pre-token starts in any case."""
    out: list[tuple[int, str]] = []
    held = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        pieces = [text]
        if SPECIAL in text:
            pieces = [p for p in re.split("(" + re.escape(SPECIAL) + ")", text) if p]
        for piece in pieces:
            at = 0
            while at < len(piece):
                if len(piece) - at <= size:
                    cut = len(piece)
                else:
                    m = _SAFE_CUT.search(piece, at + size - 1)
                    cut = m.end() if m else len(piece)
                if held and held + cut - at > size:
                    yield out
                    out, held = [], 0
                out.append((i, piece[at:cut]))
                held += cut - at
                at = cut
    if out:
        yield out


class Pieces:
    """Token ids of pre-tokens, each worked out once while it is remembered."""

    #: From so many characters on, pieces are merged by a library whose cost is not quadratic.
    LONG = 400

    def __init__(self, ranks_file: str, json_file: str, remembered: int = REMEMBERED):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json_file = json_file
        self.core = tiktoken.Encoding(
            "own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.remembered, self.known, self.held = remembered, {}, 0

    @cached_property
    def slow(self):
        """The library for long pre-tokens, loaded only if there is one."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_file)

    def count(self, word: str) -> int:
        """The number of pieces of a pre-token, which is not remembered."""
        return 1 if word == SPECIAL else len(self._merged(word))

    def _merged(self, word: str) -> list[int]:
        return (self.core.encode_ordinary(word) if len(word) < self.LONG
                else self.slow.encode(word, add_special_tokens=False).ids)

    def ids(self, words: list[str]) -> list[list[int]]:
        known, out = self.known, []
        for w in words:
            v = known.get(w)
            if v is None:
                v = [SPECIAL_ID] if w == SPECIAL else self._merged(w)
                self.held += ENTRY + 2 * len(w) + 36 * len(v)
                if self.held > self.remembered:
                    known.clear()
                    self.held = 0
                known[w] = v
            out.append(v)
        return out


@lru_cache(1)
def pieces(ranks_file: str, json_file: str) -> Pieces:
    """The worker's table. Both files hold the same vocabulary, as ranks and for tokenizers. A task that has used it
    calls ``pieces.cache_clear``, as workers are used again for other stages."""
    return Pieces(ranks_file, json_file)
