"""An averaged-perceptron character editor.

For every character of a word it predicts one operation: keep, replace, delete, insert before, or
line-join (the character ends the first half of a word broken over a line end). Features are hashed:
the characters around, what the lexicon knows of the word, and the operation that would turn the
word into its likeliest neighbour in the lexicon. Scores are sums of weights, so that words are
scored together as one matrix.
"""

from __future__ import annotations

import zlib
from collections import Counter
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np

KEEP, REPLACE, DELETE, INSERT, JOIN = range(5)
SPACE = 1 << 17
WIDTH = 19


def operations(read: str, meant: str) -> tuple[list[int], list[str]]:
    """The operation for every character of ``read`` that leads to ``meant``, and the letters it brings."""
    n = len(read)
    ops, letters = [KEEP] * n, [""] * n
    if not read or read == meant:
        return ops, letters
    most = min(n, len(meant))
    a = 0
    while a < most and read[a] == meant[a]:
        a += 1
    z = 0
    while z < most - a and read[n - 1 - z] == meant[len(meant) - 1 - z]:
        z += 1
    x, y = read[a : n - z], meant[a : len(meant) - z]
    if not x:
        at = min(a, n - 1)
        ops[at], letters[at] = INSERT, y
    elif not y:
        ops[a : n - z] = [DELETE] * len(x)
    elif len(x) == len(y):
        for k, (c, d) in enumerate(zip(x, y, strict=True)):
            if c != d:
                ops[a + k], letters[a + k] = REPLACE, d
    elif len(x) <= 3 and len(y) <= 3:
        ops[a : n - z] = [REPLACE] * len(x)
        letters[a] = y
    else:
        for tag, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if tag == "insert":
                at = min(a + i, n - 1)
                ops[at], letters[at] = INSERT, y[k:m]
            elif tag != "equal":
                for q in range(i, j):
                    ops[a + q] = REPLACE if m > k else DELETE
                    letters[a + q] = y[k:m] if q == i else ""
    return ops, letters


def apply_operations(read: str, ops: list[int], letters: list[str]) -> str:
    """The word after the operations; JOIN keeps its character."""
    out = []
    for c, op, new in zip(read, ops, letters, strict=True):
        out.append(c if op in (KEEP, JOIN) else new if op == REPLACE else new + c if op == INSERT else "")
    return "".join(out)


_U = np.uint64


class Item(NamedTuple):
    """A word to be edited: its first half has ``split`` characters (0: not broken); ``known`` says
    what the lexicon holds of it, ``near`` its neighbour there and ``near_known`` what the lexicon
    holds of that; ``joined`` how the joined form fares against its halves."""

    text: str
    split: int
    mark: int
    known: str
    near: str | None
    near_known: str
    joined: str


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower, shape = np.arange(0x3000, dtype=np.int64), np.arange(0x3000, dtype=np.int64)
    for i in range(0x3000):
        c = chr(i)
        if len(c.lower()) == 1:
            lower[i] = min(ord(c.lower()), 0x2FFF)
        shape[i] = 57 if c.isdigit() else (65 if c.isupper() else 97) if c.isalpha() else i
    return lower, shape


_CASE: list[tuple[np.ndarray, np.ndarray]] = []


def feature(tag: int, *parts: np.ndarray) -> np.ndarray:
    """Numbers below SPACE for combinations of integers."""
    h = np.full(len(parts[0]), tag, dtype=_U)
    for part in parts:
        h = (h ^ part.astype(_U)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return ((h * _U(0xBF58476D1CE4E5B9)) >> _U(64 - 17)).astype(np.int32)


GRAM_SLOTS = 1 << 20


def gram_slot(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The place of three characters in a sketch of GRAM_SLOTS counters."""
    h = ((a << 42) | (b << 21) | c).astype(_U) * _U(0x9E3779B97F4A7C15)
    return ((h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(44)).astype(np.int64)


def gram_slots(words: list[str]) -> np.ndarray:
    """The places of all groups of three characters of words, two marks around each."""
    text = "".join(f"^^{w}$$" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not len(c):
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum([len(w) + 4 for w in words])
    inside = np.ones(len(c), dtype=bool)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    return gram_slot(c[at], c[at + 1], c[at + 2])


def gram_sketch(slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(GRAM_SLOTS, dtype=np.uint8)
    out[slots] = np.minimum(9, np.floor(np.log2(np.maximum(counts, 1))) + 1)
    return out


class Featurizer:
    """Feature numbers (character, feature) of many words at once."""

    def __init__(self, grams: np.ndarray | None = None) -> None:
        """``grams``: for the hash of each group of three characters how often it occurs in the words of
        the lexicon, as a number of bits (``gram_sketch``)."""
        if not _CASE:
            _CASE.append(_tables())
        self.grams = np.zeros(GRAM_SLOTS, dtype=np.uint8) if grams is None else grams
        self.names: dict[str, int] = {}

    def _name(self, s: str) -> int:
        r = self.names.get(s)
        if r is None:
            r = self.names[s] = zlib.crc32(s.encode("utf-8", "surrogatepass"))
        return r

    def features(self, items: list[Item]) -> tuple[np.ndarray, np.ndarray]:
        """The feature matrix of all characters, and where each word ends in it."""
        sizes = np.array([len(i.text) for i in items], dtype=np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        if not n:
            return np.empty((0, WIDTH), dtype=np.int32), ends
        lower, shapes = _CASE[0]
        c = np.frombuffer("".join(i.text for i in items).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        starts = ends - sizes
        full = sizes > 0
        heads, tails = starts[full], ends[full] - 1
        short = np.minimum(c, 0x2FFF)
        low = lower[short]
        shift = lambda x, k, edge: self._shifted(x, k, edge, heads, tails)
        before, after = shift(c, -1, 94), shift(c, 1, 36)
        l1, l2, r1, r2 = shift(low, -1, 94), shift(low, -2, 94), shift(low, 1, 36), shift(low, 2, 36)
        rare = [self._rarity(k) for k in (gram_slot(l2, l1, low), gram_slot(l1, low, r1), gram_slot(low, r1, r2))]
        few, many = np.minimum(np.minimum(rare[0], rare[1]), rare[2]), np.maximum(np.maximum(rare[0], rare[1]), rare[2])
        per = lambda values: np.repeat(np.array(values, dtype=np.int64), sizes)
        least = np.zeros(len(items), dtype=np.int64)
        least[full] = np.minimum.reduceat(few, heads)
        shape = shapes[short]
        letter = (shape == 97) | (shape == 65)
        odd, digits = np.zeros(len(items), dtype=np.int64), np.zeros(len(items), dtype=np.int64)
        odd[full] = np.maximum.reduceat((~letter).astype(np.int64), heads)
        digits[full] = np.maximum.reduceat((shape == 57).astype(np.int64), heads)
        op, new = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        edge = np.zeros(n, dtype=np.int64)
        for item, at in zip(items, starts.tolist(), strict=True):
            if item.near is not None and item.near != item.text:
                o, letters = operations(item.text, item.near)
                for k, x in enumerate(o):
                    if x:
                        op[at + k] = x
                        new[at + k] = self._name(letters[k])
            if item.split:
                edge[at : at + item.split - 1] = 1
                edge[at + item.split - 1] = 2
                edge[at + item.split : at + len(item.text)] = 3
        known = per([self._name(i.known) for i in items])
        kind = per([self._name(i.known[:1]) for i in items])
        near = per([self._name(i.near_known) for i in items])
        joined = per([self._name(i.joined) for i in items])
        mark = per([i.mark for i in items])
        size = per(np.minimum(sizes, 8))
        columns = (
            (1, known),
            (2, known, near),
            (3, known, size),
            (4, c, known),
            (5, before, c, kind),
            (6, c, after, kind),
            (7, before, c, after, kind),
            (8, op, known, near),
            (9, op, c, new, kind),
            (10, op, size, near),
            (11, shift(shape, -1, 94), shape, shift(shape, 1, 36)),
            (12, edge, mark, joined),
            (13, edge, mark, known, joined),
            (14, per(odd), per(digits), known, op),
            (15, joined, mark),
            (16, few, many, known),
            (17, *rare),
            (18, per(least), known, size),
            (19, few, op, c, new),
        )
        return np.stack([feature(*x) for x in columns], axis=1), ends

    @staticmethod
    def _shifted(x: np.ndarray, k: int, edge: int, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """The k-th character after each (before, if negative), ``edge`` beyond the ends of its word."""
        out = x
        for _ in range(abs(k)):
            moved = np.empty_like(out)
            if k > 0:
                moved[:-1] = out[1:]
                moved[tails] = edge
            else:
                moved[1:] = out[:-1]
                moved[heads] = edge
            out = moved
        return out

    def _rarity(self, slots: np.ndarray) -> np.ndarray:
        return self.grams[slots].astype(np.int64)


def letters_brought(pairs: list[tuple[str, str]]) -> dict[tuple[int, str], str]:
    """What replacements and insertions at each character brought most often in pairs ``(read, meant)``."""
    seen: dict[tuple[int, str], Counter] = {}
    for read, meant in pairs:
        for c, op, new in zip(read, *operations(read, meant), strict=True):
            if op in (REPLACE, INSERT):
                seen.setdefault((op, c), Counter())[new] += 1
    return {k: max(n.items(), key=lambda x: (x[1], x[0]))[0] for k, n in seen.items()}


class Editor:
    """The trained weights, and the letters replacements and insertions brought most often; scores all
    characters of many words at once."""

    def __init__(self, weights: np.ndarray, brings: dict[tuple[int, str], str] | None = None):
        self.weights = weights
        self.brings = brings or {}

    def edited(self, text: str, scores: np.ndarray, near: str | None) -> str:
        """The word after the predicted operations. A letter to bring is that of the neighbour, if it has
        the same operation there, else the one learned for the character."""
        best = scores.argmax(axis=1).tolist()
        if not any(KEEP < op < JOIN for op in best):
            return text
        there, letters = operations(text, near) if near is not None else ([KEEP] * len(text), [""] * len(text))
        out = []
        for c, op, same, new in zip(text, best, there, letters, strict=True):
            brought = new if op == same else self.brings.get((op, c), "" if op == INSERT else c)
            out.append(c if op in (KEEP, JOIN) else brought if op == REPLACE else brought + c if op == INSERT else "")
        return "".join(out)

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Scores (character, operation) of a matrix of feature numbers (character, feature)."""
        return self.weights[features].sum(axis=1)


def train(samples: list[tuple[np.ndarray, np.ndarray]], rounds: int = 4, seed: int = 7) -> Editor:
    """Averaged perceptron over words given as (features, operations); updated word by word."""
    rng = np.random.default_rng(seed)
    w = np.zeros((SPACE, 5), dtype=np.float64)
    total = np.zeros_like(w)
    step = 1
    for _ in range(rounds):
        for k in rng.permutation(len(samples)):
            features, gold = samples[k]
            guess = w[features].sum(axis=1).argmax(axis=1)
            wrong = np.flatnonzero(guess != gold)
            for i in wrong:
                f = features[i]
                w[f, gold[i]] += 1.0
                w[f, guess[i]] -= 1.0
                total[f, gold[i]] += step
                total[f, guess[i]] -= step
            step += 1
    averaged = (w - total / step).astype(np.float32)
    return Editor(averaged)
