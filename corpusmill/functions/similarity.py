"""Indel similarity: 200 * LCS / (len a + len b)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 64
#: Strings whose logarithms of length are so near lie together.
LENGTHS = 0.2
#: What a step costs besides its bits, in bits.
STEP = 2000


def lcs_length(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence, bit-parallel; 0 once ``least`` is out of reach."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << m) - 1
    s, n = full, len(b)
    for k, c in enumerate(b):
        u = s & masks.get(c, 0)
        if u:
            s = ((s + u) | (s - u)) & full
        if least and not k & 31 and m - s.bit_count() + n - k - 1 < least:
            return 0
    return m - s.bit_count()


def ratio(a: str, b: str, cutoff: float = 0.0) -> float:
    """The similarity in per cent; 0 below the cutoff; 100 for two empty strings."""
    total = len(a) + len(b)
    if not total:
        return 100.0
    if a == b:
        return 100.0
    got = 200.0 * lcs_length(a, b, math.ceil(cutoff * total / 200 - 1e-9)) / total
    return got if got >= cutoff else 0.0


def _classes(cutoff: float, longest: int) -> int:
    """Into how many classes of characters texts are divided: unrelated ones have to stay below the cutoff in the sum."""
    return 1 if longest < 200 else next(k for least, k in ((90, 8), (85, 6), (78, 4), (72, 3), (65, 2), (-math.inf, 1)) if cutoff >= least)


def _kinds(bags: np.ndarray) -> np.ndarray:
    """Texts with like shares of characters, as those of one language have, get one number."""
    share = bags / np.maximum(bags.sum(axis=1, keepdims=True), 1)
    share -= share.mean(axis=0, keepdims=True) if len(share) else 0
    axes = np.linalg.eigh(share.T @ share)[1][:, -3:]
    return (share @ axes > 0) @ np.array([1, 2, 4])


class Matcher:
    """Which of a list of strings have a ratio of at least ``cutoff`` to a text.

    An LCS is no longer than the sum of those over classes of characters, each of the
    characters of one class alone; over k classes of equal weight they cost a k-th.
    Characters are divided by what is frequent in the strings.  The strings lie by length
    and shares of characters in chunks; a chunk's strings share one wide integer for each
    class, a guard bit above each taking its carry, so a pass over a text's characters of
    the class gives the LCS with all of them.  A chunk is left when lengths, bags and the
    classes so far rule all of it out; what isn't ruled out is verified.
    """

    def __init__(self, strings: list[str], cutoff: float, chars: int = 1 << 16):
        lengths, bags = np.array([len(x) for x in strings], np.int64), bag(pd.Series(strings, dtype=object))
        self.cutoff, self.order = cutoff, np.lexsort((lengths, _kinds(bags), np.log(lengths + 1) // LENGTHS))
        self.strings, self.lengths, self.bags = [strings[k] for k in self.order], lengths[self.order], bags[self.order]
        self.n = _classes(cutoff, int(self.lengths.max(initial=0)))
        self.of_bin, load = np.zeros(BINS, np.int64), np.zeros(self.n, np.int64)
        weight = self.bags.sum(axis=0, dtype=np.int64)
        for k in np.argsort(-weight, kind="stable"):
            self.of_bin[k] = np.argmin(load)
            load[self.of_bin[k]] += weight[k]
        self.one_hot = np.eye(self.n, dtype=np.int32)[self.of_bin]
        self.ends = ends = np.cumsum(self.lengths + 1)
        cuts = np.flatnonzero(np.diff((ends - 1) // chars)) + 1 if len(ends) else []
        self.spans = [(int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(ends)]) if a < b]
        self.packed: dict[tuple[int, int], tuple] = {}

    def _split(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = _codes(text)
        return codes, self.of_bin[codes % BINS]

    def _pack(self, chunk: int, k: int) -> tuple:
        """(starts, lengths, bits, masks by character, all bits) of a chunk's characters of class k."""
        if (chunk, k) not in self.packed:
            parts = [codes[of == k] for codes, of in map(self._split, self.strings[slice(*self.spans[chunk])])]
            sizes = np.array([len(x) for x in parts])
            starts, total = np.cumsum(sizes + 1) - sizes - 1, int(sizes.sum()) + len(sizes)
            codes, at = np.concatenate(parts), np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)

            def wide(places: np.ndarray) -> int:
                bits = np.zeros(total, np.uint8)
                bits[places] = 1
                return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

            by = np.argsort(codes, kind="stable")
            known, first = np.unique(codes[by], return_index=True)
            self.packed[chunk, k] = starts, sizes, total, dict(zip(known.tolist(), map(wide, np.split(at[by], first[1:])))), wide(at)
        return self.packed[chunk, k]

    def _lcs(self, chunk: int, k: int, codes: list[int]) -> np.ndarray:
        starts, sizes, total, masks, full = self._pack(chunk, k)
        s, get = full, masks.get
        for c in codes:
            m = get(c)
            if m:
                u = s & m
                if u:
                    s = ((s + u) | (s ^ u)) & full
        bits = np.unpackbits(np.frombuffer(s.to_bytes(total // 8 + 1, "little"), np.uint8), count=total, bitorder="little")
        return sizes - np.add.reduceat(bits, starts, dtype=np.int64)

    def matches(self, text: str, among: np.ndarray | None = None):
        """(place, ratio) of the strings, chunk by chunk; ``among``: whether a string counts."""
        n, own, parts, ends = len(text), None, {}, self.ends
        for chunk, (a, b) in enumerate(self.spans):
            lengths = self.lengths[a:b]
            total = lengths + n
            least = self.cutoff * total - 1e-6
            ok = (200.0 * np.minimum(lengths, n) >= least) | (total == 0)
            if among is not None:
                ok &= among[self.order[a:b]]
            if not ok.any():
                continue
            if own is None:
                own, (codes, of) = bag(pd.Series([text]))[0], self._split(text)
            at = np.flatnonzero(ok)
            bound = np.minimum(self.bags[a + at], own) @ self.one_hot
            likely = (200.0 * bound.sum(axis=1) >= least[at]) | (total[at] == 0)
            at, bound = at[likely], bound[likely]
            exact = False
            for k in range(self.n):
                bits = int(ends[b - 1] - ends[a]) / self.n
                if len(at) * (STEP + n) <= (STEP + bits) * (self.n - k) / self.n:
                    break  # one by one is cheaper
                if k not in parts:
                    parts[k] = codes[of == k].tolist()
                bound[:, k], exact = self._lcs(chunk, k, parts[k])[at], self.n == 1
                likely = (200.0 * bound.sum(axis=1) >= least[at]) | (total[at] == 0)
                at, bound = at[likely], bound[likely]
            for j, x in zip(at.tolist(), bound):
                got = (200.0 * int(x[0]) / int(total[j]) if total[j] else 100.0) if exact else ratio(self.strings[a + j], text, self.cutoff)
                if got >= self.cutoff:
                    yield int(self.order[a + j]), got

    def hit(self, text: str) -> bool:
        return any(True for _ in self.matches(text))


def ratio_column(a: Column, b: Column, cutoff: float = 0.0) -> Column:
    @F.pandas_udf("double")
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q, cutoff) if p is not None and q is not None else None for p, q in zip(x, y)], dtype="float64")

    return scored(a, b)


def short_lcs(a: Column, b: Column) -> Column:
    """The LCS length of strings of at most 62 characters as a native expression."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    position = F.transform(chars(a), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    full = F.expr("bigint(1)")

    def mask(ch: Column) -> Column:
        return F.aggregate(position, F.lit(0).cast("long"), lambda acc, p: F.when(p["c"] == ch, acc.bitwiseOR(F.call_function("shiftleft", full, p["i"]))).otherwise(acc))

    ones = F.call_function("shiftleft", full, F.length(a)) - 1

    def step(s: Column, ch: Column) -> Column:
        u = s.bitwiseAND(mask(ch))
        return (s + u).bitwiseOR(s - u).bitwiseAND(ones)

    return F.length(a) - F.bit_count(F.aggregate(chars(b), ones, step))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def bag(texts: pd.Series) -> np.ndarray:
    """A folded character histogram: the sum of minima of two bounds their LCS from above."""
    out = np.zeros((len(texts), BINS), np.int32)
    for k, t in enumerate(texts):
        out[k] = np.bincount(_codes(t) % BINS, minlength=BINS)
    return out
