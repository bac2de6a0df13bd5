"""Operator 1: edit-aware token counts.

A text is cut into leaves, runs of whole pre-tokens of about ``LEAF_CHARS``
characters, and a segment tree holds (characters, tokens) for every span of
leaves.  An edit re-encodes only the leaves that it touches, widened by a leaf
where a cut is no longer a pre-token boundary, and updates the sums above them;
untouched leaves keep their counts.  The result equals encoding the edited text.

A cut lies before a space or newline that follows a character that isn't white
space.  No alternative of the byte-level BPE pattern crosses from other
characters into white space, and its look-ahead only matters after white space,
so the two sides are pre-tokenised independently there.

Cases: a null text counts as null; an empty text has one leaf of 0 tokens; a text
without a cut is one leaf, however long; edits are applied in order of start, an
edit that overlaps an earlier one is ignored, a range is clipped to the text; null
ids and repeated rows are counted row by row; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 256
PART_CHARS = 1 << 16
_CUT = re.compile(r"(?<=\S)[ \n]")

#: What the query edits out: addresses, telephone numbers and licence lines, as a cleaning step would.
EDITS = (
    # from the start of a run only, and without giving back: linear also in a run without an @
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<email>"),
    (r"\+?\d[\d ()-]{7,}\d", "<phone>"),
    (r"(?m)^(?:Licensed under|Released under|This work is licensed)[^\n]*\n?", ""),
)
Edit = tuple[int, int, str]
_encoders: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(vocabulary: str) -> Callable[[list[str]], list[int]]:
    """Counts of texts under the vocabulary in a .tiktoken file, loaded once a process."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[vocabulary] = lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    return _encoders[vocabulary]


def _is_cut(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in " \n" and not text[at - 1].isspace()


def leaf_ends(text: str, start: int = 0, end: int | None = None, chars: int = LEAF_CHARS) -> list[int]:
    """Ends of the leaves of text[start:end]: the first cut at least ``chars`` after the last."""
    end = len(text) if end is None else end
    out, at = [], start
    while (m := _CUT.search(text, at + chars, end)) is not None:
        out.append(at := m.start())
    return [*out, end]


class TokenTree:
    """A segment tree over the leaves of one text; node k has children 2k and 2k+1, leaves start at ``base``."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]]):
        self.text, self.count, self.reencoded = text, count, 0
        ends = leaf_ends(text)
        starts = [0, *ends[:-1]]
        self._build(np.subtract(ends, starts), np.asarray(count([text[a:b] for a, b in zip(starts, ends)])))

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.n = len(chars)
        self.base = 1 << max(0, self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.base, 2), np.int64)
        self.sums[self.base : self.base + self.n, 0] = chars
        self.sums[self.base : self.base + self.n, 1] = tokens
        at = self.base
        while at > 1:
            self.sums[at // 2 : at] = self.sums[at : 2 * at : 2] + self.sums[at + 1 : 2 * at : 2]
            at //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, char: int) -> int:
        """The leaf that holds a character; the last one for the text's end."""
        k = 1
        while k < self.base:
            k *= 2
            if char >= self.sums[k, 0] and self.sums[k + 1, 0] > 0:
                char -= int(self.sums[k, 0])
                k += 1
        return k - self.base

    def before(self, leaf: int) -> tuple[int, int]:
        """Characters and tokens of the leaves before one: a walk to the root."""
        k, chars, tokens = leaf + self.base, 0, 0
        while k > 1:
            if k % 2:
                chars, tokens = chars + int(self.sums[k - 1, 0]), tokens + int(self.sums[k - 1, 1])
            k //= 2
        return chars, tokens

    def apply(self, edits: Iterable[Edit]) -> TokenTree:
        """Applies edits given in the coordinates of the present text."""
        todo, pieces, grown, at = [], [], [0], 0
        for a, b, new in sorted(edits, key=lambda e: e[:2]):
            a, b = max(0, min(a, len(self.text))), min(b, len(self.text))
            if at <= a <= b:
                todo.append((a, b))
                pieces += [self.text[at:a], new]
                grown.append(grown[-1] + len(new) - (b - a))
                at = b
        if not todo:
            return self
        text, begins = "".join([*pieces, self.text[at:]]), [a for a, _ in todo]

        def moved(leaf: int) -> int | None:
            """Where a leaf begins in the new text; None if an edit spans its beginning."""
            if leaf == self.n:
                return len(text)
            place = self.before(leaf)[0]
            k = bisect_left(begins, place)
            return None if k and todo[k - 1][1] > place else place + grown[k] if leaf else 0

        touched = {leaf for a, b in todo for leaf in range(self.find(a), self.find(max(a, b - 1)) + 1)}
        context = set()  # both sides of a beginning that is no cut any more; their other ends are as they were
        for leaf in {x for k in touched for x in (k, k + 1) if 0 < x < self.n}:
            place = moved(leaf)
            if place is None or not _is_cut(text, place):
                context |= {leaf - 1, leaf}
        chars, tokens = (self.sums[self.base : self.base + self.n, c].tolist() for c in (0, 1))
        new_chars, new_tokens, slots, spans, done, same_shape = [], [], [], [], 0, True
        for leaf in sorted(touched | context):
            if leaf < done:
                continue
            last = leaf
            while last + 1 in touched or last + 1 in context:
                last += 1
            new_chars += chars[done:leaf]
            new_tokens += tokens[done:leaf]
            start, end = moved(leaf), moved(last + 1)
            ends = leaf_ends(text, start, end)
            same_shape &= len(ends) == last - leaf + 1
            for s, e in zip([start, *ends[:-1]], ends):
                slots.append(len(new_chars))
                spans.append(text[s:e])
                new_chars.append(e - s)
                new_tokens.append(0)
            done = last + 1
        new_chars += chars[done:]
        new_tokens += tokens[done:]
        for leaf, c in zip(slots, self.count(spans)):
            new_tokens[leaf] = c
        self.text, self.reencoded = text, self.reencoded + sum(map(len, spans))
        if not same_shape:
            self._build(np.asarray(new_chars), np.asarray(new_tokens))
            return self
        for leaf in slots:  # only the paths from the changed leaves to the root
            k = leaf + self.base
            self.sums[k] = new_chars[leaf], new_tokens[leaf]
            while k > 1:
                k //= 2
                self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]
        return self


def bpe_tokens(text: str = "text", vocabulary: str = VOCABULARY) -> Column:
    """Tokens of whole texts under the vocabulary; null and empty text: 0.  A text is encoded in parts of about PART_CHARS."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        count, out = counter(vocabulary), []
        for t in texts:
            t = t.as_py() or ""
            ends = leaf_ends(t, chars=PART_CHARS)
            out.append(sum(count([t[a:b] for a, b in zip([0, *ends[:-1]], ends)])))
        return pa.array(out, pa.int64())

    return counted(F.col(text).cast("string"))


def find_edits(text: str, rules: Iterable[tuple[str, str]] = EDITS) -> list[Edit]:
    return [(*m.span(), new) for pattern, new in rules for m in re.finditer(pattern, text)]


SCHEMA = "doc_id long, tokens long, edits int, tokens_after long, leaves int, reencoded_chars long, chars_after long"


def count_with_edits(docs: DataFrame, vocabulary: str = VOCABULARY, edits: Callable[[str], list[Edit]] = find_edits) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its tokens, and those after the edits that ``edits`` gives for its text.

    A map over Arrow batches: no shuffle, and a task holds the tree of one text at a time.
    """
    small_batches(docs)

    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if t is None:
                        rows.append((i, None, 0, None, 0, 0, None))
                        continue
                    tree = TokenTree(t, count)
                    before, e = tree.tokens, edits(t)
                    tree.apply(e)
                    rows.append((i, before, len(e), tree.tokens, tree.n, tree.reencoded, len(tree.text)))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
