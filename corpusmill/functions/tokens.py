"""Tokenizers: one of a regular expression, numbered and hashed over bytes in Arrow batches, and adapters for real ones."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .batches import MULTIPLIER, gram_sets, mix, slices, span_hashes, text_bytes, token_counts, token_spans

PATTERN = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"
#: Vocabulary files by their last name: what reads them.
KINDS = {"json": "tokenizers", "tiktoken": "tiktoken", "model": "sentencepiece"}
#: How byte-level BPE vocabularies in tiktoken's form cut a text.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Loaded:
    """A vocabulary: ids and tokens of texts, the id of one token, and the text of ids."""

    def __init__(self, kind: str, data: bytes, added: tuple[str, ...] = ()):
        if kind == "tokenizers":
            from tokenizers import Tokenizer

            made = Tokenizer.from_str(data.decode())
            made.add_tokens(list(added))
            self.ids = lambda texts: [e.ids for e in made.encode_batch(texts, add_special_tokens=False)]
            self.tokens = lambda texts: [e.tokens for e in made.encode_batch(texts, add_special_tokens=False)]
            self.id = made.token_to_id
            self.decode = lambda ids: made.decode(ids, skip_special_tokens=False)
        elif kind == "tiktoken":
            import tiktoken

            ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, data.splitlines())}
            extra = {t: max(ranks.values()) + 1 + k for k, t in enumerate(added)}
            made = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=extra)
            self.ids = lambda texts: [made.encode(t, allowed_special=set(extra), disallowed_special=()) for t in texts]
            self.tokens = lambda texts: [[made.decode([i]) for i in ids] for ids in self.ids(texts)]
            self.id = lambda t: extra.get(t, ranks.get(t.encode()))
            self.decode = made.decode
        else:
            import sentencepiece

            made = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.ids = lambda texts: made.encode(texts, num_threads=1)
            self.tokens = lambda texts: made.encode(texts, out_type=str, num_threads=1)
            self.decode = made.decode
            unknown = made.unk_id()
            self.id = lambda t: i if (i := made.piece_to_id(t)) != unknown or t == made.id_to_piece(unknown) else None


_sent: dict[tuple, object] = {}


def native_id(token: str, vocabulary: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % vocabulary


@dataclass(frozen=True)
class TokenizerSpec:
    """What a tokenizer is: how to count, split and number tokens, and its special ids.

    ``path`` names a vocabulary file (``KINDS``), read on the driver, sent to the
    workers and loaded once by each; without it the native one is used, whose ids are
    28 bits of a token's MD5 modulo ``vocabulary``.
    """

    path: str | None = None
    lower: bool = False
    vocabulary: int = 1_000_000
    eos_id: int = 2
    bos_id: int | None = None
    pad_id: int | None = None
    padding_side: str = "right"
    special_tokens: dict = field(default_factory=dict, hash=False)
    added_tokens: tuple[str, ...] = ()

    @property
    def padding(self) -> int:
        return self.eos_id if self.pad_id is None else self.pad_id

    @property
    def kind(self) -> str | None:
        return KINDS.get(self.path.rsplit(".", 1)[-1]) if self.path else None

    def loaded(self) -> Loaded:
        with open(self.path, "rb") as f:
            return Loaded(self.kind, f.read(), self.added_tokens)

    def _encoder(self) -> Callable[[], Loaded]:
        """For a worker: the vocabulary, whose file only the driver has to have."""
        spark = SparkSession.getActiveSession()
        key, kind, added = (spark.sparkContext.applicationId, self.path, os.stat(self.path).st_mtime_ns), self.kind, self.added_tokens
        if key not in _sent:
            with open(self.path, "rb") as f:
                _sent[key] = spark.sparkContext.broadcast(f.read())  # one vocabulary
        data, memo = _sent[key], []

        def get() -> Loaded:
            if not memo:
                memo.append(Loaded(kind, data.value, added))
            return memo[0]

        return get

    def _text(self, col: Column) -> Column:
        return F.lower(col) if self.lower else col

    def _per_slice(self, kind: str, native: Callable, encoded: Callable) -> Callable[[Column], Column]:
        """An Arrow function of texts, a slice at a time: of their bytes, or of the vocabulary and the texts."""
        get = self._encoder() if self.path else None

        @F.arrow_udf(kind)
        def run(texts: pa.Array) -> pa.Array:
            parts = [x.column(0) for x in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), "t")]
            out = [native(x) if get is None else encoded(get(), pc.fill_null(x, "").to_pylist()) for x in parts] or [native(texts) if get is None else encoded(get(), [])]
            out = pa.concat_arrays(out)
            return pc.if_else(pc.is_null(texts), pa.scalar(None, out.type), out) if texts.null_count else out

        return run

    def count(self, col: Column) -> Column:
        counts = lambda n: pa.array(np.asarray(n, np.int32))
        return self._per_slice("int", lambda x: counts(token_counts(x)), lambda v, t: counts([len(i) for i in v.ids(t)]))(self._text(col))

    def tokens(self, col: Column) -> Column:
        if self.path:
            return self._per_slice("array<string>", lambda x: x, lambda v, t: pa.array(v.tokens(t), pa.list_(pa.string())))(self._text(col))
        return F.regexp_extract_all(self._text(col), F.lit(PATTERN), F.lit(0))

    def gram_hashes(self, col: Column, n: int) -> Column:
        """The distinct n-grams of a text as 64-bit hashes."""

        def listed(sets: list[np.ndarray]) -> pa.Array:
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))

        return self._per_slice("array<bigint>", lambda x: listed(gram_sets(x, n)), lambda v, t: listed([_id_grams(i, n) for i in v.ids(t)]))(self._text(col))

    def ids(self, col: Column, most: int | None = None) -> Column:
        """The ids of a text's first ``most`` tokens, or of all; what is cut off isn't numbered."""
        cut = slice(most)

        def native(texts: pa.Array) -> pa.Array:
            data, offs = text_bytes(texts)
            a, b, of = token_spans(data, offs)
            if most is not None:
                keep = np.arange(len(of)) - np.searchsorted(of, of) < most
                a, b, of = a[keep], b[keep], of[keep]
            _, first, back = np.unique(span_hashes(data, a, b), return_index=True, return_inverse=True)
            numbers = np.array([native_id(data[x:y].tobytes().decode(), self.vocabulary) for x, y in zip(a[first].tolist(), b[first].tolist())], np.int32)
            ends = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers[back] if len(back) else np.zeros(0, np.int32)))

        return self._per_slice("array<int>", native, lambda v, t: pa.array([i[cut] for i in v.ids(t)], pa.list_(pa.int32())))(self._text(col))


def _id_grams(ids: list[int], n: int) -> np.ndarray:
    h = mix(np.asarray(ids, np.uint64) + np.uint64(1))
    k = max(0, len(h) - n + 1)
    g = np.zeros(k, np.uint64)
    for j in range(n if k else 0):
        g = (g + h[j : k + j]) * MULTIPLIER
    return np.unique(mix(g).view(np.int64))


def vocabulary_file(name: str) -> str:
    """The file of a tokenizer that a configuration names: a file, or a folder with a tokenizer in it."""
    names = [name] if os.path.isfile(name) else [os.path.join(name, x) for x in ("tokenizer.json", "tokenizer.model", "tokenizer.tiktoken")]
    for path in names:
        if os.path.isfile(path) and path.rsplit(".", 1)[-1] in KINDS:
            return path
    raise ValueError(f"tokenizer {name} can't be loaded: it is no vocabulary file ({', '.join(KINDS)}) and no folder with one; models aren't fetched")


def _own_specials(name: str) -> dict:
    """The special tokens that a tokenizer's folder states."""
    path = os.path.join(name, "tokenizer_config.json")
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    text = {k: v["content"] if isinstance(v, dict) else v for k, v in stated.items() if k in ("eos_token", "bos_token", "pad_token", "unk_token")}
    return {k: v for k, v in text.items() if v is not None} | ({"padding_side": stated["padding_side"]} if stated.get("padding_side") else {})


def load_tokenizer(cfg: dict) -> TokenizerSpec:
    """From a run's configuration: ``tokenizer_config``, else ``base_model``, or ``tokenizer_file``; ``native`` is the native one.

    Special tokens are ids or tokens; one that the vocabulary lacks, and a tokenizer
    that can't be loaded, are errors.  Padding is EOS where it isn't set.
    """
    name = cfg.get("tokenizer_file") or cfg.get("tokenizer_config") or cfg.get("base_model") or "native"
    path = None if name == "native" else vocabulary_file(str(name))
    special = (_own_specials(str(name)) if path else {}) | dict(cfg.get("special_tokens") or {})
    if (cfg.get("special_tokens") or {}).get("pad_token") == "</s>":
        special.pop("pad_token")
    side = cfg.get("tokenizer_pad_side") or cfg.get("padding_side") or special.pop("padding_side", "right")
    special.pop("padding_side", None)
    spec = TokenizerSpec(path=path, lower=bool(cfg.get("tokenizer_lower", False)), padding_side=side, special_tokens=special, added_tokens=tuple(cfg.get("tokens") or ()))
    known = spec.loaded() if path else None

    def number(which: str) -> int | None:
        token = special.get(which)
        if token is None or isinstance(token, int):
            return token
        found = native_id(token, spec.vocabulary) if known is None else known.id(token)
        if found is None:
            raise ValueError(f"{which} {token!r} isn't in the vocabulary of {name}; add it to tokens")
        return found

    eos = number("eos_token")
    return replace(spec, eos_id=TokenizerSpec.eos_id if eos is None else eos, bos_id=number("bos_token"), pad_id=number("pad_token"))
