"""``text_toxicity_filter`` and ``image_toxicity_filter``: thresholds here, scores from a plug-in."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import column, field, joined_text
from .base import Filter

TYPES = tuple("toxicity severe_toxicity obscene threat insult identity_attack sexual_explicit".split())
Scorer = Callable[[Column], dict[str, Column]]


def lexicon_scorer(words: dict[str, list[str]]) -> Scorer:
    """The default, without a model: a type's score is 1 - 2^-k for k occurrences of its words."""

    def score(text: Column) -> dict[str, Column]:
        count = lambda w: F.regexp_count(F.lower(text), F.lit(r"(?U)\b(?:" + "|".join(map(re.escape, w)) + r")\b"))
        return {k: 1 - F.pow(F.lit(2.0), -count(w)) for k, w in words.items()}

    return score


DEFAULT_WORDS = {"toxicity": ["hate", "idiot", "stupid", "moron", "loser", "disgusting", "clown"], "insult": ["idiot", "stupid", "moron", "loser", "clown"]}


class TextToxicityFilter(Filter):
    """Drops a row if any, or all, of the checked types score above their thresholds.

    A type the scorer doesn't know can't exceed its threshold, so ``all`` never holds
    then; a row without text, and one whose score is null, pass.
    """

    type = "text_toxicity_filter"
    FIELDS = tuple("text content problem solution question answer".split())

    def keep(self, df: DataFrame) -> Column | None:
        c = self.config
        text = joined_text(df, c.get("text_fields") or list(self.FIELDS))
        if text is None:
            return None
        scorer: Scorer = self.context.scorers.get("text") or lexicon_scorer(c.get("words") or DEFAULT_WORDS)
        scores = scorer(text)
        check = c.get("check_types") or list(TYPES[:6])
        over = [F.coalesce(scores[k] > float(c.get(f"{k}_threshold", 0.5)), F.lit(False)) if k in scores else F.lit(False) for k in check]
        join = (lambda a, b: a & b) if c.get("filter_mode", "any") == "all" else (lambda a, b: a | b)
        return text.isNull() | ~reduce(join, over)


def category_matrix(vectors: list[list[float]]) -> list[list[float]]:
    x = np.asarray(vectors, float)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).tolist()


def safety_tag(embedding: Column, neutral: list[list[float]], nsfw: list[list[float]], underage: list[list[float]], underage_threshold: float = 0.3) -> Column:
    """UNLIKELY, UNSURE, NSFW or UNDERAGE_RISK of an image embedding, by its two most similar categories.

    Categories are numbered neutral, nsfw, underage; of equal similarities the smaller number is first.
    """
    matrix = category_matrix([*neutral, *nsfw, *underage])
    norm = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = F.array(*(F.array(*map(F.lit, r)) for r in matrix))
    dot = lambda row: F.aggregate(F.zip_with(row, embedding, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    # of one embedding, products are ordered as cosines are
    products = F.transform(rows, dot)
    top = F.slice(F.array_sort(F.transform(products, lambda d, i: F.struct((-d).alias("d"), i.alias("i")))), 1, 2)
    first, last = len(neutral), len(neutral) + len(nsfw)
    hits = F.size(F.filter(top, lambda t: (t["i"] >= first) & (t["i"] < last)))
    young = F.array_max(F.slice(products, last + 1, max(1, len(underage)))) > underage_threshold * norm if underage else F.lit(False)
    return F.when(embedding.isNull(), None).when(hits == 0, "UNLIKELY").when(young, "UNDERAGE_RISK").when(hits == 2, "NSFW").otherwise("UNSURE")


NEUTRAL, NSFW, UNDERAGE = ("an everyday photo", "a drawing or diagram", "a photo of nature or a building"), ("a nude person", "sexual content"), ("a child", "a teenager")


class Encoder(Protocol):
    """A plug-in for images, as ``context.scorers["image"]``: texts and images as vectors of one space."""

    def texts(self, categories: list[str]) -> list[list[float]]: ...

    def images(self, images: Column) -> Column:
        """A list of vectors for a list of images; null for an image that can't be read."""
        ...


class ImageToxicityFilter(Filter):
    """Drops a row if the tag of any of its images is one that is filtered; rows without images pass.

    Vectors of categories are configured, or the encoder's of their names; images are
    encoded (``image_fields``), or come as vectors (``embedding_fields``).
    """

    type = "image_toxicity_filter"

    def vectors(self, kind: str, names: tuple[str, ...]) -> list[list[float]]:
        """Of one kind of category, of length 1."""
        given = self.config.get(f"{kind}_vectors")
        encoder: Encoder | None = self.context.scorers.get("image")
        if given is None and encoder is not None:
            given = encoder.texts(list(self.config.get(f"{kind}_categories", names)))
        if given is None and kind != "underage":
            raise ValueError(f"image_toxicity_filter needs {kind}_vectors, or an encoder among the scorers")
        return category_matrix(given) if given else []

    def keep(self, df: DataFrame) -> Column | None:
        c, tests = self.config, []
        bad = [t for t, k in (("NSFW", "filter_nsfw"), ("UNSURE", "filter_unsure"), ("UNDERAGE_RISK", "filter_underage_risk")) if c.get(k, True)]
        neutral, nsfw, underage = (self.vectors(k, v) for k, v in (("neutral", NEUTRAL), ("nsfw", NSFW), ("underage", UNDERAGE)))
        tag = lambda v: safety_tag(v, neutral, nsfw, underage, float(c.get("underage_threshold", 0.3))).isin(bad)
        for f in c.get("embedding_fields") or ["embedding", "embeddings"]:
            kind = field(df, f)
            if isinstance(kind, T.ArrayType):
                nested = isinstance(kind.elementType, T.ArrayType)
                tests.append(F.coalesce(F.exists(column(f), tag) if nested else tag(column(f)), F.lit(False)))
        encoder: Encoder | None = self.context.scorers.get("image")
        for f in (c.get("image_fields") or ["image", "images"]) if encoder is not None else ():
            kind = field(df, f)
            many = isinstance(kind, T.ArrayType)
            if isinstance(kind.elementType if many else kind, T.StructType):
                images = column(f) if many else F.when(column(f).isNotNull(), F.array(column(f)))
                tests.append(F.coalesce(F.exists(encoder.images(images), tag), F.lit(False)))
        return ~reduce(lambda a, b: a | b, tests) if tests and bad else None
