"""Row filters on text length, token counts and images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.images import checked, checked_all, image_readable
from ..functions.values import column, computed_once, condition, field, free_name, joined_text, truthy
from .base import Filter

MAIN_TEXT = tuple("text content problem question instruction".split())
OTHER_TEXT = tuple("solution answer output response".split())


def all_of(tests: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, tests) if tests else None


def size_within(image: Column, least: list[int] | None, most: list[int] | None) -> Column:
    """Both sides within inclusive bounds; an image whose size isn't known passes."""
    tests = [F.coalesce(image["width"] <= most[0], F.lit(True)) & F.coalesce(image["height"] <= most[1], F.lit(True))] if most else []
    tests += [F.coalesce(image["width"] >= least[0], F.lit(True)) & F.coalesce(image["height"] >= least[1], F.lit(True))] if least else []
    return all_of(tests) if tests else F.lit(True)


class LengthFilter(Filter):
    """``filter``: character limits on the first string column of a fixed list, required fields, readable images.

    An empty or null text passes the limits; a limit of 0 is off.  A row without a
    required field is dropped; with ``compat_skip`` a missing column skips the step.
    """

    type = "filter"

    def required_columns(self) -> list[str]:
        return list(self.config.get("required_fields") or []) if self.config.get("compat_skip") else []

    def keep(self, df: DataFrame) -> Column | None:
        c, tests = self.config, []
        if not c.get("compat_skip"):
            for f in c.get("required_fields") or []:
                tests.append(F.lit(False) if field(df, f) is None else column(f).isNotNull())
        strings = [f for f in (*MAIN_TEXT, *OTHER_TEXT) if isinstance(field(df, f), T.StringType)]
        if strings and (c.get("max_length") or c.get("min_length")):
            n = F.length(F.coalesce(*(F.when(column(f) != "", column(f)) for f in strings), F.lit("")))
            if c.get("max_length"):
                tests.append((n == 0) | (n <= c["max_length"]))
            if c.get("min_length"):
                tests.append((n == 0) | (n >= c["min_length"]))
        if c.get("filter_corrupted_images") and isinstance(field(df, "image"), T.StructType):
            tests.append(column("image").isNull() | image_readable(column("image")))
        return all_of(tests)


class TokenFilter(Filter):
    """``hf_filter``: token limits on the joined truthy text fields, and image checks; a row without text is dropped.

    With ``collect_stats`` a row is counted under every test it fails.
    """

    type = "hf_filter"
    FIELDS = tuple("problem solution question answer text content".split())

    def tests(self, df: DataFrame) -> dict[str, Column]:
        """What a row must pass, by the name of the count of those that don't; a test may be null."""
        c, out = self.config, {}
        tokenizer = self.context.tokenizer
        if tokenizer is not None and (c.get("max_tokens") or c.get("min_tokens")):
            text = joined_text(df, c.get("text_fields") or list(self.FIELDS))
            if text is None:
                return {"no_text_content": F.lit(False)}
            n = tokenizer.count(text)
            out["no_text_content"] = text.isNotNull()
            if c.get("min_tokens"):
                out["token_count_too_low"] = n >= c["min_tokens"]
            if c.get("max_tokens"):
                out["token_count_too_high"] = n <= c["max_tokens"]
        if isinstance(field(df, "image"), T.StructType):
            image, bounds = column("image"), (c.get("min_image_size"), c.get("max_image_size"))
            if c.get("filter_corrupted_images"):
                out["corrupted_image"] = image.isNull() | image_readable(image)
            if any(bounds):
                out["image_size_invalid"] = size_within(checked(image, whole=False), *bounds)
        return out

    def keep(self, df: DataFrame) -> Column | None:
        tests = self.tests(df)
        return F.coalesce(all_of(list(tests.values())), F.lit(False)) if tests else None

    def counts(self, df: DataFrame, keep: Column) -> list[Column]:
        failed = {k: ~F.coalesce(t, F.lit(k in ("token_count_too_low", "token_count_too_high"))) for k, t in self.tests(df).items()}
        several = reduce(lambda a, b: a + b, (f.cast("int") for f in failed.values()), F.lit(0)) > 1
        names = ("no_text_content", "token_count_too_low", "token_count_too_high", "corrupted_image", "image_size_invalid")
        each = [F.count(F.when(failed.get(k, F.lit(False)), 1)).alias(k) for k in names]
        return [F.count("*").alias("total"), F.count(F.when(keep, 1)).alias("passed"), *each, F.count(F.when(several, 1)).alias("multiple_failures")]


class MultimodalFilter(Filter):
    """``multimodal_filter``: images required, readable, within size limits; unreadable ones are taken out of ``images``.

    As in the documented behaviour, size limits count only along with ``filter_corrupted_images``.
    """

    type = "multimodal_filter"

    def _prunes(self, df: DataFrame) -> bool:
        kind = field(df, "images")
        return bool(self.config.get("filter_corrupted_images")) and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)

    def _valid(self, check: Column) -> Column:
        return F.coalesce(check["readable"] & size_within(check, self.config.get("min_image_size"), self.config.get("max_image_size")), F.lit(False))

    def keep(self, df: DataFrame) -> Column | None:
        c, tests = self.config, []
        one, many = field(df, "image"), field(df, "images")
        if c.get("require_images"):
            there = [truthy(column(f), k) for f, k in (("images", many), ("image", one)) if k is not None]
            tests.append(reduce(lambda a, b: a | b, there) if there else F.lit(False))
        if c.get("filter_corrupted_images"):
            if isinstance(one, T.StructType):
                tests.append(column("image").isNull() | self._valid(checked(column("image"))))
            if self._prunes(df):
                tests.append(F.coalesce(F.size("images") == 0, F.lit(True)) | F.exists(self.checks, self._valid))
        return all_of(tests)

    def __call__(self, df: DataFrame) -> DataFrame:
        if not self._prunes(df):
            return super().__call__(df)
        # the files are read once, for the choice of rows and of images
        mark = free_name(df, "checks")
        self.checks = F.col(mark)
        out = super().__call__(computed_once(df, mark, checked_all(column("images"))))
        pairs = F.filter(F.zip_with("images", mark, lambda x, c: F.struct(x.alias("x"), c.alias("c"))), lambda p: self._valid(p["c"]))
        cond = condition(df, self.config.get("condition"))
        pruned = F.transform(pairs, lambda p: p["x"])
        if cond is False or self.skips(df):
            return df
        return out.withColumn("images", pruned if cond is True else F.when(cond, pruned).otherwise(F.col("images"))).drop(mark)


class ImageCountFilter(Filter):
    """``image_count_filter``: a list counts its items, any other truthy value one."""

    type = "image_count_filter"

    @staticmethod
    def count(df: DataFrame, fields: list[str]) -> Column:
        total = F.lit(0)
        for f in fields:
            kind = field(df, f)
            if isinstance(kind, T.ArrayType):
                total = total + F.greatest(F.coalesce(F.size(column(f)), F.lit(0)), F.lit(0))
            elif kind is not None:
                total = total + truthy(column(f), kind).cast("int")
        return total

    def keep(self, df: DataFrame) -> Column | None:
        n = self.count(df, self.config.get("image_fields") or ["images", "image"])
        test = n >= self.config.get("min_images", 0)
        most = self.config.get("max_images")
        return test if most is None or most == float("inf") else test & (n <= most)
