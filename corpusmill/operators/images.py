"""``image_transform``: a chain of image operations in one Arrow-batched pass over the pixels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.images import IMAGE_TYPE, decode, encode
from ..functions.values import column, condition, field, free_name
from .base import Processor

KERNELS = {
    "bilinear": (1.0, lambda x: np.maximum(0, 1 - np.abs(x))),
    "bicubic": (2.0, lambda x: np.where((x := np.abs(x)) < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)),
}


def _weights(old: int, new: int, method: str) -> np.ndarray:
    """[new, old] resampling weights, the kernel widened when shrinking."""
    scale = old / new
    if method == "nearest":
        return np.eye(old)[(2 * np.arange(new) + 1) * old // (2 * new)]
    support, kernel = KERNELS[method]
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    w = kernel((np.arange(old)[None] + 0.5 - centre[:, None]) / wide)
    w[np.abs(np.arange(old)[None] + 0.5 - centre[:, None]) > support * wide] = 0
    return w / w.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, width: int, height: int, method: str = "bilinear") -> np.ndarray:
    h, w = x.shape[:2]
    out = np.einsum("ij,jkc->ikc", _weights(h, height, method), x.astype(float)) if height != h else x.astype(float)
    out = np.einsum("ij,kjc->kic", _weights(w, width, method), out) if width != w else out
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def fitted_size(w: int, h: int, most: tuple[int, int]) -> tuple[int, int]:
    f = min(1.0, most[0] / w, most[1] / h)
    return max(1, round(w * f)), max(1, round(h * f))


def fill(x: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """The middle of the image in the target's proportions, scaled to it."""
    h, w = x.shape[:2]
    f = min(w / size[0], h / size[1])
    cw, ch = max(1, round(size[0] * f)), max(1, round(size[1] * f))
    left, top = (w - cw) // 2, (h - ch) // 2
    return resample(x[top : top + ch, left : left + cw], *size, method="lanczos")


def luma(x: np.ndarray) -> np.ndarray:
    """Luma in the usual fixed-point form: 16 bits of fraction, rounded."""
    if x.shape[2] < 3:
        return x[..., :1]
    r, g, b = (x[..., k].astype(np.int64) for k in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 0x8000) >> 16).astype(np.uint8)[..., None]


def blend(grey: np.ndarray | int, x: np.ndarray, factor: float) -> np.ndarray:
    """From ``grey`` towards or past the image; each step is cut to whole values of a byte."""
    return np.clip(grey + np.float32(factor) * (x.astype(np.float32) - grey), 0, 255).astype(np.uint8)


def jitter(x: np.ndarray, brightness: float = 0, contrast: float = 0, saturation: float = 0) -> np.ndarray:
    if brightness > 0:
        x = blend(0, x, 1 + 0.5 * brightness)
    if contrast > 0:
        x = blend(int(luma(x).mean() + 0.5), x, 1 + 0.5 * contrast)
    if saturation > 0 and x.shape[2] >= 3:
        x = blend(luma(x).astype(np.float32), x, 1 + 0.5 * saturation)
    return x


def regular(x: np.ndarray, most: int | None, least: int | None) -> np.ndarray:
    """Three channels, and a number of pixels within a budget, in the image's proportions."""
    for limit, over in ((most, True), (least, False)):
        h, w = x.shape[:2]
        if limit and (w * h > limit if over else w * h < limit):
            f = math.sqrt(limit / (w * h))
            x = resample(x, max(1, int(w * f)), max(1, int(h * f)), "bicubic")
    return x[..., :3] if x.shape[2] >= 3 else np.repeat(x[..., :1], 3, axis=2)


def _pair(size) -> tuple[int, int]:
    return (int(size), int(size)) if isinstance(size, int) else (int(size[0]), int(size[1]))


def apply_one(x: np.ndarray, t: dict, method: str, mode: str) -> np.ndarray:
    kind = t["type"]
    if kind == "resize":
        how = t.get("interpolation", method)
        if (t.get("mode") or mode) == "keep_aspect_ratio" and not isinstance(t["size"], int):
            return resample(x, *fitted_size(x.shape[1], x.shape[0], _pair(t["size"])), method="lanczos")
        if isinstance(t["size"], int):
            h, w = x.shape[:2]
            return resample(x, w * t["size"] // min(h, w), h * t["size"] // min(h, w), how)
        return resample(x, *_pair(t["size"]), method=how)
    if kind in ("center_crop", "random_crop"):
        return fill(x, _pair(t["size"]))
    if kind == "resized_crop":
        a, b = int(t.get("left", 0)), int(t.get("top", 0))
        w, h = int(t.get("width", x.shape[1])), int(t.get("height", x.shape[0]))
        return resample(x[b : b + h, a : a + w], *_pair(t["size"]))
    if kind == "grayscale":
        return np.repeat(luma(x), int(t.get("num_output_channels", 1)), axis=2)
    if kind == "regular":
        return regular(x, t.get("max_pixels"), t.get("min_pixels"))
    if kind == "color_jitter":
        return jitter(x, t.get("brightness", 0), t.get("contrast", 0), t.get("saturation", 0))
    raise ValueError(f"unknown image transform: {kind}")


PIXELS = tuple("resize center_crop random_crop resized_crop grayscale color_jitter regular".split())
TENSOR = ("to_tensor", "normalize", "to_pil")


class ImageTransform(Processor):
    """Null images are left alone.  An image that fails is left as it is, or with ``skip_on_error`` false its row is dropped.

    ``output_format: tensor`` gives channels x height x width floats of 0 to 1, normalised if so configured.
    """

    type = "image_transform"

    def __init__(self, config=None, context=None):
        super().__init__(config, context)
        c = self.config
        self.steps = list(c.get("transforms") or [])
        if not self.steps and c.get("max_size"):
            self.steps = [{"type": "resize", "size": list(_pair(c["max_size"])), "mode": "keep_aspect_ratio"}]
        self.tensor = c.get("output_format", "pil") == "tensor"
        if c.get("output_format", "pil") not in ("pil", "tensor"):
            raise ValueError("output_format must be pil or tensor")
        for t in self.steps:
            if t.get("type") not in (*PIXELS, *TENSOR):
                raise ValueError(f"unknown image transform: {t.get('type')}")
            if t["type"] in PIXELS[:4] and "size" not in t:
                raise ValueError(f"{t['type']} needs a size")
            if t["type"] == "normalize" and not (t.get("mean") and t.get("std")):
                raise ValueError("normalize needs mean and std")
            if t["type"] == "to_tensor":
                self.tensor = True

    def _udf(self, many: bool):
        steps, mode, method, tensor = self.steps, self.config.get("resize_mode", "keep_aspect_ratio"), "bilinear", self.tensor
        pixels = f"struct<{'values: array<float>, channels: int, height: int, width: int' if tensor else IMAGE_TYPE[7:-1]}, error: string>"

        def one(image):
            if image is None or image.get("bytes") is None:
                return None
            try:
                x = decode(image["bytes"])
                for t in steps:
                    if t["type"] in PIXELS:
                        x = apply_one(x, t, method, mode)
                if not tensor:
                    return {"bytes": encode(x), "path": image.get("path"), "width": x.shape[1], "height": x.shape[0], "mode": {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}[x.shape[2]], "error": None}
                y = x.transpose(2, 0, 1) / 255.0
                for t in steps:
                    if t["type"] == "normalize":
                        y = (y - np.reshape(t["mean"], (-1, 1, 1))) / np.reshape(t["std"], (-1, 1, 1))
                return {"values": y.ravel().astype(np.float32), "channels": y.shape[0], "height": y.shape[1], "width": y.shape[2], "error": None}
            except Exception as e:  # an image that can't be read must not end the run: its error is a value
                return dict.fromkeys(("values", "channels", "height", "width") if tensor else ("bytes", "path", "width", "height", "mode")) | {"error": f"{type(e).__name__}: {e}"[:200]}

        if many:

            @F.pandas_udf(f"array<{pixels}>")
            def run(s: pd.Series) -> pd.Series:
                return s.map(lambda v: None if v is None else [one(x) for x in v])
        else:

            @F.pandas_udf(pixels)
            def run(s: pd.DataFrame) -> pd.DataFrame:
                names = ["values", "channels", "height", "width", "error"] if tensor else ["bytes", "path", "width", "height", "mode", "error"]
                return pd.DataFrame([one(r) or dict.fromkeys(names) for r in s.to_dict("records")], columns=names, index=s.index)

        return run

    def __call__(self, df: DataFrame) -> DataFrame:
        cond = condition(df, self.config.get("condition"))
        if cond is False or not self.steps:
            return df
        skip = self.config.get("skip_on_error", True)
        for f in self.config.get("image_fields") or ["image"]:
            kind = field(df, f)
            many = isinstance(kind, T.ArrayType)
            if not isinstance(kind.elementType if many else kind, T.StructType):
                continue
            done = self._udf(many)(column(f))
            # the result is named once, so that the pixels are processed once
            mark = free_name(df, f"{f}_done")
            df = df.withColumn(mark, done if cond is True else F.when(cond, done))
            result = F.col(mark)
            old: Column = column(f)
            if many:
                if not skip:
                    df = df.where(F.coalesce(~F.exists(result, lambda x: x["error"].isNotNull()), F.lit(True)))
                if self.tensor:
                    new = result
                else:
                    clean = lambda x: F.struct(*(x[c].alias(c) for c in ("bytes", "path", "width", "height", "mode")))
                    new = F.when(result.isNotNull(), F.zip_with(result, old, lambda r, o: F.when(r["bytes"].isNotNull(), clean(r)).otherwise(o))).otherwise(old)
            else:
                if not skip:
                    df = df.where(result["error"].isNull())
                clean_one = F.struct(*(result[c].alias(c) for c in ("bytes", "path", "width", "height", "mode"))) if not self.tensor else result
                new = clean_one if self.tensor else F.when(result["bytes"].isNotNull(), clean_one).otherwise(old)
            df = df.withColumn(f, new).drop(mark)
        return df

    transform = __call__
