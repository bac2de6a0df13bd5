"""What a multimodal model does to images, as its folder states it: sizes, patches and tokens of an image."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass

LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Processor:
    image_size: tuple[int, int] | None = None
    patch_size: int | None = None
    additional_tokens: int = 0
    feature_strategy: str = "full"
    image_seqlen: int = 1
    mean: tuple[float, ...] | None = None
    std: tuple[float, ...] | None = None

    def plugin_options(self) -> dict:
        return {k: v for k in ("image_size", "patch_size", "additional_tokens", "feature_strategy", "image_seqlen") if (v := getattr(self, k)) is not None}


def _side(size) -> tuple[int, int] | None:
    if isinstance(size, int):
        return size, size
    if not isinstance(size, dict):
        return None
    if "shortest_edge" in size:
        return size["shortest_edge"], size["shortest_edge"]
    return (size["width"], size["height"]) if {"width", "height"} <= set(size) else None


def load_processor(cfg: dict) -> Processor | None:
    """Of ``processor_config`` or ``base_model``, if the configuration has a ``processor_type``; None, with an error logged, if it can't be read."""
    if not cfg.get("processor_type"):
        return None
    folder = str(cfg.get("processor_config") or cfg.get("base_model"))
    try:
        with open(os.path.join(folder, "preprocessor_config.json"), encoding="utf-8") as f:
            image = json.load(f)
        own = {}
        if os.path.isfile(path := os.path.join(folder, "processor_config.json")):
            with open(path, encoding="utf-8") as f:
                own = json.load(f)
        mean, std = (tuple(image[k]) if image.get(k) else None for k in ("image_mean", "image_std"))
        return Processor(_side(image.get("crop_size")) or _side(image.get("size")), own.get("patch_size") or image.get("patch_size"), int(own.get("num_additional_image_tokens", 0)), own.get("vision_feature_select_strategy", "full"), int(own.get("image_seq_length", 1)), mean, std)
    except (OSError, ValueError, KeyError, TypeError) as e:
        LOG.error("processor %s can't be loaded: %s", folder, e)
        return None
