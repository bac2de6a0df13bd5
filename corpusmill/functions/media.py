"""Placeholders for media in messages, and the plug-ins that rewrite them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = "<image>"
VIDEO = "<video>"
AUDIO = "<audio>"


def placeholder_count(messages: Column, placeholder: str) -> Column:
    return F.aggregate(messages, F.lit(0), lambda n, m: n + F.coalesce(F.regexp_count(m["content"], F.lit(placeholder)), F.lit(0)))


def placeholders_match(messages: Column, images: Column, videos: Column, audios: Column) -> Column:
    """Whether there are as many placeholders of each kind as media."""
    test = F.lit(True)
    for p, media in ((IMAGE, images), (VIDEO, videos), (AUDIO, audios)):
        test = test & (placeholder_count(messages, p) == F.coalesce(F.size(media), F.lit(0)))
    return test


def image_sequence_length(width: Column | int, height: Column | int, patch: int, additional: int = 0, strategy: str = "full") -> Column:
    """Tokens of an image: its patches, and ``additional`` ones, of which ``default`` takes one away."""
    patches = lambda x: F.floor((F.lit(x) if isinstance(x, int) else x) / patch)
    return (patches(height) * patches(width) + additional - (1 if strategy == "default" else 0)).cast("int")


def batch_by_lengths(flat: Column, lengths: Column) -> Column:
    """A flat list of media as one list for each of the lengths."""
    start = lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, n: a + n)
    return F.transform(lengths, lambda n, i: F.slice(flat, start(i) + 1, n))


@dataclass(frozen=True)
class MediaPlugin:
    """``base`` leaves messages as they are; ``llava`` repeats the image token as often as an image has tokens.

    With ``patch_size`` that number follows from the first image's size, or from
    ``image_size`` [width, height], to which the model's processor brings images.
    """

    image_token: str | None = IMAGE
    video_token: str | None = VIDEO
    audio_token: str | None = AUDIO
    image_seqlen: int = 1
    expand_mm_tokens: bool = True
    patch_size: int | None = None
    additional_tokens: int = 0
    feature_strategy: str = "full"
    image_size: tuple[int, int] | None = None

    def check_media(self, images: bool = False, videos: bool = False, audios: bool = False) -> None:
        for there, token, what in ((images, self.image_token, "image"), (videos, self.video_token, "video"), (audios, self.audio_token, "audio")):
            if there and token is None:
                raise ValueError(f"this model does not take {what} input")

    def process_messages(self, messages: Column, images: Column | None = None) -> Column:
        return messages


class LlavaPlugin(MediaPlugin):
    def sequence_length(self, images: Column | None) -> Column:
        if not self.expand_mm_tokens:
            return F.lit(1)
        if not self.patch_size or (images is None and self.image_size is None):
            return F.lit(self.image_seqlen)
        if self.image_size:
            w, h = map(int, self.image_size)
        else:
            first = F.try_element_at(images, F.lit(1))
            w, h = first["width"], first["height"]
        return F.coalesce(image_sequence_length(w, h, self.patch_size, self.additional_tokens, self.feature_strategy), F.lit(self.image_seqlen))

    def process_messages(self, messages: Column, images: Column | None = None) -> Column:
        tokens = F.repeat(F.lit(self.image_token or IMAGE), self.sequence_length(images))
        return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.replace(m["content"], F.lit(IMAGE), tokens).alias("content")))


_plugins: dict[str, Callable[..., MediaPlugin]] = {"base": MediaPlugin, "llava": LlavaPlugin}


def register_mm_plugin(name: str, kind: Callable[..., MediaPlugin]) -> None:
    if name in _plugins:
        raise ValueError(f"plug-in {name} is registered already")
    _plugins[name] = kind


def get_mm_plugin(name: str, **options) -> MediaPlugin:
    if name not in _plugins:
        raise ValueError(f"plug-in {name} not found")
    return _plugins[name](**options)
