"""Queries of the image operators, over images that are made from ``pages``, with their pixels by SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import media
from .functions.images import decode
from .functions.tokens import TokenizerSpec
from .operators.base import Context
from .operators.pipeline import apply_all
from .plans.strategies import load_strategy
from .queries import TOKENS, query, spaced, sql_ids, table

PIXEL = "(page_id * 7 + x * 31 + y * 17 + c * 53) % 256"
FLAT = "(page_id * 7 + c * 53) % 256"
#: (page_id, w, h, x, y, c, v): every value of every image.
SQL_PIXELS = """(select page_id, w, h, (i // 3) % w as x, i // (3 * w) as y, i % 3 as c from (select page_id, w, h, unnest(range(w * h * 3)) as i from (select page_id, 4 + page_id % 5 as w, 3 + page_id % 4 as h from pages)))"""


def pictures(spark, d: str, pixel: str = PIXEL, height: str = "3 + page_id % 4") -> DataFrame:
    """(page_id, image): a PPM file of (4 + page_id % 5) x height for each page, its size not stated beside it."""
    sized = table(spark, d, "pages").selectExpr("page_id", "4 + page_id % 5 as w", f"{height} as h")
    hexed = f"lpad(hex(cast({pixel} as bigint)), 2, '0')".replace("x *", "(i div 3) % w *").replace("y *", "i div (3 * w) *").replace("c *", "i % 3 *")
    data = F.expr(f"concat(encode(concat('P6 ', w, ' ', h, ' 255\\n'), 'utf-8'), unhex(array_join(transform(sequence(0L, w * h * 3 - 1), i -> {hexed}), '')))")
    none = F.lit(None)
    image = F.struct(data.alias("bytes"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("string").alias("mode"))
    return sized.select("page_id", image.alias("image"))


def tensor(df: DataFrame, *steps: dict) -> DataFrame:
    """(page_id, width, height, channels, pixels): the values times their places, which tell images apart."""
    out = apply_all(df, [{"type": "image_transform", "transforms": [*steps, {"type": "to_tensor"}]}])
    return out.select("page_id", *(F.col(f"image.{c}").cast("long").alias(c) for c in ("width", "height", "channels")), weighted(F.col("image.values")).alias("pixels"))


def weighted(values: Column, value=lambda v, i: v * 255) -> Column:
    return F.aggregate(F.transform(values, lambda v, i: F.round(value(v, i)).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)


def sql_tensor(values: str, channels: int = 3) -> str:
    """The same of rows (page_id, ow, oh, x, y, c, v)."""
    return f"select page_id, any_value(ow)::bigint as width, any_value(oh)::bigint as height, {channels}::bigint as channels, sum(((c * oh + y) * ow + x + 1) * v)::bigint as pixels from ({values}) group by 1"


def sql_sampled(size: str, x: str, y: str, pixel: str = PIXEL) -> str:
    """An output of the size ``ow, oh`` that takes its value at (x, y) from the input's (``x``, ``y``)."""
    return f"""select page_id, ow, oh, ox as x, oy as y, c, {pixel} as v from (select page_id, ow, oh, ox, oy, c, {x} as x, {y} as y
from (select page_id, w, h, ow, oh, i % 3 as c, (i // 3) % ow as ox, i // (3 * ow) as oy from (select *, unnest(range((ow * oh * 3)::bigint)) as i from (select page_id, w, h, {size} from (select page_id, 4 + page_id % 5 as w, 3 + page_id % 4 as h from pages)))))"""


@query(sql_tensor(f"select page_id, w as ow, h as oh, x, y, c, {PIXEL} as v from {SQL_PIXELS}"))
def image_to_tensor(spark, d):
    return tensor(pictures(spark, d))


NEAREST = ("((2 * ox + 1) * w) // (2 * ow)", "((2 * oy + 1) * h) // (2 * oh)")


@query(sql_tensor(sql_sampled("8 as ow, 5 as oh", *NEAREST)))
def image_resize_exact(spark, d):
    return tensor(pictures(spark, d), {"type": "resize", "size": [8, 5], "mode": "exact", "interpolation": "nearest"})


@query(sql_tensor(sql_sampled("w * 8 // least(w, h) as ow, h * 8 // least(w, h) as oh", *NEAREST)))
def image_resize_shortest(spark, d):
    return tensor(pictures(spark, d), {"type": "resize", "size": 8, "interpolation": "nearest"})


@query(sql_tensor(sql_sampled("greatest(1, round_even(w * f, 0))::bigint as ow, greatest(1, round_even(h * f, 0))::bigint as oh", "0", "0", FLAT).replace("4 + page_id % 5 as w, 3 + page_id % 4 as h from pages", "w, h, least(1.0::double, 5.0::double / w, 4.0::double / h) as f from (select page_id, 4 + page_id % 5 as w, 3 + page_id % 4 as h from pages)")))
def image_keep_aspect(spark, d):
    return tensor(pictures(spark, d, FLAT), {"type": "resize", "size": [5, 4], "mode": "keep_aspect_ratio"})


@query(" union all ".join(f"select '{k}' as crop, * from ({sql_tensor(sql_sampled('3 as ow, 3 as oh', '(w - 3) // 2 + ox', 'oy'))})" for k in ("center_crop", "random_crop")))
def image_crops(spark, d):
    wide = pictures(spark, d, height="3L")
    parts = [tensor(wide, {"type": k, "size": [3, 3]}).select(F.lit(k).alias("crop"), "*") for k in ("center_crop", "random_crop")]
    return parts[0].union(parts[1])


@query(sql_tensor(sql_sampled("2 as ow, 2 as oh", "ox + 1", "oy + 1")))
def image_resized_crop(spark, d):
    return tensor(pictures(spark, d), {"type": "resized_crop", "left": 1, "top": 1, "width": 2, "height": 2, "size": [2, 2]})


def sql_luma(v: str) -> str:
    """Of a row that has the three values of a pixel as r, g, b."""
    r, g, b = (v.replace("?", x) for x in "rgb")
    return f"((19595 * {r} + 38470 * {g} + 7471 * {b} + 32768) >> 16)"


_RGB = f"(select page_id, w, h, x, y, max(v) filter (c = 0) as r, max(v) filter (c = 1) as g, max(v) filter (c = 2) as b from (select page_id, w, h, x, y, c, {PIXEL} as v from {SQL_PIXELS}) group by all)"


@query(sql_tensor(f"select page_id, w as ow, h as oh, x, y, 0 as c, {sql_luma('?')} as v from {_RGB}", 1))
def image_grayscale(spark, d):
    return tensor(pictures(spark, d), {"type": "grayscale", "num_output_channels": 1})


_past = lambda grey, v: f"greatest(0, least(255, floor({grey} + 1.25 * ({v} - {grey}))))::bigint"
_JITTER = f"""with b as (select page_id, w, h, x, y, {', '.join(f"least(255, floor({k} * 1.25))::bigint as {k}" for k in 'rgb')} from {_RGB}),
m as (select *, floor(avg({sql_luma('?')}) over (partition by page_id) + 0.5)::bigint as m from b),
k as (select page_id, w, h, x, y, {', '.join(f"{_past('m', k)} as {k}" for k in 'rgb')} from m),
l as (select *, {sql_luma('?')} as l from k),
s as (select page_id, w, h, x, y, {', '.join(f"{_past('l', k)} as {k}" for k in 'rgb')} from l)
"""


@query(_JITTER + sql_tensor("select page_id, w as ow, h as oh, x, y, c, case c when 0 then r when 1 then g else b end as v from s, (values (0), (1), (2)) t(c)"))
def image_color_jitter(spark, d):
    return tensor(pictures(spark, d), {"type": "color_jitter", "brightness": 0.5, "contrast": 0.5, "saturation": 0.5, "hue": 0.5})


@query(f"select page_id, round(min(n), 3) as least, round(max(n), 3) as most, sum(((c * h + y) * w + x + 1) * v)::bigint as pixels from (select *, (v / 255.0 - [0.5, 0.25, 0.5][c + 1]) / [0.5, 0.25, 0.125][c + 1] as n from (select *, {PIXEL} as v from {SQL_PIXELS})) group by 1")
def image_normalize(spark, d):
    mean, std = [0.5, 0.25, 0.5], [0.5, 0.25, 0.125]
    out = apply_all(pictures(spark, d), [{"type": "image_transform", "output_format": "tensor", "transforms": [{"type": "normalize", "mean": mean, "std": std}]}])
    v = F.col("image.values")
    at = lambda x, i: F.element_at(F.array(*map(F.lit, x)), (F.floor(i / (F.col("image.height") * F.col("image.width"))) + 1).cast("int"))
    return out.select("page_id", F.round(F.array_min(v).cast("double"), 3).alias("least"), F.round(F.array_max(v).cast("double"), 3).alias("most"), weighted(v, lambda x, i: (x * at(std, i) + at(mean, i)) * 255).alias("pixels"))


@query(sql_tensor(f"select page_id, w as ow, h as oh, x, y, c, {sql_luma('?')} as v from {_RGB}, (values (0), (1), (2)) t(c)"))
def image_decode(spark, d):
    """Written as a PNG by one step, and read by the next."""
    grey = apply_all(pictures(spark, d), [{"type": "image_transform", "transforms": [{"type": "grayscale", "num_output_channels": 3}, {"type": "to_pil"}]}])
    return tensor(grey)


@query(sql_tensor(sql_sampled("greatest(1, floor(w * f))::bigint as ow, greatest(1, floor(h * f))::bigint as oh", "0", "0", FLAT).replace("4 + page_id % 5 as w, 3 + page_id % 4 as h from pages", "w, h, case when w * h > 20 then sqrt(20.0::double / (w * h)) when w * h < 15 then sqrt(15.0::double / (w * h)) else 1.0::double end as f from (select page_id, 4 + page_id % 5 as w, 3 + page_id % 4 as h from pages)")))
def image_regularise(spark, d):
    return tensor(pictures(spark, d, FLAT), {"type": "regular", "max_pixels": 20, "min_pixels": 15})


# filters:
def damaged(image: Column, bad: Column) -> Column:
    """The same without its last byte, where ``bad`` holds."""
    data = F.when(bad, F.expr("substring(image.bytes, 1, octet_length(image.bytes) - 1)")).otherwise(image["bytes"])
    return F.struct(data.alias("bytes"), *(image[c].alias(c) for c in ("path", "width", "height", "mode")))


_SIZED = "(select page_id, 4 + page_id % 5 as w, 3 + page_id % 4 as h from pages)"


@query(f"select page_id from {_SIZED} where w between 5 and 7 and h between 4 and 5")
def image_size_filter(spark, d):
    return apply_all(pictures(spark, d), [{"type": "hf_filter", "min_image_size": [5, 4], "max_image_size": [7, 5]}]).select("page_id")


@query("select page_id, page_id % 3 <> 0 as by_filter, page_id % 3 <> 0 as by_hf_filter from pages where page_id % 3 <> 0")
def image_validity(spark, d):
    df = pictures(spark, d).withColumn("image", damaged(F.col("image"), F.col("page_id") % 3 == 0))
    parts = [apply_all(df, [{"type": k, "filter_corrupted_images": True}]).select("page_id", F.lit(True).alias(f"by_{k}")) for k in ("filter", "hf_filter")]
    return parts[0].join(parts[1], "page_id", "full").select("page_id", *(F.coalesce(f"by_{k}", F.lit(False)).alias(f"by_{k}") for k in ("filter", "hf_filter")))


@query(f"select page_id, (page_id % 3 <> 0)::bigint + 1 as images, string_agg(p, ' ' order by p) as paths from (select page_id, w, h, unnest(case when page_id % 3 = 0 then ['p' || page_id] else ['p' || page_id, 'p' || page_id] end) as p from {_SIZED} where w >= 5 and h >= 4 and page_id % 7 <> 0) group by 1, 2")
def multimodal_filter(spark, d):
    """Lists of two images, of which a damaged one is taken out; rows that are left without any, or have none, go."""
    bad = damaged(F.col("image"), F.col("page_id") % 3 == 0)
    lists = F.when(F.col("page_id") % 7 == 0, F.slice(F.array("image"), 1, 0)).otherwise(F.array(F.col("image"), bad))
    df = pictures(spark, d).select("page_id", lists.alias("images"))
    out = apply_all(df, [{"type": "multimodal_filter", "filter_corrupted_images": True, "require_images": True, "min_image_size": [5, 4]}])
    return out.select("page_id", F.size("images").cast("long").alias("images"), F.array_join(F.array_sort("images.path"), " ").alias("paths"))


@query("select page_id, len(regexp_extract_all(html, '<img[^>]*>')) as images from pages where len(regexp_extract_all(html, '<img[^>]*>')) <= 1")
def image_tag_count_filter(spark, d):
    pages = table(spark, d, "pages").withColumn("images", F.regexp_extract_all("html", F.lit("<img[^>]*>"), F.lit(0)))
    return apply_all(pages, [{"type": "image_count_filter", "min_images": 0, "max_images": 1, "image_fields": ["images"]}]).select("page_id", F.size("images").cast("long").alias("images"))


# strategies with images:
_ASK = "'Human: ' || repeat('<image>', n::bigint) || 'what is ' || page_id || '?' || chr(10) || chr(10) || 'Assistant: page ' || page_id"


def _questions(spark, d: str) -> DataFrame:
    df = pictures(spark, d).withColumn("image", damaged(F.col("image"), F.col("page_id") % 3 == 0))
    said = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    n = F.col("page_id").cast("string")
    return df.select("page_id", "image", said("<image>what is ", n, "?").alias("problem"), said("page ", n).alias("solution"))


@query(f"select page_id, array_to_string({sql_ids(_ASK)}, ' ') as input_ids, 1::bigint as num_images, greatest(1, round_even(w * f, 0))::bigint as width, greatest(1, round_even(h * f, 0))::bigint as height from (select *, 1 as n, least(1.0::double, 5.0::double / w, 5.0::double / h) as f from {_SIZED} where page_id % 3 <> 0 and w >= 5 and h >= 4)")
def vl_image_gate(spark, d):
    """Rows whose image is damaged or too small are left out; the others' are brought within a size."""
    cfg = {"sequence_len": 512, "vl_config": {"image_processing": {"verify_images": True, "min_size": [5, 4], "max_size": [5, 5]}}}
    out = load_strategy("vision_language", TOKENS, cfg, {"keep_columns": ["page_id"]})(_questions(spark, d))
    image = F.col("images")[0]
    return out.select("page_id", spaced("input_ids").alias("input_ids"), F.col("metadata.num_images").cast("long").alias("num_images"), *(image[c].cast("long").alias(c) for c in ("width", "height")))


@query(f"select page_id, array_to_string({sql_ids(_ASK)}, ' ') as input_ids from (select *, (h // 2) * (w // 2) + 2 - 1 as n from {_SIZED} where page_id % 3 <> 0)")
def llava_patches(spark, d):
    """As many image tokens as the image's size has patches, and one."""
    dataset = {"keep_columns": ["page_id"], "mm_plugin": "llava", "patch_size": 2, "additional_tokens": 2, "feature_strategy": "default"}
    return load_strategy("vl", TokenizerSpec(), {"sequence_len": 512}, dataset)(_questions(spark, d)).select("page_id", spaced("input_ids").alias("input_ids"))


@query("select conv_id, array_to_string(t[1:1], ' ') as head, array_to_string(t[2:], ' ') as rest from (select conv_id, list(turn order by turn) as t from conversations group by 1)")
def media_groups(spark, d):
    """A flat list as groups of given lengths."""
    flat = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    groups = media.batch_by_lengths(F.col("t"), F.array(F.lit(1), F.size("t") - 1))
    joined = lambda x: F.array_join(x.cast("array<string>"), " ")
    return flat.select("conv_id", joined(groups[0]).alias("head"), joined(groups[1]).alias("rest"))


@query("select page_id from pages where page_id % 3 <> 0")
def image_skip_on_error(spark, d):
    """An image that fails takes its row out where errors aren't skipped."""
    df = pictures(spark, d).withColumn("image", damaged(F.col("image"), F.col("page_id") % 3 == 0))
    return apply_all(df, [{"type": "image_transform", "skip_on_error": False, "transforms": [{"type": "grayscale"}]}], Context()).select("page_id")


class _Colours:
    """An encoder for whose images the mean colour is the vector, and for texts the colour they name."""

    def texts(self, categories):
        return [[float(c == x) for x in ("red", "green", "blue")] for c in categories]

    def images(self, images):
        @F.arrow_udf("array<array<double>>")
        def mean(lists: pa.Array) -> pa.Array:
            out = [None if x is None else [decode(i["bytes"]).reshape(-1, 3).mean(axis=0).tolist() for i in x] for x in lists.to_pylist()]
            return pa.array(out, pa.list_(pa.list_(pa.float64())))

        return mean(images)


_MEANS = f"(select page_id, avg(r) as r, avg(g) as g, avg(b) as b from {_RGB} group by 1)"


@query(f"select page_id from {_MEANS} where g >= r and b > r")
def image_toxicity_filter(spark, d):
    """Images and category names encoded by a plug-in; kept are those of whose two nearest categories none is listed."""
    spec = {"type": "image_toxicity_filter", "neutral_categories": ["green"], "nsfw_categories": ["red"], "underage_categories": ["blue"], "underage_threshold": 0.6}
    return apply_all(pictures(spark, d), [spec], Context(scorers={"image": _Colours()})).select("page_id")
