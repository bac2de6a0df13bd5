"""``sample_packer``: consecutive texts joined into packs between two token counts.

Which text begins a pack depends on all before it, but where a pack that begins at a
given text ends doesn't.  So the rows, (key, order, count) of each text, are sorted into
ranges; each range says what comes out at its end for every text that may be the first
to begin a pack in it, of which there are no more than fit into one pack.  The driver
follows these from range to range, one step each, and every range is then packed from
where it is entered.  No task gets more than a range, whatever the keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import TokenizerSpec
from ..functions.values import column
from ..storage import Workspace
from .base import ROW_ID, Processor, with_row_id


class Range:
    """The texts of a range in order: ``next`` is the text that begins the pack after one that begins at a text."""

    def __init__(self, table: pa.Table, most: int, separator: int):
        table = table.sort_by("at")
        self.table, self.most, self.separator = table, most, separator
        self.at, cost = table.column("at").to_numpy(), table.column("n").to_numpy() + separator
        g = table.column("g").combine_chunks().dictionary_encode().indices.to_numpy()
        borders = np.flatnonzero(np.concatenate([g[1:] != g[:-1], [True]])) + 1
        end = borders[np.searchsorted(borders, np.arange(len(g)), side="right")]
        self.sums = np.cumsum(cost)
        self.before = self.sums - cost
        self.next = np.clip(np.searchsorted(self.sums, self.before + separator + most, side="right"), np.arange(1, len(g) + 1), end)
        self.head = int(borders[0])  # the texts of the first key

    def entry(self, tokens: int | None) -> int:
        """The first text that begins a pack, after one of ``tokens`` that is still open."""
        return 0 if tokens is None else int(np.searchsorted(self.sums[: self.head], self.most - tokens, side="right"))

    def last_starts(self) -> np.ndarray:
        """Of each text, if a pack begins there, where the range's last pack begins."""
        n = len(self.next)
        last = np.where(self.next < n, self.next, np.arange(n))
        while (last[last] != last).any():
            last = last[last]
        return last

    def summary(self) -> dict:
        """What comes out, by the room that an open pack has left: a step where it changes."""
        entries = np.arange(min(self.entry(0), len(self.next) - 1) + 1)
        last = self.last_starts()[entries]
        new = np.concatenate([[True], last[1:] != last[:-1]])
        entries, last = entries[new], last[new]
        return {
            "first": self.table.column("g")[0].as_py(), "end": self.table.column("g")[-1].as_py(), "one": self.head == len(self.next), "total": int(self.sums[-1]),
            "room": np.where(entries > 0, self.sums[np.maximum(entries - 1, 0)], -(1 << 62)).tolist(), "start": self.at[last].tolist(), "tokens": (self.sums[-1] - self.before[last] - self.separator).tolist(),
        }

    def packs(self, tokens: int | None, start: int | None) -> np.ndarray:
        """The place of the text that begins each text's pack."""
        k = self.entry(tokens)
        out, starts = np.full(len(self.next), -1 if start is None else start), []
        while k < len(self.next):
            starts.append(k)
            k = int(self.next[k])
        if starts:
            out[starts[0] :] = np.repeat(self.at[starts], np.diff([*starts, len(out)]))
        return out


def follow(summaries: list[dict], most: int) -> list[tuple[int | None, int | None]]:
    """(tokens, start) of the pack that is open where each range, in order, is entered; None where a key begins."""
    entered, key, tokens, start = [], None, None, None
    for s in summaries:
        if start is None or key != s["first"]:
            tokens = start = None
        entered.append((tokens, start))
        if tokens is not None and s["one"] and tokens + s["total"] <= most:
            tokens += s["total"]
            continue
        k = 0 if tokens is None else int(np.searchsorted(s["room"], most - tokens, side="right")) - 1
        key, start, tokens = s["end"], s["start"][k], s["tokens"][k]
    return entered


def exact_key(df: DataFrame, names: list[str]) -> Column:
    """One string for each combination of values; no two share one, as each part has its length before it."""

    def part(name: str) -> Column:
        kind, c = df.select(F.col(name)).schema[0].dataType, F.col(name)
        if isinstance(kind, T.BinaryType):
            c = F.hex(c)
        elif isinstance(kind, (T.ArrayType, T.StructType)):
            c = F.to_json(c, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"})
        c = c.cast("string")
        return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.concat(F.lit(""), *map(part, names))


class SamplePacker(Processor):
    """One row for each pack, with the text column only.

    Null and empty texts are left out.  A pack closed below ``min_tokens`` is dropped,
    as documented; the last one joins the pack before if it fits, else it is emitted.
    """

    type = "sample_packer"

    def __init__(self, config=None, context=None):
        super().__init__(config, context)
        c = self.config
        self.least, self.most = int(c.get("min_tokens", 100_000)), int(c.get("max_tokens", 128_000))
        self.field, self.separator = c.get("text_field", "text"), c.get("separator", "\n\n")
        if self.least > self.most:
            raise ValueError("min_tokens exceeds max_tokens")

    def required_columns(self) -> list[str]:
        return [self.field]

    def separator_cost(self, df: DataFrame, tokenizer: TokenizerSpec) -> int:
        if not self.separator:
            return 0
        n = df.sparkSession.range(1).select(tokenizer.count(F.lit(self.separator)).alias("n")).first()["n"]
        return max(0, int(n) - 1)

    def transform(self, df: DataFrame) -> DataFrame:
        c, tokenizer = self.config, self.context.tokenizer or TokenizerSpec()
        df = with_row_id(df, c.get("order_by") or self.context.order_by)
        keys = [c["pack_by"]] if isinstance(c.get("pack_by"), str) else list(c.get("pack_by") or [])
        text = column(self.field)
        rows = df.where(text.isNotNull() & (text != "")).select(F.col(ROW_ID).alias("i"), exact_key(df, keys).alias("g"), text.alias("t"))
        least, most, cost = self.least, self.most, self.separator_cost(df, tokenizer)
        ws = Workspace(df.sparkSession)
        # texts are counted and joined in parallel; what is sorted is (key, order, count)
        counted = rows.select("g", "i", tokenizer.count(F.col("t")).cast("long").alias("n")).sort("g", "i")
        ordered = ws.save(counted.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")

        def summed(table: pa.Table) -> pa.Table:
            return pa.Table.from_pylist([{"part": table.column("part")[0].as_py()} | Range(table, most, cost).summary()], pa.schema([("part", pa.int32()), ("first", pa.string()), ("end", pa.string()), ("one", pa.bool_()), ("total", pa.int64()), *((k, pa.list_(pa.int64())) for k in ("room", "start", "tokens"))]))

        summaries = ordered.groupBy("part").applyInArrow(summed, "part int, first string, end string, one boolean, total long, room array<long>, start array<long>, tokens array<long>")
        found = sorted((r.asDict() for r in summaries.collect()), key=lambda r: r["part"])  # a row for each range
        entered = df.sparkSession.sparkContext.broadcast(dict(zip((r["part"] for r in found), follow(found, most))))

        def assigned(table: pa.Table) -> pa.Table:
            r = Range(table, most, cost)
            return pa.Table.from_arrays([r.table.column("g"), r.table.column("i"), r.table.column("n"), pa.array(r.packs(*entered.value[table.column("part")[0].as_py()]), pa.int64())], names=["g", "i", "n", "pack"])

        packs = ws.save(ordered.groupBy("part").applyInArrow(assigned, "g string, i long, n long, pack long"), "packs")
        sizes = packs.groupBy("g", "pack").agg((F.sum("n") + (F.count("*") - 1) * cost).alias("tokens"))
        last = sizes.groupBy("g").agg(F.max("pack").alias("last"))
        sizes = sizes.join(last, "g")
        before = sizes.where(f"pack < last and tokens >= {least}").groupBy("g").agg(F.max(F.struct("pack", "tokens")).alias("before"))
        joins = f"pack = last and tokens < {least} and before.tokens + {cost} + tokens <= {most}"
        kept = sizes.join(before, "g", "left").where(f"tokens >= {least} or pack = last").select("g", "pack", F.when(F.expr(joins), F.col("before.pack")).otherwise(F.col("pack")).alias("into"))
        joined = rows.join(packs.join(kept, ["g", "pack"]).select("g", "i", "into"), ["g", "i"]).groupBy("g", "into").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("parts"))
        return joined.select(F.array_join(F.transform("parts", lambda p: p["t"]), self.separator).alias(self.field))
