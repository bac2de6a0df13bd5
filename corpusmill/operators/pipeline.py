"""The registry of processors, their factory, and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from ..functions.batches import small_batches
from ..functions.values import free_name
from ..storage import Workspace
from .base import Context, Filter, Passthrough, Processor
from .dedup import Deduplicator
from .errors import route_errors
from .filters import ImageCountFilter, LengthFilter, MultimodalFilter, TokenFilter
from .images import ImageTransform
from .mapping import AdvancedMapping, ColumnMapping, QaToMessages
from .packing import SamplePacker
from .regex import RegexFilter, RegexTransform
from .sampling import RandomSampler
from .toxicity import ImageToxicityFilter, TextToxicityFilter

_types: dict[str, Callable[..., Processor]] = {}


def register_processor(name: str, kind: Callable[..., Processor]) -> None:
    """``kind(config, context)`` gives a callable DataFrame -> DataFrame."""
    _types[name] = kind


def list_processors() -> list[str]:
    return sorted(_types)


def create_processor(spec: dict | str, context: Context | None = None) -> Processor:
    """From ``{type, name, condition, config...}``, ``{reference: name}`` or the name of an instance of this run."""
    context = context or Context()
    if isinstance(spec, str):
        spec = {"reference": spec}
    if "reference" in spec:
        if spec["reference"] not in context.instances:
            raise ValueError(f"no processor is named {spec['reference']}")
        return context.instances[spec["reference"]]
    if spec.get("type") not in _types:
        raise ValueError(f"unknown processor type: {spec.get('type')}")
    config = {k: v for k, v in spec.items() if k not in ("type", "config")} | dict(spec.get("config") or {})
    made = _types[spec["type"]](config, context)
    if spec.get("name"):
        context.instances[spec["name"]] = made
    return made


def apply_all(df: DataFrame, specs: list, context: Context | None = None) -> DataFrame:
    """A chain of processors as one lazy plan.

    With ``strict_empty`` a row-local step that leaves none of the rows it was given is
    an error: a job for each filter, that ends at the first row it finds.
    """
    context = context or Context()
    for spec in specs or []:
        step = create_processor(spec, context)
        out = step(df)
        if context.strict_empty and isinstance(step, Filter) and out is not df and out.isEmpty() and not df.isEmpty():
            raise ValueError(f"{step.name} leaves no row: see its limits")
        df = out
    return df


class Pipeline(Processor):
    """Steps as one processor; a condition holds for the whole."""

    type = "pipeline"

    def __init__(self, config=None, context=None):
        super().__init__(config, context)
        if not self.config.get("processors"):
            raise ValueError("pipeline needs processors")
        self.steps = [create_processor(s, self.context) for s in self.config["processors"]]

    def required_columns(self) -> list[str]:
        return []

    def transform(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: s(d), self.steps, df)


class RowFunction(Processor):
    """A user's dict -> dict or None, in Arrow batches of BATCH_ROWS; the result has the columns of ``schema``, by default its input's.

    A row that fails is treated as the run's error mode says: ``raise`` ends the job,
    ``log_and_continue`` leaves the row out, ``raise_after_k`` does so up to k rows.
    """

    def __init__(self, function: Callable[[dict], dict | None], schema: str | None = None, config=None, context=None):
        super().__init__(config, context)
        self.function, self.schema = function, schema

    def attempt(self, df: DataFrame) -> tuple[DataFrame, str]:
        """The result, and the column that says what failed."""
        import pandas as pd

        f, like = self.function, df.sparkSession.createDataFrame([], self.schema or df.schema)
        names, error = like.columns, free_name(like, "error")

        def run(batches):
            for batch in batches:
                out = []
                for row in batch.to_dict("records"):
                    try:
                        got = f(dict(row))
                    except Exception as e:  # whatever a user's function raises is a value here
                        out.append(dict.fromkeys(names) | {error: f"{type(e).__name__}: {e}"[:500]})
                        continue
                    if got is not None:
                        out.append({k: got.get(k) for k in names} | {error: None})
                yield pd.DataFrame(out, columns=[*names, error])

        return small_batches(df).mapInPandas(run, like.schema.add(error, "string")), error

    def transform(self, df: DataFrame) -> DataFrame:
        tried, error = self.attempt(df)
        if self.context.error_mode == "raise_after_k":  # errors are counted first: the function still runs once
            tried = Workspace(df.sparkSession).save(tried, "tried")
        good, self.errors = route_errors(tried, error, self.context.error_mode, self.context.max_errors)
        return good


for _kind in (Passthrough, LengthFilter, ColumnMapping, QaToMessages, MultimodalFilter, TokenFilter, ImageCountFilter, AdvancedMapping, RegexTransform, ImageTransform, RegexFilter, Pipeline, Deduplicator, RandomSampler, TextToxicityFilter, ImageToxicityFilter, SamplePacker):
    register_processor(_kind.type, _kind)
