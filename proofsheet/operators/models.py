"""Seams for recognition models: a function on batches, loaded once a worker, with a deterministic stand-in."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import batches

CLASSES = ("document_text", "image_content")
BATCH, INPUT_SIZE = 32, 224


@functools.lru_cache(maxsize=4)
def loaded(factory: Callable[[], Callable]) -> Callable:
    """The model of a factory, kept in the worker's process."""
    return factory()


def stand_in() -> Callable[[np.ndarray], np.ndarray]:
    """Logits (rows, classes) from box features (rows, columns) by fixed weights."""
    return lambda x: np.stack([x[:, 0] / 100 - x[:, 1] / 50, x[:, 1] / 50 - x[:, 0] / 200], axis=1)


def predicted(regions: DataFrame, features: list[str], factory: Callable[[], Callable] = stand_in, batch: int = BATCH) -> DataFrame:
    """regions with column logits. Batches are bounded; a model that returns another number of rows is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(factory)
        for part in batches(frames, batch):
            logits = np.asarray(model(part[features].to_numpy(float)))
            if len(logits) != len(part):
                raise RuntimeError(f"the model returned {len(logits)} rows for {len(part)} regions")
            yield part.assign(logits=list(logits))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in regions.schema)
    return regions.mapInPandas(run, f"{schema}, logits array<double>")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    return F.transform(powers, lambda v: v / total)


def chosen(probabilities: Column) -> Column:
    """Number of the first greatest class, from 0."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1


def letterbox(width: Column, height: Column, size: int = INPUT_SIZE) -> tuple[Column, Column, Column, Column]:
    """Size and place of an image scaled into a square: width, height, left, top."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    w, h = F.greatest(F.lit(1.0), F.rint(width * scale)), F.greatest(F.lit(1.0), F.rint(height * scale))
    return w, h, F.floor((size - w) / 2), F.floor((size - h) / 2)


def routing_error() -> Column:
    """Why a prediction (class_id, class_name) can't be routed, or null."""
    expected = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("class_id") + 1).cast("int"))
    known = F.col("class_id").isin(*range(len(CLASSES)))
    return F.when(~known, "unknown_class").when(F.col("class_name") != F.when(known, expected), "name_mismatch")
