"""Registries of scorers and detectors: functions that add a column to a batch of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Detector = Callable[[DataFrame], DataFrame]
_detectors: dict[str, Detector] = {}
_scorers: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_detector(name: str, fn: Detector) -> None:
    """fn: rows (image_id, attr, ...) to rows with g in 1/0/-1."""
    _detectors[name] = fn


def register_scorer(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """fn: rows (image_id, prompt, ...) to rows with reward (null: failed)."""
    _scorers[name] = fn


def detector(name: str) -> Detector:
    return _detectors[name]


def scored(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a reward: those that lack one are scored by the named model; if none lacks one, the model is not touched."""
    todo = rows.where("reward is null")
    if todo.isEmpty():
        return rows
    if name not in _scorers:
        raise LookupError(f"rewards are missing and there is no scorer {name!r}")
    return rows.where("reward is not null").unionByName(_scorers[name](todo.drop("reward")).select(*rows.columns))


def missing_labels(todo: DataFrame, name: str) -> DataFrame:
    """(image_id, attr, g) for rows still to detect; a failed one (null) counts as 0."""
    return _detectors[name](todo).select("image_id", "attr", F.coalesce("g", F.lit(0)).cast("int").alias("g"))
