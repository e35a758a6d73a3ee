"""Models in batches: loaded once a worker, called with whole Arrow batches; what fails becomes null, what is left uncovered is asked once more."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import frozen
from ..operators.pools import misses

#: A model takes the columns of a batch and gives a value for each row; None or NaN: it could not.
Model = Callable[..., list]
_loaded: dict[str, Model] = {}


@dataclass(frozen=True)
class BatchModel:
    """A name, how to load it (called in the worker, once), the type of its values, and how many rows it takes at once."""

    name: str
    load: Callable[[], Model]
    type: str = "int"
    size: int = 256

    def column(self, *columns: str | Column) -> Column:
        """value and error (null where there is a value) of each row, as a struct."""
        name, load, size = self.name, self.load, self.size

        def each(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            if name not in _loaded:
                _loaded[name] = load()
            for batch in batches:
                batch = batch if isinstance(batch, tuple) else (batch,)  # one column comes bare
                found = [x for at in range(0, len(batch[0]), size) for x in _tried(_loaded[name], [c.iloc[at : at + size] for c in batch])]
                yield pd.DataFrame(found, columns=["value", "error"], dtype=object)

        return F.pandas_udf(each, f"value {self.type}, error string")(*columns)


def _tried(model: Model, columns: list[pd.Series]) -> list[tuple]:
    """(value, error) of each row. A batch that fails is halved until the rows that fail are alone."""
    n = len(columns[0])
    try:
        values = list(model(*columns))
        if len(values) != n:
            raise ValueError(f"{len(values)} values for {n} rows")
        return [(None, "no value") if v is None or v != v else (v, None) for v in values]
    except Exception as e:
        if n == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [x for half in (slice(None, n // 2), slice(n // 2, None)) for x in _tried(model, [c.iloc[half] for c in columns])]


def rated(rows: DataFrame, model: BatchModel, *inputs: str, score: str = "reward") -> DataFrame:
    """rows with a score and score_error from the model; rows that have a score keep it and are not sent."""
    known = F.col(score).isNotNull() if score in rows.columns else F.lit(False)
    todo = rows.where(~known).drop(score).withColumn("_got", model.column(*inputs))
    new = todo.withColumns({score: F.col("_got.value"), f"{score}_error": F.col("_got.error")}).drop("_got")
    return new if score not in rows.columns else rows.where(known).withColumn(f"{score}_error", F.lit(None).cast("string")).unionByName(new)


def detected(images: DataFrame, attrs: DataFrame, known: DataFrame, model: BatchModel, *inputs: str, tries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(labels, rest): image_id, attr, g, attempt of what was not known; and (image_id, attr, error) of what is still open after all tries.

    images: image_id and what the model takes beside attr and attempt (its first two inputs). All that is not known is asked for; an
    image without any label after that, known or new, is asked for again as a whole. A single label that failed
    on a covered image is not: it is in rest. Answers are kept behind a checkpoint, so that no model is called twice for a row that a lost executor held."""
    todo = misses(images, attrs, known)
    labels = rest = None
    for attempt in range(tries):
        asked = todo.join(images.dropDuplicates(["image_id"]), "image_id").withColumn("attempt", F.lit(attempt))
        answers = frozen(asked.select("image_id", "attr", "attempt", model.column("attr", "attempt", *inputs).alias("a")))
        new = answers.where("a.value is not null").select("image_id", "attr", F.col("a.value").alias("g"), "attempt")
        failed = answers.where("a.value is null").select("image_id", "attr", F.col("a.error").alias("error"))
        labels = new if labels is None else labels.unionByName(new)
        rest = failed if rest is None else rest.join(failed.select("image_id").distinct(), "image_id", "left_anti").unionByName(failed)
        covered = labels.select("image_id").unionByName(known.select("image_id")).distinct()
        todo = failed.select("image_id", "attr").join(covered, "image_id", "left_anti")
    done = labels.select("image_id", "attr")
    return labels, rest.join(done, ["image_id", "attr"], "left_anti")
