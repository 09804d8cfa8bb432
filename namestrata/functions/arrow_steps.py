"""Steps over Arrow batches that follow one another cross to Python once.

Spark runs every ``mapInArrow`` as an exchange of rows of its own, which costs more than headers take to read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: Where a DataFrame that comes right out of a step remembers (input, job).
STEP = "_namestrata_step"

Batches = Iterator[pa.RecordBatch]


def then(df: DataFrame, job: Callable[[Batches], Batches], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(job, schema)``, joined with the step that made ``df`` if there is one.

    The job takes its columns by name; there may be more of them than it needs.
    """
    source, run = getattr(df, STEP, (df, None))
    if run is None:
        whole = job
    else:

        def whole(batches: Batches) -> Batches:
            return job(run(batches))

    out = source.mapInArrow(whole, schema)
    setattr(out, STEP, (source, whole))
    return out


def keep(df: DataFrame, condition: Column, mask: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``df.filter(condition)``, inside the step that made ``df`` if there is one; ``mask`` says the same of a
    batch."""
    if not hasattr(df, STEP):
        return df.filter(condition)

    def job(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.filter(mask(batch), null_selection_behavior="drop")

    return then(df, job, df.schema)


def pick(df: DataFrame, names: list[str]) -> DataFrame:
    """``df.select(names)``, inside the step that made ``df`` if there is one."""
    if not hasattr(df, STEP):
        return df.select(*names)

    def job(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.select(names)

    return then(df, job, T.StructType([df.schema[n] for n in names]))
