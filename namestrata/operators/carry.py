"""Running state over ordered groups, cut into bounded chunks.

Reassembly walks a flow in order with a small running state. A flow may hold any share of
all traffic, so it is not handed to one task: it is cut into chunks of bounded size, all
chunks start in parallel from a guessed state, and a chunk is run again only when the state
its predecessor really ended with differs from the guess. Results are exact when no chunk
is left to rerun.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from namestrata.session import cut_lineage

#: (chunk number, rows in order, incoming state or None)
#: -> (output rows, state begun with, state ended with)
#:
#: Rows are tuples. None means the state is unknown and has to be guessed; the state begun
#: with then says which incoming state would give the very same result.
Step = Callable[[int, list[tuple], "bytes | None"], tuple[list[tuple], bytes, bytes]]

STATE, USED, ENDED = "__state", "__used", "__ended"
FLUSH_ROWS = 4096


def carry(
    rows: DataFrame,
    by: list[str],
    chunk: str,
    order: list[str],
    inputs: list[str],
    step: Step,
    out_schema: str,
    several_chunks: bool | None = None,
) -> DataFrame:
    """Run ``step`` over every group in order; see the module text.

    ``chunk`` numbers a group's chunks 0, 1, 2 … without holes and no key is NULL. ``inputs``
    are the columns handed to the step. ``several_chunks`` tells whether any group has more
    than one chunk; None finds out with a job over the key columns. Without such groups the
    plan stays lazy: one shuffle, one sort, one pass.
    """
    outputs = T.DataType.fromDDL(f"struct<{out_schema}>").fields
    names = [*by, chunk]
    fields = [f.name for f in outputs]
    rows = rows.select(*names, *dict.fromkeys(c for c in [*order, *inputs] if c not in names))
    reports = [T.StructField(USED, T.BinaryType()), T.StructField(ENDED, T.BinaryType())]
    schema = T.StructType([*[rows.schema[n] for n in names], *outputs, *reports])
    run = _runner(names, inputs, step, schema)

    def apply(df: DataFrame) -> DataFrame:
        # Each chunk's rows meet in one task, state row first, and stream through it.
        parted = df.repartition(*names)
        ordered = parted.sortWithinPartitions(*names, F.col(STATE).asc_nulls_last(), *order)
        return ordered.mapInArrow(run, schema)

    no_state = F.lit(None).cast("binary").alias(STATE)
    result = apply(rows.select("*", no_state))
    if several_chunks is None:
        several_chunks = not rows.filter(F.col(chunk) > 0).select(chunk).limit(1).isEmpty()
    if not several_chunks:
        return result.filter(F.col(ENDED).isNull()).select(*by, *fields)

    rows = cut_lineage(rows, "carry-rows")
    result = cut_lineage(result, "carry")
    while True:
        ends = result.filter(F.col(ENDED).isNotNull()).select(*names, USED, ENDED)
        incoming = ends.select(*by, (F.col(chunk) + 1).alias(chunk), F.col(ENDED).alias(STATE))
        stale = ends.join(incoming, names).filter(F.col(STATE) != F.col(USED))
        stale = cut_lineage(stale.select(*names, STATE), "carry-stale")
        if stale.isEmpty():
            return result.filter(F.col(ENDED).isNull()).select(*by, *fields)
        touched = stale.select(*names)
        again = rows.join(touched, names, "left_semi").select("*", no_state)
        redone = apply(again.unionByName(stale, allowMissingColumns=True))
        kept = result.join(touched, names, "left_anti")
        result = cut_lineage(kept.unionByName(redone), "carry")


def _runner(names: list[str], inputs: list[str], step: Step, schema: T.StructType):
    keys = len(names)
    arrow = to_arrow_schema(schema)

    def rows_of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*names, STATE, *inputs)]
            yield from zip(*columns)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, group in groupby(rows_of(batches), key=lambda r: r[:keys]):
            state, part = None, []
            for row in group:
                if row[keys] is not None:
                    state = row[keys]
                else:
                    part.append(row[keys + 1 :])
            made, used, ended = step(key[-1], part, state)
            out += [(*key, *m, None, None) for m in made]
            blank = (None,) * (len(schema.fields) - keys - 2)
            out.append((*key, *blank, used, ended))
            if len(out) >= FLUSH_ROWS:
                yield _batch(out, arrow)
                out = []
        yield _batch(out, arrow)

    return job


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(arrow)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow)]
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)
