"""Python inside tasks: Arrow batches in, Arrow batches out, a few rows in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows and bytes of text held as Python objects at once.
SLICE_ROWS, SLICE_BYTES = 1024, 8 << 20
#: Bytes of text held at once by steps that keep some forty times as much as words and arrays.
PIECE_BYTES = 1 << 20


def schema_of(text: str) -> StructType:
    return _parse_datatype_string(text)


def slices(batch: pa.RecordBatch, weight: str | None = None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most SLICE_ROWS rows and about ``most`` bytes in column ``weight``."""
    start, size = 0, 0
    sizes = None
    if weight is not None:
        sizes = pc.fill_null(pc.binary_length(batch.column(weight)), 0).to_pylist()
    for i in range(batch.num_rows):
        size += sizes[i] if sizes else 0
        if i + 1 - start >= SLICE_ROWS or size >= most or i + 1 == batch.num_rows:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0


def record_batch(columns: list[Iterable], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


#: Bytes of an Arrow batch on the way to Python. Spark's own bound of 64 MB is held several times by a
#: task, as rows, as a batch and in Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BATCH_BYTES = 8 << 20


def bound_batches(spark) -> None:
    """Sets the session's bound of a batch to MOST_BATCH_BYTES, if it does not have a bound of its own."""
    if spark.conf.get(BATCH_BYTES) in ("67108864b", "64m", "64MB"):
        spark.conf.set(BATCH_BYTES, f"{MOST_BATCH_BYTES}b")


def map_slices(
    df: DataFrame,
    start: Callable[[], Callable[[pa.RecordBatch], list[Iterable] | None]],
    schema: str | StructType,
    weight: str | None = None,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """``mapInArrow`` in small pieces, as :func:`slices` cuts them.

    ``start`` runs once per task and gives the function from a piece to output columns.
    """
    kind = schema_of(schema) if isinstance(schema, str) else schema
    bound_batches(df.sparkSession)

    def run(batches):
        out = to_arrow_schema(kind)
        step = start()
        for batch in batches:
            for piece in slices(batch, weight, most):
                columns = step(piece)
                if columns is not None:
                    yield record_batch(columns, out)

    return df.mapInArrow(run, kind)


def text_bytes(name: str = "text"):
    """A text column as UTF-8 bytes, which cost no decoding on the way to Python."""
    return F.col(name).cast("binary").alias(name)


def plain_names(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: names of any kind, which some functions do not take."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place_of(name: str, df: DataFrame) -> int:
    return [c.lower() for c in df.columns].index(name.lower())


def keep_rows(docs: DataFrame, start: Callable[[], Callable[[bytes | None], bool]]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is good by the function that ``start`` gives a task.

    Columns may have any names and types.
    """
    plain = plain_names(docs)
    kind = plain.schema

    def begin():
        good = start()

        def step(piece):
            kept = piece.filter(pa.array([good(t) for t in piece.column("own").to_pylist()], pa.bool_()))
            return kept.columns[:-1] if kept.num_rows else None

        return step

    text = F.col(f"c{place_of('text', docs)}").cast("binary")
    return map_slices(plain.withColumn("own", text), begin, kind, weight="own").toDF(*docs.columns)


#: Rows of narrow columns, some 40 MB, up to which a stored table is broadcast.
BROADCAST_ROWS = 1_000_000


def few(table: DataFrame) -> DataFrame:
    """A stored table of narrow columns, marked for broadcast if its counted rows are few; a larger
    one is joined by exchange."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
