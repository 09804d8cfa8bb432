"""Capture files as a data source: ``spark.read.format("captures")``.

A distributed job finds the records of every split once (``capture_index``) and stores what it found;
the source reads that index and plans input partitions from it, so a partition begins at a verified
record and knows its number. The index can be kept beside the captures and read many times.

* Conditions on ``file``, ``seq``, ``ts_ns``, ``caplen``, ``wirelen`` and ``link_type`` are pushed down:
  those on ``file`` and ``seq`` leave out whole splits, the others drop a packet by its header.
* A schema given to the reader names the columns wanted; without ``data`` no payload leaves the task.

The planner holds one short row per split (about 100 bytes; 800 000 rows for 100 TB in splits of 128 MB).
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as arrow_dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as api
from pyspark.sql.types import StructType

from namestrata.schemas import PACKETS
from namestrata.session import shared_dir
from namestrata.sources.captures import SPLIT_BYTES, capture_index, file_system, read_split

FORMAT = "captures"
#: Tasks that a read is cut into before they read more than ``splitBytes`` each: small splits must not
#: make as many tasks as there are.
MANY_TASKS = 256
NUMBERS = ("seq", "ts_ns", "caplen", "wirelen", "link_type")
COMPARE = {
    api.EqualTo: operator.eq, api.GreaterThan: operator.gt, api.GreaterThanOrEqual: operator.ge,
    api.LessThan: operator.lt, api.LessThanOrEqual: operator.le, api.In: lambda a, values: a in values,
}


@dataclass
class Condition:
    """One pushed filter: ``column`` compared with ``value`` as the filter class ``kind`` does."""

    column: str
    kind: type
    value: object

    def holds(self, found) -> bool:
        return COMPARE[self.kind](found, self.value)

    def may_hold(self, low: int, high: int) -> bool:
        """Whether it can hold for a number between ``low`` and ``high``."""
        if self.kind is api.EqualTo:
            return low <= self.value <= high
        if self.kind is api.In:
            return any(low <= v <= high for v in self.value)
        return self.holds(high if self.kind in (api.GreaterThan, api.GreaterThanOrEqual) else low)


@dataclass
class Splits(api.InputPartition):
    """Rows of the index that one task reads together."""

    rows: list[dict]


class CaptureReader(api.DataSourceReader):
    def __init__(self, index: str, split_bytes: int, schema: StructType):
        self.index, self.split_bytes, self.columns = index, split_bytes, schema.names
        self.conditions: list[Condition] = []

    def pushFilters(self, filters: list[api.Filter]) -> Iterable[api.Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in COMPARE and len(column) == 1 and column[0] in ("file", *NUMBERS):
                self.conditions.append(Condition(column[0], type(f), f.value))
            elif not (isinstance(f, api.IsNotNull) and column in {(c,) for c in ("file", *NUMBERS)}):
                yield f

    def partitions(self) -> list[Splits]:
        system, name = file_system(self.index)
        rows = arrow_dataset.dataset(name, filesystem=system, format="parquet").to_table().to_pylist()
        rows = sorted(filter(self._wanted, rows), key=lambda r: (r["path"], r["first"]))
        total = sum(r["stop"] - r["first"] for r in rows)
        most = max(self.split_bytes, min(SPLIT_BYTES, total // MANY_TASKS))
        tasks: list[list[dict]] = []
        room = 0
        for row in rows:
            size = row["stop"] - row["first"]
            if not tasks or size > room:
                tasks.append([])
                room = most
            tasks[-1].append(row)
            room -= size
        return [Splits(t) for t in tasks] or [Splits([])]

    def _wanted(self, row: dict) -> bool:
        """Whether the split can hold a packet that meets the conditions on file and number."""
        first, last = row["seq"], row["seq"] + row["count"] - 1
        return all(c.holds(row["path"]) for c in self.conditions if c.column == "file") and all(
            c.may_hold(first, last) for c in self.conditions if c.column == "seq"
        )

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        conditions = [c for c in self.conditions if c.column != "file"]

        def keep(packet: dict) -> bool:
            return all(c.holds(packet[c.column]) for c in conditions)

        for row in partition.rows:
            yield from read_split(row, self.columns, keep if conditions else None)


class CaptureSource(api.DataSource):
    """Options: ``index``, the folder that ``write_index`` filled; ``splitBytes``, bytes a task reads, more
    (up to 128 MB) where that would make more than ``MANY_TASKS`` tasks."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema: StructType) -> CaptureReader:
        # No session lives in the planner's process, so the layout is compared as text.
        known = dict(column.lower().split() for column in PACKETS.split(", "))
        for field in schema:
            if known.get(field.name) != field.dataType.simpleString():
                raise ValueError(f"captures have no column {field.name} {field.dataType.simpleString()}")
        if "index" not in self.options:
            raise ValueError("the option index names the folder that write_index filled")
        return CaptureReader(self.options["index"], int(self.options.get("splitBytes", SPLIT_BYTES)), schema)


def register(spark: SparkSession) -> None:
    """Make ``captures`` known to the session's readers and SQL, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def write_index(spark: SparkSession, out: str, *paths: str, split_bytes: int = SPLIT_BYTES) -> str:
    """Store where the packets of the captures at ``paths`` lie; returns ``out``.

    Files that are no captures, and captures without a packet, have no row.
    """
    capture_index(spark, *paths, split_bytes=split_bytes).write.mode("overwrite").parquet(out)
    return out


def open_captures(spark: SparkSession, *paths: str, split_bytes: int = SPLIT_BYTES, columns: str = PACKETS) -> DataFrame:
    """The captures at ``paths`` through the data source, with an index in the shared folder."""
    register(spark)
    index = write_index(spark, shared_dir(spark, "capture-index"), *paths, split_bytes=split_bytes)
    return spark.read.format(FORMAT).schema(columns).option("index", index).option("splitBytes", split_bytes).load()
