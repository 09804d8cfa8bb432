"""Results to several outputs: what each gets, what is counted, and what a replay repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namestrata.operators.counters import Counters, watched
from namestrata.operators.domain_filter import filter_domains, filter_messages
from namestrata.operators.retention import drop_oldest_folders
from namestrata.operators.rows import explode_questions
from namestrata.sinks.tables import BLOCK_SINKS, MESSAGE_SINKS, write_to

Output = tuple[str, int, dict]


def active_outputs(outputs: list[Output]) -> list[Output]:
    """Outputs with a mode from 1 to 4; the others are switched off."""
    active = [o for o in outputs if 1 <= o[1] <= 4]
    if not active:
        raise ValueError("no output specified, please specify at least one output")
    return active


def filter_for(name: str, results: DataFrame, mode: int, skip=None, allow=None) -> DataFrame:
    """What an output of this name gets: kept questions, or kept messages for message-wise ones."""
    if name in MESSAGE_SINKS:
        return filter_messages(results, mode, skip, allow)
    return filter_domains(explode_questions(results), mode, skip, allow, "q.name")


class Commits:
    """Records, below a shared folder, of which block every output has taken."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, block: int, place: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{place}/{block}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, block: int, place: int) -> bool:
        path, fs = self._path(block, place)
        return fs.exists(path)

    def add(self, block: int, place: int) -> None:
        path, fs = self._path(block, place)
        fs.create(path, True).close()


def deliver(
    results: DataFrame,
    outputs: list[Output],
    skip: DataFrame | None = None,
    allow: DataFrame | None = None,
    counters: Counters | None = None,
    block: int | None = None,
    commits: Commits | None = None,
) -> None:
    """Write ``results`` to every output in turn, each a (sink name, output mode, options).

    ``counters`` get, by ``label`` of the options or name of the sink, ...SentToOutput, ...Skipped
    (by the lists) and ...Failed. With counters a failing output is counted and the others
    still get their rows; without, it is an error.

    A ``block`` that comes again is written once: outputs that own a folder write each block into
    a folder of its own and replace it; for all others ``commits`` tells whether they have it.
    An output that fails between its last row and its record gets the block again.
    """
    for place, (name, mode, options) in enumerate(active_outputs(outputs)):
        if commits is not None and commits.has(block, place):
            continue
        options = dict(options)
        label = options.pop("label", name)
        root, keep = options.get("path"), None
        if block is not None and name in BLOCK_SINKS:
            # What stays of a folder is decided over all blocks, not within one.
            keep = options.pop("keep", None)
            options |= {"path": f"{options['path']}/block={block}", "mode": "overwrite"}
        # A message-wise output counts messages, the others questions.
        offered = results if name in MESSAGE_SINKS else explode_questions(results)
        kept = filter_for(name, offered, mode, skip, allow)
        watch = Counters() if counters is not None else None
        try:
            write_to(watched(watch, kept, sent=F.lit(True)), name, options)
        except Exception:
            if counters is None:
                raise
            counters.add(**{f"{label}Failed": kept.count(), f"{label}SentToOutput": 0, f"{label}Skipped": 0})
            continue
        if keep is not None:
            drop_oldest_folders(results.sparkSession, root, keep, above=1)
        if commits is not None:
            commits.add(block, place)
        if counters is not None:
            sent = watch.totals()["sent"]
            counters.add(**{f"{label}SentToOutput": sent, f"{label}Skipped": offered.count() - sent, f"{label}Failed": 0})
