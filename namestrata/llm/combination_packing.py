"""Packing token pieces into windows: repeat counts of length combinations by non-negative least
squares against the histogram of lengths, rounding, and a greedy rest."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namestrata.llm.batches import map_slices, text_bytes
from namestrata.llm.rank_codec import RankCodec, file_codec
from namestrata.llm.words import REMEMBERED
from namestrata.session import cut_lineage

WINDOW = 2048
#: Pieces of a combination at most, and how the room beside the first of them is divided.
DEPTH = 4
SHARES = tuple(k / 16 for k in range(8, 16))
#: Rounds of the solver; the work depends on the window only.
ROUNDS = 400
#: Tokens of padding that a greedy combination may leave.
WASTE = 8


def ids_of(codec: RankCodec, text: bytes | None) -> np.ndarray:
    return np.frombuffer(codec.encode(text.decode("utf-8", "replace")) if text else b"", dtype="<u4")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def narrowed(ids: np.ndarray) -> bytes:
    """Ids for storage: 16-bit numbers after a zero byte if all fit, else 32-bit ones after a one."""
    return b"\0" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\1" + ids.tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], dtype="<u4" if data[0] else "<u2").astype("<u4")


def whole_pieces(docs: DataFrame, path: str, pattern: str, end_id: int, window: int = WINDOW, remembered: int = REMEMBERED) -> DataFrame:
    """The documents' ids, ``end_id`` after each, as full windows and one shorter rest.

    ``rank`` numbers the pieces of a length within a task (``part``), ``row`` all of its pieces.
    Rests carry their ids, in case they are cut later.
    """

    def start():
        part, ranks, row = TaskContext.get().partitionId(), Counter(), 0
        codec = file_codec(path, pattern, remembered)

        def step(piece):
            nonlocal row
            out = []
            for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                ids = np.append(ids_of(codec, text), np.uint32(end_id))
                for at in range(0, len(ids), window):
                    own = ids[at : at + window]
                    n = len(own)
                    out.append((part, row, ranks[n], doc, at, n, crc(own), len(ids), narrowed(own) if n < window else None))
                    ranks[n] += 1
                    row += 1
            return list(zip(*out))

        return step

    return map_slices(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()),
        start,
        "part int, row long, rank long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary",
        weight="text",
    )


def combinations(lengths: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Shallow combinations that fill the window: every first length, the room beside it divided
    by a few shares again and again, the last piece taking what is left exactly."""
    there = np.zeros(window + 1, dtype=bool)
    there[lengths] = True
    found = set()

    def fill(head: tuple[int, ...], room: int) -> None:
        if there[room]:
            found.add(tuple(sorted((*head, room))))
        if len(head) + 1 >= DEPTH:
            return
        for share in SHARES:
            n = int(room * share)
            if 0 < n < room and there[n]:
                fill((*head, n), room - n)

    for first in lengths:
        if first == window:
            found.add((window,))
        else:
            fill((int(first),), window - int(first))
    return sorted(found)


def repeat_counts(combos: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares by multiplicative steps: counts x of the combinations such that
    the pieces they use come near the histogram."""
    which = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    length = np.fromiter((n for c in combos for n in c), dtype=np.int64, count=len(which))
    goal = np.bincount(which, weights=histogram[length].astype(float), minlength=len(combos))
    x = np.ones(len(combos))
    for _ in range(rounds):
        used = np.bincount(length, weights=x[which], minlength=len(histogram))
        x *= goal / np.maximum(np.bincount(which, weights=used[length], minlength=len(combos)), 1e-12)
    return x


@dataclass
class Plan:
    """Where the pieces of each length go, by their number among those of the length.

    Sorted by ``key`` (length and first number). Pieces ``times`` to a window, ``into`` the window
    at first; with ``times`` 0 they lie end to end in a line that is cut every window.
    """

    window: int
    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    into: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces; one that runs over its window goes on in the next."""
        at = np.searchsorted(self.key, length << 40 | number, side="right") - 1
        since, times = number - self.first[at], self.times[at]
        line = times == 0
        position = self.into[at] + since * length
        every = np.maximum(times, 1)
        sequence = self.sequence[at] + np.where(line, position // self.window, since // every)
        return sequence, np.where(line, position % self.window, self.into[at] + since % every * length)


def make_plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """Plan from the counts by length (index 0 to ``window``); all of it depends on the window
    and the counts, not on the number of pieces."""
    left = histogram.astype(np.int64).copy()
    taken = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def use(combo: tuple[int, ...], repeats: int) -> None:
        nonlocal sequences
        into = 0
        for n, times in sorted(Counter(combo).items(), reverse=True):
            rows.append((n, int(taken[n]), sequences, times, into))
            into += n * times
            taken[n] += times * repeats
            left[n] -= times * repeats
        sequences += repeats

    lengths = np.flatnonzero(left)
    combos = combinations(lengths, window)
    if combos:
        counts = np.floor(repeat_counts(combos, left)).astype(np.int64)
        for k in np.argsort(-counts, kind="stable"):
            fits = min(left[n] // times for n, times in Counter(combos[k]).items())
            if min(fits, counts[k]) > 0:
                use(combos[k], int(min(fits, counts[k])))
    line = np.zeros_like(left)
    while left.any():
        # The longest piece left, and what fits beside it, longest first.
        combo, room = [], window
        spare = left - 0
        while room > 0 and (fits := np.flatnonzero(spare[: room + 1])).size:
            n = int(fits[-1])
            combo.append(n)
            spare[n] -= 1
            room -= n
        if room <= WASTE:
            use(tuple(combo), int(min(left[n] // times for n, times in Counter(combo).items())))
        else:
            # Nothing fills its window: end to end with others of the kind, cut where a window ends.
            line[combo[0]] += left[combo[0]]
            left[combo[0]] = 0
    position = 0
    for n in np.flatnonzero(line)[::-1]:
        rows.append((int(n), int(taken[n]), sequences, 0, position))
        position += int(n * line[n])
    rows.sort()
    columns = [np.array(c, dtype=np.int64) for c in zip(*rows)] or [np.zeros(0, np.int64)] * 5
    n, first, sequence, times, into = columns
    return Plan(window, n << 40 | first, first, sequence, times, into, sequences + -(-position // window))


def numbered(pieces: DataFrame) -> DataFrame:
    """Adds ``number``: gapless among all pieces of a length, from the ranks within tasks.

    Only the counts of a task's pieces by length are put in order, never the pieces.
    """
    own = pieces.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    own = own.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    return pieces.join(own, ["part", "length"]).withColumn("number", F.col("before") + F.col("rank")).drop("before")


def placed(pieces: DataFrame, plan: Plan) -> DataFrame:
    """Sequence and offset of every piece; ``cut`` is its length in the first window, if less."""

    def start():
        def step(piece):
            number, length = (piece.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("number", "length"))
            sequence, offset = plan.place(length, number)
            over = offset + length > plan.window
            cut = pa.array(plan.window - offset, mask=~over)
            keep = [piece.column(c) for c in ("part", "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            return [*keep, pa.array(sequence), pa.array(offset), cut]

        return step

    return map_slices(
        pieces.select("part", "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "number"),
        start,
        "part int, row long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, cut long",
    )


def halves(cut: DataFrame) -> DataFrame:
    """Both parts of the pieces that run over their window, with the checks of their own ids."""

    def start():
        def step(piece):
            out = []
            for r in piece.to_pylist():
                ids = widened(r["ids"])
                for a, b, sequence, offset in (
                    (0, r["cut"], r["sequence_id"], r["offset"]),
                    (r["cut"], len(ids), r["sequence_id"] + 1, 0),
                ):
                    out.append((r["doc_id"], r["start"] + a, b - a, crc(ids[a:b]), r["doc_tokens"], sequence, offset))
            return list(zip(*out))

        return step

    return map_slices(cut, start, RESULT, weight="ids")


RESULT = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = 1, window: int = WINDOW, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    Every document gives its ids by the ``tokenizers`` file at ``path`` (``pattern`` is its
    pre-splitting) and ``end_id``; null text counts as empty and gives ``end_id``
    alone. Full windows are sequences of their own; rests are combined. Documents are cut only at
    full windows and where a line of pieces that nothing completes runs over its window.
    A null doc_id stays null; repeated rows are packed each; other columns are ignored. Sequence
    numbers and offsets have no gaps; no sequence exceeds ``window``, and the line's last one is
    the only one that lacks more than WASTE tokens.

    What reaches the driver is the histogram of at most ``window`` lengths. A worker keeps the ids of
    ``remembered`` words, after its tasks too.
    """
    pieces = cut_lineage(whole_pieces(docs, path, pattern, end_id, window, remembered), "pieces")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    narrow = placed(numbered(pieces.drop("ids")), make_plan(histogram, window))
    narrow = cut_lineage(narrow, "placed")
    columns = [c.split(" ")[0] for c in RESULT.split(", ")]
    kept = narrow.where("cut IS NULL").withColumn("length", F.col("length").cast("long")).select(*columns)
    torn = narrow.where("cut IS NOT NULL").join(pieces.select("part", "row", "ids"), ["part", "row"])
    return kept.union(halves(torn))
