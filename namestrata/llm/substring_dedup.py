"""Substring deduplication: passages that a smaller document holds, found by FM-index shards.

Windows that are equal have equal minimizers, so text cut into runs of windows with one minimizer
can be dealt out by it: all equal windows meet in one shard, whatever documents they are in, and a
document is streamed only through the shards that can answer it.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from namestrata.llm.batches import PIECE_BYTES, map_slices, place_of, plain_names, record_batch, schema_of
from namestrata.llm.fm_index import NONE, FMIndex
from namestrata.session import cut_lineage

#: Words of the grams that minimizers are taken from.
GRAM = 4
#: Windows in a run at most, so that a bit mask of them is one number.
RUN = 63
#: Words after which a shard is closed at the next minimizer, and words of an index at most.
SHARD_WORDS, INDEX_WORDS = 400_000, 1_000_000
#: One text in so many, and every text of so many bytes, is read first to find heavy minimizers:
#: those whose distinct runs hold more words than a shard. The choice changes no result.
PROBE_SHARE, PROBE_LONG = 16, 1 << 16
#: Words whose hash a task remembers.
REMEMBERED = 100_000

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


class Rolling:
    """Hashes of word sequences of any length, from one running sum."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", MULTIPLIER), ("down", INVERSE)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        self._powers(len(hashes) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.up[: len(hashes)], dtype=np.uint64)])

    def spans(self, sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        x = (sums[start + length] - sums[start]) * self.down[start]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    power = 1
    least = values
    while 2 * power <= width:
        least = np.minimum(least[:-power], least[power:])
        power *= 2
    rest = width - power
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def runs_of(counts: np.ndarray, hashes: np.ndarray, rolling: Rolling, width: int, heavy: np.ndarray | None = None):
    """Runs of windows with one minimizer, in texts of ``counts`` words laid end to end.

    (text number, first word in the text, windows, key, hash of the words of the run). The key is
    the minimizer. A minimizer in ``heavy`` (sorted) stands for no run: each of its windows is a
    run of its own, under a key made of the minimizer and the window.
    """
    n = len(hashes)
    if n < width:
        return None
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    starts = np.arange(n - width + 1)
    whole = text[starts] == text[starts + width - 1]
    sums = rolling.sums(hashes)
    grams = rolling.spans(sums, np.arange(n - GRAM + 1), GRAM)
    least = sliding_least(grams, width - GRAM + 1)
    starts, least = starts[whole], least[whole]
    if not len(starts):
        return None
    owner = text[starts]
    fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
    begin = np.flatnonzero(fresh)
    since = np.arange(len(starts)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(starts)]])))
    alone = np.zeros(len(starts), dtype=bool)
    if heavy is not None and len(heavy):
        alone = heavy[np.minimum(np.searchsorted(heavy, least), len(heavy) - 1)] == least
    begin = np.flatnonzero((since % RUN == 0) | alone)
    windows = np.diff(np.concatenate([begin, [len(starts)]]))
    at = starts[begin]
    content = rolling.spans(sums, at, windows + width - 1)
    key = np.where(alone[begin], least[begin] ^ (content * np.uint64(MULTIPLIER)), least[begin])
    return text[at], at - first[text[at]], windows, key, content


def split_hashed(texts: list[bytes], memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    each = map(memo.__getitem__, chain.from_iterable(words))
    flat = np.fromiter(each, dtype=np.uint64, count=int(counts.sum()))
    return counts, flat


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def occurrences(base: DataFrame, width: int, heavy: np.ndarray | None = None) -> DataFrame:
    """(key, content, doc, loc): every run of every text of ``base`` (doc, check, text).

    ``loc`` packs first word, ``check`` and windows into one number.
    """
    known = None if heavy is None else base.sparkSession.sparkContext.broadcast(heavy)

    def start():
        memo, rolling = WordHashes(), Rolling()
        heavy = None if known is None else known.value

        def step(piece):
            counts, hashes = split_hashed(piece.column("text").to_pylist(), memo)
            found = runs_of(counts, hashes, rolling, width, heavy)
            if found is None:
                return None
            number, at, windows, key, content = found
            doc = piece.column("doc").to_numpy(zero_copy_only=False)[number]
            check = piece.column("check").to_numpy(zero_copy_only=False)[number]
            return [signed(key), signed(content), pa.array(doc), pa.array((at << 22) | (check << 6) | windows)]

        return step

    return map_slices(base, start, "key long, content long, doc long, loc long", weight="text", most=PIECE_BYTES)


def heavy_keys(base: DataFrame, width: int) -> np.ndarray:
    """Minimizers with more than a shard of words of distinct runs, as far as a share of the texts tells.

    Each has that many words of its own, so at most PROBE_SHARE of them come to a shard of the input.
    """
    part = F.pmod(F.xxhash64("doc", "check"), F.lit(PROBE_SHARE)) == 0
    some = base.where(part | (F.length("text") >= PROBE_LONG))
    runs = occurrences(some, width).groupBy("key", "content").agg(F.first("loc").alias("loc"))
    words = F.sum(F.expr("loc & 63") + width - 1) * PROBE_SHARE
    found = runs.groupBy("key").agg(words.alias("words")).where(F.col("words") > SHARD_WORDS).select("key")
    return np.sort(found.toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64))


def shared_runs(base: DataFrame, width: int) -> DataFrame:
    """The runs whose minimizer is in two documents or more, as far as they matter.

    ``first`` marks the run that stands for all with its words: the one in the smallest
    document; ``last_doc`` is the largest of them. Of the others only those in a document that
    is not the smallest with the minimizer are kept.
    """
    by_key = Window.partitionBy("key")
    same = Window.partitionBy("key", "content").orderBy("doc", "loc")
    alike = Window.partitionBy("key", "content")
    runs = occurrences(base, width, heavy_keys(base, width))
    runs = runs.withColumn("least", F.min("doc").over(by_key)).withColumn("most", F.max("doc").over(by_key))
    runs = runs.where("least < most").drop("most")
    runs = runs.withColumn("first", F.row_number().over(same) == 1).withColumn("last_doc", F.max("doc").over(alike))
    return runs.where("first OR doc > least").select(
        "key", "content", "doc", "loc", "first", "last_doc", (F.col("doc") > F.col("least")).alias("later")
    )


def run_words(base: DataFrame, shared: DataFrame, width: int) -> DataFrame:
    """(key, content, doc, last_doc, words): the words of the runs that stand for all."""
    wanted = shared.where("first").select(
        "doc",
        F.expr("cast(shiftright(loc, 6) & 65535 as long)").alias("check"),
        F.struct("key", "content", "last_doc", "loc").alias("run"),
    )
    wanted = wanted.groupBy("doc", "check").agg(F.collect_list("run").alias("runs"))
    joined = base.join(wanted, ["doc", "check"]).select("doc", "text", "runs")

    def start():
        def step(piece):
            out = []
            for doc, text, runs in zip(*(piece.column(c).to_pylist() for c in ("doc", "text", "runs"))):
                words = text.split()
                for r in runs:
                    at, n = r["loc"] >> 22, (r["loc"] & 63) + width - 1
                    out.append((r["key"], r["content"], doc, r["last_doc"], b" ".join(words[at : at + n])))
            return list(zip(*out)) or None

        return step

    return map_slices(joined, start, "key long, content long, doc long, last_doc long, words binary", weight="text", most=PIECE_BYTES)


def answer_shard(rows: list[tuple], width: int, per_index: int = INDEX_WORDS) -> list[tuple]:
    """(key, content, owners) of the rows (key, content, doc, last_doc, words) of whole keys.

    Every run is searched in the index of the shard; if the shard exceeds ``per_index`` words it
    has several indexes and the run is searched in each. ``owners`` are the smallest documents
    of its windows; runs with nothing to remove are left out.
    """
    split = [r[4].split() for r in rows]
    lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    numbers = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)), 1)}
    each = map(numbers.__getitem__, chain.from_iterable(split))
    words = np.fromiter(each, dtype=np.int64, count=int(lengths.sum()))
    docs = np.array([r[2] for r in rows], dtype=np.int64)
    ends = np.cumsum(lengths)
    least = np.full(len(words), NONE, dtype=np.int64)
    begin = 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - lengths[begin] + per_index, side="right")))
        part = words[ends[begin] - lengths[begin] : ends[end - 1]]
        index = FMIndex(part, lengths[begin:end], docs[begin:end], len(numbers) + 1, width)
        least = np.minimum(least, index.least_owners(words, lengths))
        begin = end
    out = []
    for r, a, n in zip(rows, ends - lengths, lengths):
        owners = least[a : a + n - width + 1]
        if owners.min(initial=NONE) < r[3]:
            out.append((r[0], r[1], owners.tolist()))
    return out


def least_owners(segments: DataFrame, width: int) -> DataFrame:
    """(key, content, owners): segments dealt out by minimizer, shard by shard through an index."""
    kind = schema_of("key long, content long, owners array<bigint>")
    arrow = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("owners", pa.list_(pa.int64()))])

    def run(batches):
        held, size = [], 0

        def answered(rows):
            found = answer_shard(rows, width)
            if found:
                yield record_batch(list(zip(*found)), arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield from answered(held)
                    held, size = [], 0
                held.append(row)
                size += row[4].count(b" ") + 1
        if held:
            yield from answered(held)

    return segments.repartition("key").sortWithinPartitions("key").mapInArrow(run, kind)


def base_of(docs: DataFrame) -> DataFrame:
    """Rows under a key that tells rows with one doc_id but other texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc"),
        F.expr("cast(xxhash64(coalesce(text, '')) & 65535 as long)").alias("check"),
        text.cast("binary").alias("text"),
    )


def removable(base: DataFrame, width: int) -> DataFrame:
    """(doc, check, cuts): for each document with anything to remove, (first word, mask) pairs.

    Bit i of a mask stands for the window of ``width`` words from the first word plus i.
    """
    shared = cut_lineage(shared_runs(base, width), "runs")
    owners = least_owners(run_words(base, shared, width), width)
    mask = F.expr("aggregate(transform(owners, (o, i) -> if(o < doc, shiftleft(1L, i), 0L)), 0L, (m, b) -> m | b)")
    cuts = shared.where("later").select("key", "content", "doc", "loc").join(owners, ["key", "content"])
    cuts = cuts.select(
        "doc",
        F.expr("cast(shiftright(loc, 6) & 65535 as long)").alias("check"),
        F.struct(F.expr("shiftright(loc, 22)").alias("at"), mask.alias("mask")).alias("cut"),
    )
    return cuts.where("cut.mask <> 0").groupBy("doc", "check").agg(F.collect_list("cut").alias("cuts"))


def covered(n: int, cuts: list[dict] | None, width: int) -> np.ndarray | None:
    """Which of ``n`` words the windows of the masks cover."""
    if not cuts:
        return None
    change = np.zeros(n + 1, dtype=np.int64)
    at = np.array([c["at"] for c in cuts], dtype=np.int64)
    masks = np.array([c["mask"] for c in cuts], dtype=np.int64)
    bits = (masks[:, None] >> np.arange(RUN)) & 1
    rows, shift = np.nonzero(bits)
    np.add.at(change, at[rows] + shift, 1)
    np.add.at(change, at[rows] + shift + width, -1)
    return np.cumsum(change[:-1]) > 0


def with_cuts(docs: DataFrame, width: int) -> DataFrame:
    """(doc, text, cuts) of every row. The texts are dealt out by their key once: fetching the
    words of runs and applying the cuts read the same exchange."""
    base = base_of(docs)
    named = base.where("doc IS NOT NULL")
    cut = named.join(removable(named, width), ["doc", "check"], "left").select("doc", "text", "cuts")
    return cut.unionByName(base.where("doc IS NULL").select("doc", "text"), allowMissingColumns=True)


def repeated_passages(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, ranges) for every row of ``docs``.

    A word goes if a window of ``width`` words that covers it also starts in a document with a
    smaller doc_id; windows are judged on the input. ``ranges`` are the (first word, words)
    removed. Null text has no words. A row with a null doc_id is compared with nothing and keeps
    all its words; rows with one doc_id are one document of which each row is answered on its
    own. Other columns are ignored.
    """

    def start():
        def step(piece):
            out = []
            for text, cuts in zip(piece.column("text").to_pylist(), piece.column("cuts").to_pylist()):
                words = text.split()
                gone = covered(len(words), cuts, width)
                ranges = []
                if gone is not None:
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    ranges = [{"at": int(a), "n": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]
                kept = words if gone is None else compress(words, ~gone)
                digest = hashlib.sha256(b" ".join(kept)).hexdigest()
                out.append((len(words), sum(r["n"] for r in ranges), digest, ranges))
            return [piece.column("doc"), *zip(*out)]

        return step

    return map_slices(
        with_cuts(docs, width),
        start,
        "doc_id long, n_words long, n_removed long, kept_sha256 string, ranges array<struct<at: bigint, n: bigint>>",
        weight="text",
        most=PIECE_BYTES,
    )


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the marked words and the white space after each."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2]):
        out.append(text[at : starts[a]])
        at = starts[b]
    return b"".join([*out, text[at:]])


def drop_repeated_passages(docs: DataFrame, width: int = 13) -> DataFrame:
    """The rows of ``docs``, all columns of whatever names, with the words that ``repeated_passages``
    removes cut out of their texts. Rows that lose all their words go; rows that lose none stay as
    they are. ``n_chars``, if there is such a column, follows the text.
    """
    plain = plain_names(docs)
    at, text = place_of("text", docs), f"c{place_of('text', docs)}"
    own = f"c{place_of('doc_id', docs)}"
    base = base_of(plain.select(F.col(own).alias("doc_id"), F.col(text).alias("text")))
    cuts = removable(base.where("doc IS NOT NULL"), width).withColumnsRenamed({"doc": "cut_doc", "check": "cut_check"})
    check = F.expr(f"cast(xxhash64(coalesce({text}, '')) & 65535 as long)")
    keyed = plain.withColumns({"own_check": check, "own_text": F.col(text).cast("binary")})
    same = (keyed[own].cast("long") == F.col("cut_doc")) & (F.col("own_check") == F.col("cut_check"))
    joined = keyed.join(cuts, same, "left").select(*plain.columns, "own_text", "cuts")
    kind = StructType([*plain.schema.fields, StructField("changed", BooleanType())])

    def start():
        def step(piece):
            texts, keep, changed = [], [], []
            for text, cut in zip(piece.column("own_text").to_pylist(), piece.column("cuts").to_pylist()):
                gone = covered(len(text.split()), cut, width) if cut else None
                changed.append(gone is not None)
                keep.append(gone is None or not gone.all())
                texts.append(without(text, gone) if gone is not None else text)
            columns = list(piece.columns[:-2])
            columns[at] = pa.array(texts, type=pa.binary()).cast(pa.string())
            rows = pa.RecordBatch.from_arrays([*columns, pa.array(changed)], names=kind.names)
            return list(rows.filter(pa.array(keep)).columns)

        return step

    out = map_slices(joined, start, kind, weight="own_text", most=PIECE_BYTES)
    if "n_chars" in [c.lower() for c in docs.columns]:
        chars = f"c{place_of('n_chars', docs)}"
        size = F.length(text).cast(plain.schema[chars].dataType)
        out = out.withColumn(chars, F.when(F.col("changed"), size).otherwise(F.col(chars)))
    return out.select(*plain.columns).toDF(*docs.columns)
