"""SimHash near-duplicates: fingerprints of word shingles, joined by Golay-code fuzzy keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namestrata.llm.batches import map_slices, record_batch, schema_of, text_bytes
from namestrata.llm.components import connected_components, spanning_stars
from namestrata.llm.golay import SECOND_BITS, fuzzy_keys, links_within
from namestrata.session import cut_lineage

#: Groups up to this size are compared pair by pair, all groups of a batch at once.
SMALL_GROUP = 32
#: Links gathered by a task before they are thinned out to spanning stars and handed on.
LINKS_HELD = 1 << 20


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the shingles of ``width`` words, A-Z in lower case.

    Repeated shingles count each time. Fewer words make one shingle; none give zero.
    """
    words = text.lower().split() if text else ()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    n = len(stops)
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), dtype=np.uint64, count=n)
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 15):
        part = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed number."""

    def start():
        def step(piece):
            fps = [fingerprint(t, width, seed) for t in piece.column("text").to_pylist()]
            return [piece.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))]

        return step

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    return map_slices(docs, start, "doc_id long, fp long", weight="text")


def keyed(fps: DataFrame) -> DataFrame:
    """(key, fp): each distinct fingerprint under its 1 to about 60 fuzzy keys."""

    def start():
        def step(piece):
            own = piece.column("fp").to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(own.view(np.uint64))
            return [pa.array(keys), pa.array(own[rows])]

        return step

    return map_slices(fps.select("fp"), start, "key long, fp long")


def links_of_groups(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the fingerprints that share a key; ``keys`` is sorted."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    us, vs = [], []
    end = np.repeat(starts + sizes, np.where(sizes <= SMALL_GROUP, sizes, 0))
    at = np.flatnonzero(np.repeat(sizes <= SMALL_GROUP, sizes))
    for lag in range(1, SMALL_GROUP):
        inside = at + lag < end
        at, end = at[inside], end[inside]
        if not len(at):
            break
        hit = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= most]
        us.append(fps[hit])
        vs.append(fps[hit + lag])
    for s, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
        u, v = links_within(fps[s : s + n], most)
        us.append(fps[s : s + n][u])
        vs.append(fps[s : s + n][v])
    return np.concatenate([*us, fps[:0]]), np.concatenate([*vs, fps[:0]])


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all those within ``most`` bits.

    Keys are dealt out and sorted by Spark. A task reads its groups in a stream, holds one group
    (eight bytes a member) at a time and hands on a spanning star of each component it sees, so
    its output is at most its input however dense a group of near copies is. Keys are dealt out by
    their first part, which a fingerprint has ten of at most: so many tasks see it, and not one
    for each of its 60 keys.
    """
    kind = schema_of("a long, b long")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rest_keys, rest_fps, n = [], [], 0

        def thinned():
            u, v = spanning_stars(*(np.concatenate(x) for x in zip(*held)))
            return record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], arrow)

        def work(keys, fps):
            nonlocal n
            u, v = links_of_groups(keys, fps, most)
            if len(u):
                held.append((u, v))
                n += len(u)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            # Rows before the last key's first one end groups; the last group may go on.
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (rest_keys and rest_keys[0][0] != keys[0]):
                work(np.concatenate([*rest_keys, keys[:cut]]), np.concatenate([*rest_fps, fps[:cut]]))
                rest_keys, rest_fps = [], []
            rest_keys.append(keys[cut:])
            rest_fps.append(fps[cut:])
            if n > LINKS_HELD:
                yield thinned()
                held.clear()
                n = 0
        if rest_keys:
            work(np.concatenate(rest_keys), np.concatenate(rest_fps))
        if held:
            yield thinned()

    dealt = keyed(fps).repartition(F.shiftright("key", SECOND_BITS)).sortWithinPartitions("key")
    return dealt.mapInArrow(run, kind)


def near_duplicates(docs: DataFrame, most: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Two documents are linked if their fingerprints differ in at most ``most`` (up to 4) bits;
    component_id is the smallest doc_id reachable over links, the document's own included.
    Null and empty text have fingerprint zero and are linked like any other. A null doc_id is
    never the smallest unless the component has no other; repeated rows give repeated results.
    Equal texts meet as one fingerprint before anything is joined. Other columns are ignored.
    """
    if most > 4:
        raise ValueError("the fuzzy keys find fingerprints within 4 bits")
    all_fps = cut_lineage(fingerprints(docs, width, seed), "fingerprints")
    nodes = cut_lineage(all_fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes, most))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select(F.col("fp").alias("own"), "component_id")
    return all_fps.join(classes, all_fps.fp == classes.own).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, most: int = 4) -> DataFrame:
    """The document with the smallest doc_id of every component, with all its columns.

    Rows with a null doc_id have no identity to compare and all stay. Of repeated doc_ids one
    row stays.
    """
    classes = near_duplicates(docs.where("doc_id IS NOT NULL"), most)
    stay = classes.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.where("doc_id IS NOT NULL")
    kept = named.join(stay, named.doc_id == F.col("__id"), "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
