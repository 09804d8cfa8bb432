"""Near copies by the Jaccard similarity of word shingles: candidates from Golay-keyed fingerprints
of the words, verified on the shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namestrata.llm.batches import PIECE_BYTES, few, map_slices, plain_names, place_of, record_batch, schema_of, slices, text_bytes
from namestrata.llm.components import connected_components, spanning_stars, thinned
from namestrata.llm.fuzzy_simhash import links
from namestrata.session import cut_lineage

#: Words of a shingle, and the similarity from which two texts are copies.
WIDTH, SIMILARITY = 5, 0.8
#: Fingerprints of a text. A copy of similarity 0.8 has about one word in 45 changed, so that the
#: fingerprints of its distinct words are within four of 64 bits in more than half of the cases.
SEEDS = 4
#: Texts of a cluster of candidates that are compared in one task; a larger one is dealt into tiles.
TILE_TEXTS = 4096


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def word_print(words: list[bytes], seed: int) -> int:
    """Majority bits of the XXH64 of the distinct words; zero without words."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, seed) for w in set(words)), dtype=np.uint64)
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the distinct shingles; of fewer words the whole sequence is one."""
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1))}
    return np.fromiter(found, dtype=np.uint64, count=len(found))


def prints(docs: DataFrame, seeds: int) -> DataFrame:
    """(doc_id, body, content, fps): hashes of the text and of its words, and the fingerprints."""
    kind = pa.list_(pa.int64())

    def start():
        def step(piece):
            content, flat = [], []
            for text in piece.column("text").to_pylist():
                words = words_of(text)
                content.append(xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63))
                flat += [word_print(words, seed) for seed in range(seeds)]
            offsets = pa.array(np.arange(len(content) + 1, dtype=np.int32) * seeds)
            fps = pa.array(np.array(flat, dtype=np.uint64).view(np.int64))
            return [piece.column("doc_id"), piece.column("body"), content, pa.ListArray.from_arrays(offsets, fps, type=kind)]

        return step

    return map_slices(docs, start, "doc_id long, body long, content long, fps array<long>", weight="text", most=PIECE_BYTES)


def candidates(nodes: DataFrame, seeds: int) -> DataFrame:
    """(a, b): contents joined so that those with a fingerprint within four bits are connected.

    Links among fingerprints are many for a dense group, so they are settled into components, a row
    per fingerprint, before contents are joined; all of a component hang on its smallest content.
    """
    fps = F.posexplode("fps").alias("k", "fp")
    own = nodes.select("content", fps).select("content", "k", "fp", F.xxhash64("k", "fp").alias("place"))
    own = cut_lineage(own, "places")
    near = None
    for k in range(seeds):
        found = links(own.where(F.col("k") == k).select("fp").distinct())
        found = found.select(*[F.xxhash64(F.lit(k), end).alias(end) for end in ("a", "b")])
        near = found if near is None else near.union(found)
    # Stored first: two steps of Python in one task are two workers, which an executor keeps.
    roots = connected_components(thinned(cut_lineage(near, "links")))
    placed = own.join(roots, F.col("place") == F.col("node"), "left")
    placed = cut_lineage(placed.select("content", F.coalesce("root", "place").alias("place")), "placed")
    heads = placed.groupBy("place").agg(F.min("content").alias("head"), F.count("*").alias("all")).where("all > 1")
    return placed.join(heads, "place").where("content <> head").select(F.col("head").alias("a"), F.col("content").alias("b"))


def verified(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices) that connect all sets of at least ``similarity``; between unlike sides only,
    where sides are not negative.

    One set after the other meets those it is not yet connected with, by lists of the sets that hold
    each element. A set just found goes first: a text that has many copies is soon met and connects
    them, so that a cluster of copies costs little more than its size.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    owner = np.repeat(np.arange(n), sizes)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(element, kind="stable")
    held, start = owner[order], np.searchsorted(element[order], np.arange(int(element.max()) + 2))
    begin = np.cumsum(sizes) - sizes
    label = np.arange(n)
    asked = np.zeros(n, dtype=bool)
    us, vs, front = [], [], []
    rest = iter(range(n))
    while True:
        i = front.pop() if front else next((x for x in rest if not asked[x]), None)
        if i is None:
            break
        asked[i] = True
        if (label == label[i]).all():
            break
        own = element[begin[i] : begin[i] + sizes[i]]
        met = np.concatenate([held[start[e] : start[e + 1]] for e in own.tolist()])
        common = np.bincount(met, minlength=n)
        # |A and B| >= s |A or B|, in whole sizes so that no rounding decides.
        close = common * (1 + similarity) >= similarity * (sizes + sizes[i]) - 1e-9
        close &= (label != label[i]) & (common > 0)
        if side[i] >= 0:
            close &= side != side[i]
        found = np.flatnonzero(close)
        if not len(found):
            continue
        us.append(np.full(len(found), i))
        vs.append(found)
        best = common[found] / (sizes[found] + sizes[i] - common[found])
        front += [x for x in found[np.argsort(best, kind="stable")].tolist() if not asked[x]]
        label[np.isin(label, np.unique(label[found]))] = label[i]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([*us, none]), np.concatenate([*vs, none])


def verified_links(texts: DataFrame, width: int, similarity: float, tile: int) -> DataFrame:
    """(a, b): contents that are copies, connecting all copies of each cluster.

    ``texts`` has (root, content, text), a row per content. A cluster of more than ``tile`` texts is
    dealt into blocks, and each two blocks meet in a task of their own; a task holds the shingles
    of one cluster or tile at a time.
    """
    sizes = texts.groupBy("root").agg(F.count("*").alias("all")).where(F.col("all") > tile)
    sizes = sizes.select("root", F.ceil(F.col("all") / tile).cast("int").alias("blocks"))
    rows = texts.join(sizes, "root", "left")
    block = F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, block).alias("i"), F.greatest(o, block).alias("j")))
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    rows = rows.withColumn("tile", F.explode(F.coalesce(pairs, whole)))
    side = F.when(F.col("tile.i") < F.col("tile.j"), block).otherwise(F.lit(-1))
    rows = rows.select(F.xxhash64("root", "tile").alias("unit"), side.alias("side"), "content", "text")
    kind, arrow = schema_of("a long, b long"), pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        unit, side, content, sets = None, [], [], []

        def work():
            if len(sets) > 1:
                u, v = verified(sets, np.array(side), similarity)
                if len(u):
                    own = np.array(content, dtype=np.int64)
                    u, v = spanning_stars(own[u], own[v])
                    return record_batch([pa.array(u), pa.array(v)], arrow)

        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                for now, s, c, text in zip(*(piece.column(x).to_pylist() for x in ("unit", "side", "content", "text"))):
                    if now != unit:
                        if (out := work()) is not None:
                            yield out
                        unit, side, content, sets = now, [], [], []
                    side.append(s)
                    content.append(c)
                    sets.append(shingles(words_of(text), width))
        if (out := work()) is not None:
            yield out

    return rows.repartition("unit").sortWithinPartitions("unit", "content").mapInArrow(run, kind)


def copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, seeds: int = SEEDS, tile: int = TILE_TEXTS) -> DataFrame:
    """(doc_id, body, least_id, least_body, times): each distinct row of ``docs``, the row with the
    smallest doc_id among its copies, and how often the row itself occurs.

    Copies are rows connected by texts of at least ``similarity``. ``body`` is a hash of the text, so
    rows of one doc_id with unlike texts are rows of their own. Rows with a null doc_id are left out.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), body_of("text").alias("body"), text_bytes())
    rows = cut_lineage(prints(docs, seeds), "prints")
    least = F.min(F.struct("doc_id", "body")).alias("least")
    nodes = cut_lineage(rows.groupBy("content").agg(least, F.first("fps").alias("fps")), "nodes")
    edges = thinned(cut_lineage(candidates(nodes, seeds), "candidates"))
    rough = cut_lineage(connected_components(edges), "rough")
    wanted = rough.select(F.col("node").alias("content"), "root").join(nodes.select("content", "least"), "content")
    wanted = wanted.select("content", "root", F.col("least.doc_id").alias("doc_id"), F.col("least.body").alias("body"))
    texts = docs.join(few(cut_lineage(wanted, "wanted")), ["doc_id", "body"]).dropDuplicates(["content"]).select("root", "content", "text")
    found = connected_components(verified_links(texts, width, similarity, tile))
    classes = nodes.join(found.withColumnRenamed("node", "content"), "content", "left").select("content", "least", F.coalesce("root", "content").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("first"))
    classes = classes.join(least, "root").select("content", "first")
    rows = rows.groupBy("doc_id", "body").agg(F.first("content").alias("content"), F.count("*").alias("times"))
    return rows.join(classes, "content").select(
        "doc_id", "body", F.col("first.doc_id").alias("least_id"), F.col("first.body").alias("least_body"), "times"
    )


def body_of(text: str):
    """A hash of a text; null is a text of its own."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def drop_near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, seeds: int = SEEDS, tile: int = TILE_TEXTS) -> DataFrame:
    """One row of every group of copies, the one with the smallest doc_id, with all its columns, of
    whatever names.

    Rows with a null doc_id have no identity to compare and all stay. Null and empty texts are
    copies of each other. Of repeated rows one stays; rows that share a doc_id only do not count as
    copies.
    """
    plain = plain_names(docs)
    own, text = (f"c{place_of(c, docs)}" for c in ("doc_id", "text"))
    keyed = plain.withColumns({"own_id": F.col(own).cast("long"), "own_body": body_of(text)})
    classes = cut_lineage(copies(plain.select(F.col(own).alias("doc_id"), F.col(text).alias("text")), width, similarity, seeds, tile), "copies")
    first = (F.col("doc_id") == F.col("least_id")) & (F.col("body") == F.col("least_body"))
    names = {"doc_id": "own_id", "body": "own_body"}
    gone = cut_lineage(classes.where(~first).select("doc_id", "body").withColumnsRenamed(names), "gone")
    again = cut_lineage(classes.where(first & (F.col("times") > 1)).select("doc_id", "body").withColumnsRenamed(names), "again")
    kept = keyed.join(few(gone), ["own_id", "own_body"], "left_anti")
    if not again.isEmpty():
        repeated = kept.join(few(again), ["own_id", "own_body"], "left_semi").dropDuplicates(["own_id", "own_body"])
        kept = kept.join(few(again), ["own_id", "own_body"], "left_anti").unionByName(repeated)
    return kept.select(*plain.columns).toDF(*docs.columns)
