"""Ranked lexical search: the Best Position Algorithm over impact lists of shards of documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namestrata.llm.batches import map_slices, record_batch, schema_of, text_bytes
from namestrata.session import cut_lineage

#: Bytes of terms are digits, letters and all of code points beyond ASCII; the rest divide them.
TO_SPACES = bytes(b if b >= 0x80 or bytes([b]).isalnum() else 0x20 for b in range(256))
#: Scores in whole numbers: SATURATION / 1000 of a count's weight in the length, of 100 LENGTH parts.
SATURATION, LENGTH = 8, 75
#: Bytes of items whose terms a task holds at once; more items are answered block by block.
BLOCK_BYTES = 16 << 20
#: Postings and documents of a shard.
SHARD_POSTINGS, SHARD_DOCUMENTS = 2_000_000, 65_536
#: Positions of every list read in the first round; each round reads twice as deep.
FIRST_DEPTH = 16
#: Parts that the answers of an item are first ranked in.
SALTS = 64


def terms(text: bytes | None) -> list[bytes]:
    return text.lower().translate(TO_SPACES).split() if text else []


@dataclass
class Items:
    """A block of items: ids, and by item the numbers of its distinct terms and their repeats."""

    ids: list[int | None]
    numbers: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: list[bytes]

    @classmethod
    def of(cls, rows: Iterable) -> Items:
        number: dict[bytes, int] = {}
        ids, numbers, repeats = [], [], []
        for r in rows:
            found = Counter(terms(r.text))
            if found:
                ids.append(r.item_id)
                numbers.append(np.array([number.setdefault(t, len(number)) for t in found], dtype=np.int64))
                repeats.append(np.array(list(found.values()), dtype=np.int64))
        return cls(ids, numbers, repeats, list(number))


def blocks(items: DataFrame) -> Iterable[Items]:
    """The items in blocks of about BLOCK_BYTES; one longer item makes a block longer."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for i in range(n):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        # In an order of their own, so that a task run again numbers terms alike.
        block = Items.of(some.orderBy("item_id", "text").collect())
        if block.ids:
            yield block


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its length, the numbers of the terms
    of ``vocabulary`` that it holds, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    lists = pa.list_(pa.int32()), pa.list_(pa.int64())

    def start():
        number = {t: i for i, t in enumerate(shared.value)}

        def step(piece):
            held, sizes, ids, counts = [], [], [], []
            for text in piece.column("text").to_pylist():
                words = terms(text)
                found = [(number[t], n) for t, n in Counter(words).items() if t in number]
                held.append(len(words))
                sizes.append(len(found))
                ids += [i for i, _ in found]
                counts += [n for _, n in found]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, pa.array(x, k.value_type), type=k) for x, k in zip((ids, counts), lists)]
            return [piece.column("doc_id"), held, *columns]

        return step

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    found = map_slices(docs, start, "doc_id long, n long, terms array<int>, tfs array<long>", weight="text")
    return found.where("n > 0")


def weights(found: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """(weight of each of ``size`` terms, documents, terms in all)."""
    documents, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    w = np.zeros(size, dtype=np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
        w[r.t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
    return w, documents, length


class Shard:
    """Impact lists of some documents: by term, from the greatest impact down, and by document."""

    def __init__(self, size: int, doc_id: np.ndarray, begin: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.doc_id, self.begin, self.term, self.impact = doc_id, begin, term, impact
        owner = np.repeat(np.arange(len(doc_id)), np.diff(begin))
        order = np.lexsort((-impact, term))
        #: By place in the lists: document and impact; by posting of a document: its place.
        self.owner, self.sorted = owner[order], impact[order]
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.list = np.searchsorted(term[order], np.arange(size + 1))

    def search(self, numbers: np.ndarray, repeats: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], size: int):
        """``best`` (scores, doc_ids), at most k, merged with this shard's best for one item.

        Round by round every list is read deeper. Each document met is looked up in all lists, which
        gives its score and marks its places as seen. A list's best position is the last one up to
        which all are seen; no other document has more than the impacts there add up to. It is
        over once that is below the k-th score found, not before it equals it, as ties count.
        """
        start, stop = self.list[numbers], self.list[numbers + 1]
        live = stop > start
        start, stop, repeats, numbers = start[live], stop[live], repeats[live], numbers[live]
        if not len(start):
            return best
        times = np.zeros(size, dtype=np.int64)
        times[numbers] = repeats
        unseen = np.ones(len(self.owner), dtype=bool)
        new = np.ones(len(self.doc_id), dtype=bool)
        position = start.copy()
        depth, done = FIRST_DEPTH, 0
        while True:
            read = [self.owner[s + done : min(e, s + depth)] for s, e in zip(start.tolist(), stop.tolist()) if s + done < e]
            met = np.unique(np.concatenate(read)) if read else np.zeros(0, dtype=np.int64)
            met = met[new[met]]
            if len(met):
                new[met] = False
                count = self.begin[met + 1] - self.begin[met]
                at = np.repeat(self.begin[met] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                part = times[self.term[at]]
                scores = np.add.reduceat(part * self.impact[at], np.cumsum(count) - count)
                unseen[self.place[at[part > 0]]] = False
                best = smallest(np.concatenate([best[0], scores]), np.concatenate([best[1], self.doc_id[met]]), k)
            bound = 0
            for i, (p, e) in enumerate(zip(position.tolist(), stop.tolist())):
                if p < e:
                    left = unseen[p:e]
                    ahead = int(left.argmax())
                    position[i] = p + ahead if left[ahead] else e
                if position[i] < e:
                    # The first round has read every list's first place.
                    bound += int(repeats[i]) * int(self.sorted[position[i] - 1])
            if not bound or (len(best[0]) == k and bound < best[0][-1]):
                return best
            done, depth = depth, depth * 2


def smallest(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores above 0, ties by smaller id."""
    if len(scores) > 4 * k:
        # What is below the k-th score cannot be among them.
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[scores >= kth], ids[scores >= kth]
    order = np.lexsort((ids, -scores))[:k]
    order = order[scores[order] > 0]
    return scores[order], ids[order]


#: Stands for a null doc_id, which comes after all others.
NO_ID = np.iinfo(np.int64).max


def best_of_tasks(found: DataFrame, items: Items, weight: np.ndarray, documents: int, length: int, k: int, shard: int) -> DataFrame:
    """(item, item_id, doc_id, score): the k best of every item in the documents of each task."""
    shared = found.sparkSession.sparkContext.broadcast((items, weight))
    kind = schema_of("item long, item_id long, doc_id long, score long")
    arrow = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        items, weight = shared.value
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        best = [none] * len(items.ids)
        held: list[tuple[np.ndarray, ...]] = []

        def search():
            doc_id, n, count, term, tf = (np.concatenate(x) for x in zip(*held))
            held.clear()
            m = 100 - LENGTH + (LENGTH * n * documents) // length
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * np.repeat(m, count)))
            begin = np.concatenate([[0], np.cumsum(count)])
            lists = Shard(len(weight), doc_id, begin, term, impact)
            for i, (numbers, repeats) in enumerate(zip(items.numbers, items.repeats)):
                best[i] = lists.search(numbers, repeats, k, best[i], len(weight))

        size = rows = 0
        for batch in batches:
            ids, tfs = batch.column("terms"), batch.column("tfs")
            count = np.diff(ids.offsets.to_numpy())
            some = count > 0
            doc_id = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            if not some.any():
                continue
            n = batch.column("n").to_numpy()
            held.append((doc_id[some], n[some], count[some].astype(np.int64), ids.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()))
            size, rows = size + int(count.sum()), rows + int(some.sum())
            if size >= shard or rows >= SHARD_DOCUMENTS:
                search()
                size = rows = 0
        if held:
            search()
        numbers = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        scores, ids = (np.concatenate([*x, none[0]]) for x in (zip(*best) if best else ((), ())))
        yield record_batch([numbers, [items.ids[i] for i in numbers], pa.array(ids, mask=ids == NO_ID), scores], arrow)

    return found.mapInArrow(run, kind)


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of ``docs`` with the highest score above 0 for
    every row of ``items`` (item_id, text), equal scores by ascending doc_id.

    Null and empty texts hold no term: such documents count nowhere and such items have no answer.
    Every row is a document or an item of its own, so repeated doc_ids are ranked each and repeated
    items answered each; a null doc_id comes after its equals. Other columns are ignored.

    Lengths and document counts are taken over all documents. Each task ranks its own documents,
    ``shard`` postings at a time, for a block of items; only k rows an item and task are shuffled.
    """
    out = None
    for block in blocks(items):
        found = cut_lineage(postings(docs, block.vocabulary), "postings")
        weight, documents, length = weights(found, len(block.vocabulary))
        ranked = best_of_tasks(found, block, weight, documents, length, k, shard)
        order = F.desc("score"), F.asc_nulls_last("doc_id")
        for by in (("item", "salt"), ("item",)):
            ranked = ranked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
            ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        ranked = ranked.select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


ORACLE = r"""
WITH held AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY ALL
), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id
), whole AS (SELECT count(*) AS documents, sum(n)::BIGINT AS length FROM lengths
), frequency AS (SELECT term, count(*) AS df FROM tfs GROUP BY term
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), repeats AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL
), impacts AS (
  SELECT doc_id, term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // length))) AS impact
  FROM tfs JOIN lengths USING (doc_id) JOIN frequency USING (term), whole
), scores AS (
  SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM repeats JOIN impacts USING (term) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
