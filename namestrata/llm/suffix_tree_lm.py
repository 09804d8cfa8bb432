"""LM scoring by a probabilistic suffix tree over bytes, beside a smoothed unigram base."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namestrata.llm.batches import map_slices, record_batch, schema_of, slices, text_bytes
from namestrata.session import cut_lineage

#: Bytes of the longest context; with the next byte a run fits one 64-bit number.
DEPTH = 6
#: A context is kept if it was seen so often, and if its next bytes differ from those after its
#: suffix by so many nats in all, per kind of next byte and logarithm of its count.
LEAST_COUNT, LEAST_GAIN = 8, 0.1
#: Weight of the suffix's distribution in a context's, in counts per kind of next byte.
BACK = 4.0
#: Next bytes of kept contexts, and words, that a task holds at once. A larger tree or vocabulary is
#: dealt into shards, each of which goes over the texts once; the split changes no result.
HELD_RUNS, HELD_WORDS = 6_000_000, 4_000_000
#: Words and runs a task counts before it hands its counts on.
COUNTED_WORDS, COUNTED_RUNS = 400_000, 4_000_000
#: Words and runs whose logarithms a task remembers.
KNOWN_WORDS, KNOWN_RUNS = 300_000, 1 << 21
#: The end of a text; no word holds it.
END = b"\n"
ALPHABET = 256


def word_list(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def sequence(words: list[bytes]) -> bytes:
    """What the tree models: the words, one space between them, and the end."""
    return b" ".join(words) + END


def padded(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences behind DEPTH ends each, and where each begins."""
    pad = END * DEPTH
    sizes = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
    begins = np.cumsum(sizes + DEPTH) - sizes
    return np.frombuffer(b"".join(pad + s for s in sequences), dtype=np.uint8), begins


def runs(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Each byte of the sequences with the DEPTH bytes before it, as one number."""
    x = np.zeros(len(data) - DEPTH, dtype=np.uint64)
    for k in range(DEPTH + 1):
        x <<= np.uint64(8)
        x |= data[k : k + len(x)]
    inside = np.ones(len(x), dtype=bool)
    inside[(begins[1:, None] - DEPTH * 2 + np.arange(DEPTH)).reshape(-1)] = False
    return x[inside]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = firsts(keys)
    return keys[first], np.add.reduceat(counts, first)


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where each value of sorted ``keys`` begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])


def fold(folds: int = 5):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def tagged(docs: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, text, train): a null doc_id has no fold and is scored only."""
    train = F.coalesce(fold(folds) != 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(), train.alias("train"))


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


#: Kinds of rows of the statistics.
RUN, WORD, TOTAL = 0, 1, 2


def training_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all training texts: runs of bytes, words by hash, documents (key 0) and
    words (key 1). Tasks add up before the exchange."""
    kind = schema_of("kind int, key long, n long")
    arrow = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        words: Counter[bytes] = Counter()
        totals = [0, 0]
        held, size = [], 0

        def rows(what, keys, counts):
            keys = np.asarray(keys)
            return record_batch([pa.array(np.full(len(keys), what, np.int32)), pa.array(keys.astype(np.int64)), counts], arrow)

        for batch in batches:
            for piece in slices(batch, "text"):
                texts = [word_list(t) for t in piece.column("text").to_pylist()]
                totals[0] += len(texts)
                totals[1] += sum(map(len, texts))
                for ws in texts:
                    words.update(ws)
                if len(words) > COUNTED_WORDS:
                    yield rows(WORD, [word_key(w) for w in words], list(words.values()))
                    words.clear()
                keys, counts = np.unique(runs(*padded([sequence(ws) for ws in texts])), return_counts=True)
                held.append((keys, counts))
                size += len(keys)
                if size > 1.5 * COUNTED_RUNS:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > COUNTED_RUNS:
                        yield rows(RUN, *held[0])
                        held, size = [], 0
        if held:
            yield rows(RUN, *merged(held))
        yield rows(WORD, [word_key(w) for w in words], list(words.values()))
        yield rows(TOTAL, [0, 1], totals)

    counted = docs.where("train").select("text").mapInArrow(run, kind)
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def passing(n: np.ndarray, first: np.ndarray, of: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pass the test, total, kinds) of contexts whose next bytes were seen ``n`` times each, the
    first of each context at ``first``; ``of`` times of ``whole`` after the suffix.

    The gain is the count times the divergence of the next bytes after the context from those
    after its suffix without the first byte.
    """
    total = np.add.reduceat(n, first)
    kinds = np.diff(np.concatenate([first, [len(n)]]))
    ratio = (n / np.repeat(total, kinds)) / (of / whole)
    gain = np.add.reduceat(n * np.log(ratio), first)
    return (total >= LEAST_COUNT) & (gain >= LEAST_GAIN * kinds * np.log(total)), total, kinds


def subtree(keys: np.ndarray, n: np.ndarray, low: np.ndarray):
    """(depth, contexts, totals, next bytes, counts) by depth from 2 on of the contexts that pass.

    ``keys`` are sorted runs whose contexts end in the same two bytes, so every context from depth
    2 on is complete here, and so is its suffix; ``low`` counts next bytes after single bytes.
    """
    levels = {}
    for depth in range(DEPTH, 1, -1):
        end = np.uint64((1 << 8 * (depth + 1)) - 1)
        levels[depth] = merged([(keys & end, n)])
    for depth in range(2, DEPTH + 1):
        own, count = levels[depth]
        context = own >> np.uint64(8)
        first = firsts(context)
        if depth == 2:
            byte, before = (own & np.uint64(255)).astype(np.int64), (context & np.uint64(255)).astype(np.int64)
            of, whole = low[before, byte], low.sum(axis=1)[before]
        else:
            shorter, times = levels[depth - 1]
            at = np.searchsorted(shorter, own & np.uint64((1 << 8 * depth) - 1))
            start = firsts(shorter >> np.uint64(8))
            sums = np.add.reduceat(times, start)
            of, whole = times[at], sums[np.searchsorted(start, at, side="right") - 1]
        good, total, kinds = passing(count, first, of, whole)
        mine = np.repeat(good, kinds)
        if good.any():
            yield depth, context[first][good], total[good], kinds[good], (own[mine] & np.uint64(255)).astype(np.uint8), count[mine]


def tree_rows(counts: DataFrame, low: np.ndarray) -> DataFrame:
    """(ending, depth, context, total, next, n) of all contexts of two bytes and more that pass.

    Runs are dealt out by the last two bytes of their context. A task reads one such group at a
    time, as numbers: its size is the number of distinct runs around two bytes, not of occurrences.
    """
    kind = schema_of("ending int, depth int, context long, total long, next binary, n array<long>")
    lists = pa.list_(pa.int64())
    arrow = pa.schema([("ending", pa.int32()), ("depth", pa.int32()), ("context", pa.int64()), ("total", pa.int64()), ("next", pa.binary()), ("n", lists)])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def work(ending, keys, n):
            starts = firsts(ending)
            for s, e in zip(starts, [*starts[1:], len(ending)]):
                order = np.argsort(keys[s:e])
                for depth, context, total, kinds, byte, count in subtree(keys[s:e][order], n[s:e][order], low):
                    stop = np.concatenate([[0], np.cumsum(kinds)]).astype(np.int32)
                    after = [byte[a:b].tobytes() for a, b in zip(stop[:-1], stop[1:])]
                    size = len(context)
                    yield record_batch(
                        [np.full(size, ending[s], np.int32), np.full(size, depth, np.int32), pa.array(context.astype(np.int64)),
                         pa.array(total.astype(np.int64)), after, pa.ListArray.from_arrays(pa.array(stop), pa.array(count.astype(np.int64)), type=lists)], arrow
                    )

        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(c).to_numpy() for c in ("ending", "key", "n")]
            cut = int(np.searchsorted(part[0], part[0][-1]))
            if cut or (held and held[0][0][0] != part[0][0]):
                held.append(tuple(x[:cut] for x in part))
                ending, keys, n = (np.concatenate(x) for x in zip(*held))
                yield from work(ending, keys.view(np.uint64), n)
                held = []
            held.append(tuple(x[cut:] for x in part))
        if held:
            ending, keys, n = (np.concatenate(x) for x in zip(*held))
            yield from work(ending, keys.view(np.uint64), n)

    ending = F.expr("cast(shiftright(key, 8) & 65535 as int)")
    dealt = counts.where(f"kind = {RUN}").select(ending.alias("ending"), "key", "n")
    return dealt.repartition("ending").sortWithinPartitions("ending").mapInArrow(run, kind)


def depths(rows: DataFrame) -> Iterator[tuple[int, pa.Table]]:
    """(depth, contexts of that depth) of rows of the tree, one depth after the other: the driver
    never holds the rows of a whole shard beside its arrays."""
    for depth in range(2, DEPTH + 1):
        yield depth, rows.where(F.col("depth") == depth).select("context", "total", "next", "n").toArrow()


@dataclass
class SuffixTree:
    """The root and single bytes as counts, and the kept contexts of some endings: by depth the
    contexts, sorted, with totals and weights of their suffix, and their runs, sorted, with counts."""

    low: np.ndarray
    contexts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    followers: dict[int, tuple[np.ndarray, np.ndarray]]
    #: Whether an ending, two bytes as a number, is answered here.
    mine: np.ndarray

    @classmethod
    def of(cls, low: np.ndarray, table: pa.Table, mine: np.ndarray) -> SuffixTree:
        parts = ((depth, table.filter(pc.field("depth") == depth)) for depth in range(2, DEPTH + 1))
        return cls.of_depths(low, parts, mine)

    @classmethod
    def of_depths(cls, low: np.ndarray, parts: Iterable[tuple[int, pa.Table]], mine: np.ndarray) -> SuffixTree:
        """``parts`` are (depth, rows of that depth), of which one at a time is held."""
        contexts, followers = {}, {}
        for depth, own in parts:
            if not own.num_rows:
                continue
            context = np.asarray(own.column("context")).view(np.uint64)
            total = np.asarray(own.column("total")).astype(np.float64)
            kinds = np.asarray(pc.binary_length(own.column("next"))).astype(np.int64)
            # The bytes of all contexts lie end to end, as their counts do.
            run = np.repeat(context, kinds)
            run <<= np.uint64(8)
            run |= np.concatenate([_flat_bytes(c) for c in own.column("next").chunks])
            n = np.concatenate([np.asarray(c.flatten()) for c in own.column("n").chunks])
            del own
            # Whole numbers either way; halves what most trees take.
            n = n.astype(np.uint32) if int(n.max()) < 1 << 32 else n
            order = np.argsort(context)
            contexts[depth] = context[order], total[order], np.maximum(BACK * kinds[order], 1.0)
            order = np.argsort(run)
            followers[depth] = run[order], n[order]
        return cls(low, contexts, followers, mine)

    def log10(self, run: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each run, after the longest suffix of the bytes before
        it that was kept, which mixes in its own suffixes down to the root."""
        byte, before = (run & np.uint64(255)).astype(np.int64), ((run >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        root = self.low.sum(axis=0)
        chance = ((root + 0.5) / (root.sum() + 0.5 * ALPHABET))[byte]
        good, total, kinds = self.single()
        own = good[before]
        back = np.maximum(BACK * kinds, 1.0)[before]
        chance = np.where(own, (self.low[before, byte] + back * chance) / (total[before] + back), chance)
        for depth, (context, total, back) in self.contexts.items():
            key = run & np.uint64((1 << 8 * (depth + 1)) - 1)
            at = np.minimum(np.searchsorted(context, key >> np.uint64(8)), len(context) - 1)
            hit = np.flatnonzero(context[at] == key >> np.uint64(8))
            at, key = at[hit], key[hit]
            known, times = self.followers[depth]
            place = np.minimum(np.searchsorted(known, key), len(known) - 1)
            n = np.where(known[place] == key, times[place], 0)
            chance[hit] = (n + back[at] * chance[hit]) / (total[at] + back[at])
        return np.log10(chance)

    def single(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kept, total, kinds) of each single byte as a context."""
        total, kinds, root = self.low.sum(axis=1), (self.low > 0).sum(axis=1), self.low.sum(axis=0)
        good = np.zeros(256, dtype=bool)
        some = np.flatnonzero(total)
        if len(some):
            a, b = np.nonzero(self.low)
            n = self.low[a, b].astype(np.float64)
            good[some] = passing(n, firsts(a), root[b], np.full(len(b), root.sum()))[0]
        return good, total, kinds


def _flat_bytes(column: pa.BinaryArray) -> np.ndarray:
    """The bytes of all values of a column, from its own buffers."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)


class Scorer:
    """Log probabilities of texts under a tree; what a run gives is remembered by its hash's slot."""

    def __init__(self, tree: SuffixTree):
        self.tree = tree
        self.run = np.zeros(KNOWN_RUNS, dtype=np.uint64)
        # Empty slots hold no number.
        self.log = np.full(KNOWN_RUNS, np.nan)
        self.bits = np.uint64(64 - (KNOWN_RUNS - 1).bit_length())

    def log10(self, run: np.ndarray) -> np.ndarray:
        slot = ((run * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)
        out = self.log[slot]
        away = np.flatnonzero((self.run[slot] != run) | np.isnan(out))
        if len(away):
            new, back = np.unique(run[away], return_inverse=True)
            logs = self.tree.log10(new)
            out[away] = logs[back]
            slot = ((new * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)
            # Of runs that share a slot the last one stays, in both arrays alike.
            _, last = np.unique(slot[::-1], return_index=True)
            last = len(slot) - 1 - last
            self.run[slot[last]], self.log[slot[last]] = new[last], logs[last]
        return out

    def totals(self, sequences: list[bytes]) -> np.ndarray:
        """Log probability of each sequence over the bytes that are answered here."""
        if not sequences:
            return np.zeros(0)
        sizes = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        run = runs(*padded(sequences))
        logs = np.zeros(len(run))
        if self.tree.mine.all():
            logs = self.log10(run)
        else:
            mine = np.flatnonzero(self.tree.mine[((run >> np.uint64(8)) & np.uint64(65535)).astype(np.int64)])
            logs[mine] = self.log10(run[mine])
        return np.add.reduceat(logs, np.cumsum(sizes) - sizes)


class WordLogs:
    """log10(c + 0.5) and whether c > 0 of words, for the words of one shard; of others 0 and False."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shard: int, shards: int):
        self.keys, self.counts, self.shard, self.shards = keys, counts, shard, shards
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.logs, self.seen = np.zeros(0), np.zeros(0, dtype=bool)

    def learn(self, words: set[bytes]) -> None:
        """Looks up words that are not known yet, all at once."""
        new = list(words)
        key = np.fromiter(map(word_key, new), dtype=np.int64, count=len(new))
        c = np.zeros(len(new), dtype=np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            c = np.where(self.keys[at] == key, self.counts[at].astype(np.int64), 0)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.logs = np.concatenate([self.logs, np.where(key % self.shards == self.shard, np.log10(c + 0.5), 0.0)])
        self.seen = np.concatenate([self.seen, c > 0])

    def sums(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """By text: the logarithms added up, and the words seen."""
        words = list(chain.from_iterable(texts))
        new = set(words).difference(self.place)
        if len(self.place) + len(new) > KNOWN_WORDS:
            self.clear()
            new = set(words)
        self.learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        some = np.flatnonzero(sizes)
        base, known = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        if len(some):
            start = (np.cumsum(sizes) - sizes)[some]
            base[some] = np.add.reduceat(self.logs[at], start)
            known[some] = np.add.reduceat(self.seen[at].astype(np.int64), start)
        return base, known


def dealt_out(sizes: dict[int, int], most: int) -> tuple[np.ndarray, int]:
    """(shard of each ending, shards): the largest first, each to the emptiest shard, so that a
    shard holds at most ``most`` runs unless one ending alone has more."""
    shards = max(1, -(-int(sum(sizes.values()) * 1.05) // most)) if sum(sizes.values()) > most else 1
    of, load = np.zeros(65536, dtype=np.int64), np.zeros(shards, dtype=np.int64)
    for ending, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        of[ending] = int(load.argmin())
        load[of[ending]] += n
    return of, shards


def scored(docs: DataFrame, tree: SuffixTree, words: WordLogs, ends: int) -> DataFrame:
    """(doc_id, d1, d2, n_words, n_known, base, score) per row of ``docs``: what a shard knows of the
    logarithms of its words and bytes, and two digests that stand for the text."""
    # One object, so that a task reads it once.
    shared = docs.sparkSession.sparkContext.broadcast((tree, words, ends))

    def start():
        tree, words, ends = shared.value
        scorer = Scorer(tree)
        first = words.shard == 0
        end_base, end_known = (math.log10(ends + 0.5), int(ends > 0)) if first else (0.0, 0)

        def step(piece):
            raw = piece.column("text").to_pylist()
            texts = [word_list(t) for t in raw]
            base, known = words.sums(texts)
            digests = [[xxhash.xxh64_intdigest(t or b"", s) - (1 << 63) for t in raw] for s in (0, 1)]
            scores = scorer.totals([sequence(ws) for ws in texts])
            return [
                piece.column("doc_id"), *digests, [len(ws) for ws in texts], known + end_known, base + end_base, scores
            ]

        return step

    kind = "doc_id long, d1 long, d2 long, n_words long, n_known long, base double, score double"
    return map_slices(docs.select("doc_id", "text"), start, kind, weight="text")


def score(docs: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from the documents whose fold is not 1. Tokens are the words with A-Z in lower case and
    one end. Null text is a text without words; a null doc_id is scored but not learned from and
    not held out; repeated rows count and are scored each. With nothing to learn from, the base
    knows no token and the tree gives every byte the same chance. Other columns are ignored.

    ``score`` is the tree's log10 probability of the words, a space between them, and the end.
    Every context that passes the test is kept. What a task holds is bounded: where the tree or the
    vocabulary is larger, each shard of them goes over the texts once and narrow sums are added up.
    """
    docs = tagged(docs, folds)
    spark = docs.sparkSession
    counts = cut_lineage(training_counts(docs), "counts")
    totals = {r.key: r.n for r in counts.where(f"kind = {TOTAL}").collect()}
    vocabulary = counts.where(f"kind = {WORD}").count()
    low = np.zeros((256, 256), dtype=np.int64)
    pairs = counts.where(f"kind = {RUN}").groupBy(F.expr("key & 65535").alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    low.reshape(-1)[np.asarray(pairs.column("pair"))] = np.asarray(pairs.column("n"))
    del pairs
    tree = cut_lineage(tree_rows(counts, low), "tree")
    sizes = {r.ending: r.n for r in tree.groupBy("ending").agg(F.sum(F.size("n")).alias("n")).collect()}
    of, shards = dealt_out(sizes, HELD_RUNS)
    shards = max(shards, -(-vocabulary // HELD_WORDS))

    parts = []
    for s in range(shards):
        own = counts.where((F.col("kind") == WORD) & (F.pmod("key", F.lit(shards)) == s)).select("key", "n").toArrow().sort_by("key")
        key, n = (np.asarray(own.column(c)) for c in ("key", "n"))
        words = WordLogs(key, n.astype(np.uint32) if n.max(initial=0) < 1 << 32 else n, s, shards)
        del own, key, n
        endings = spark.createDataFrame([(int(e),) for e in sizes if of[e] == s], "ending int")
        rows = tree.join(F.broadcast(endings), "ending", "left_semi") if shards > 1 else tree
        parts.append(scored(docs, SuffixTree.of_depths(low, depths(rows), of == s), words, totals.get(0, 0)))
        del words
        # What Arrow has read stays with its pool otherwise, beside the next shard and run.
        pa.default_memory_pool().release_unused()
    out = parts[0]
    if shards > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        # Rows alike in id and text are one group, and as many rows again afterwards.
        sums = [F.sum(c).alias(c) for c in ("n_known", "base", "score")]
        out = out.groupBy("doc_id", "d1", "d2").agg(F.first("n_words").alias("n_words"), *sums, (F.count("*") / shards).alias("copies"))
        alike = [(F.col(c) / F.col("copies")).alias(c) for c in ("n_known", "base", "score")]
        out = out.select("doc_id", "n_words", *alike, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    learned = totals.get(0, 0) + totals.get(1, 0)
    norm = math.log10(learned + 0.5 * (vocabulary + (totals.get(0, 0) > 0) + 1))
    tokens = F.col("n_words") + 1
    return out.select(
        "doc_id",
        F.coalesce(fold(folds) == 1, F.lit(False)).alias("held_out"),
        tokens.alias("n_tokens"),
        F.col("n_known").cast("long").alias("n_known"),
        F.lit(learned).cast("long").alias("train_tokens"),
        (F.col("base") - tokens * norm).alias("base_score"),
        "score",
    )
