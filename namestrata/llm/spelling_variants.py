"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namestrata.llm.batches import record_batch, schema_of, slices, text_bytes
from namestrata.session import cut_lineage

#: Letters of a run after lower-casing, as UTF-8: a-z and the two-byte forms of U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LETTER_BYTES = bytes(range(0x61, 0x7B)) + b"\xc3" + bytes(range(0x80, 0xC0))
#: Texts of these bytes alone need no pattern: all but letters become spaces.
PLAIN_BYTES = bytes(range(0x80)) + LETTER_BYTES
TO_SPACES = bytes(b if b in LETTER_BYTES else 0x20 for b in range(256))
#: Words of fewer code points are no words here, nor are rarer ones.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A (document, run) pair in so many loses a letter.
DAMAGE = 31
#: How much more frequent a form is than its variant.
RATIO = 10
#: Distinct words a task counts before it hands its counts on.
WORDS_HELD = 400_000
#: Letters are dealt into so many parts. An edit changes the counts of at most two letters, so two
#: near words agree on all parts but two.
PARTS = 4
#: Words of one key that meet in one task; a key with more is dealt out in tiles.
TILE_WORDS = 16_384
#: Rows of a Gram matrix, columns of it, and rows gathered before they are worked on.
GRAM_ROWS, GRAM_COLUMNS, ROWS_HELD = 256, 2048, 16_384
#: Characters of candidate pairs laid side by side at once.
CELLS = 4_000_000


def runs(text: bytes) -> list[bytes]:
    """Maximal runs of letters, A-Z in lower case."""
    text = text.lower()
    if text.translate(None, PLAIN_BYTES):
        return RUN.findall(text)
    return text.translate(TO_SPACES).split()


def damaged(run: bytes, digest: int) -> bytes:
    """The run, or the run without a letter if DAMAGE divides the digest."""
    if digest % DAMAGE:
        return run
    letters = run.decode()
    k = digest % len(letters)
    return (letters[:k] + letters[k + 1 :]).encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of LEAST_LENGTH letters that occurs LEAST_COUNT times.

    A task adds up its own words before the shuffle and hands on what it holds when that is many.
    """
    kind, arrow = schema_of("word binary, n long"), pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        found: Counter[bytes] = Counter()
        for batch in batches:
            for piece in slices(batch, "text"):
                for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    if not text:
                        continue
                    salt = zlib.crc32(b"" if doc is None else b"%d" % doc)
                    salt = zlib.crc32(b":", salt)
                    # Letters are one or two bytes, so no shorter run has LEAST_LENGTH letters.
                    for word, n in Counter([w for w in runs(text) if len(w) >= LEAST_LENGTH]).items():
                        found[damaged(word, zlib.crc32(word, salt))] += n
                if len(found) > WORDS_HELD:
                    yield record_batch([list(found), list(found.values())], arrow)
                    found.clear()
        if found:
            yield record_batch([list(found), list(found.values())], arrow)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    counts = docs.mapInArrow(run, kind).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return counts.select(F.col("word").cast("string").alias("word"), "n").where(F.length("word") >= LEAST_LENGTH)


def letter_parts(words: DataFrame, parts: int = PARTS) -> np.ndarray:
    """The part of each of the 256 letters, the most frequent ones dealt out evenly.

    A letter is one code point up to U+00FF; what is gathered is one row per letter.
    """
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''")
    rows = letters.groupBy("letter").agg(F.count("*").alias("n")).collect()
    part = np.zeros(256, dtype=np.int64)
    for i, r in enumerate(sorted(rows, key=lambda r: (-r.n, r.letter))):
        back, k = divmod(i, parts)
        part[ord(r.letter)] = parts - 1 - k if back % 2 else k
    return part


class Words:
    """Words of a batch as letters laid end to end, one byte a letter, with their letter counts."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.letters, column = np.unique(self.flat, return_inverse=True)
        width = max(1, len(self.letters))
        cell = np.repeat(np.arange(len(words)), self.length) * width + column
        counts = np.bincount(cell, minlength=len(words) * width).reshape(len(words), width)
        # Products of counts stay exact: whole numbers below 2 ** 24, or doubles for longer words.
        self.counts = counts.astype(np.float32 if int(self.length.max(initial=0)) < 2048 else np.float64)

    def one_edit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b differ by exactly one edit; b is as long as a or one longer."""
        out = np.zeros(len(a), dtype=bool)
        order = np.argsort(self.length[a], kind="stable")
        start = 0
        while start < len(order):
            # As many pairs as fit into CELLS at the length of the last one.
            size = self.length[a[order[start:]]]
            stop = start + max(1, int(np.searchsorted(size * np.arange(1, len(size) + 1), CELLS)))
            some = order[start:stop]
            out[some] = self._one_edit(a[some], b[some])
            start = stop
        return out

    def _one_edit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = self.length[a]
        at = np.arange(int(size.max()))
        outside = at >= size[:, None]
        last = len(self.flat) - 1
        x = self.flat[np.minimum(self.begin[a][:, None] + at, last)]
        y = self.begin[b][:, None] + at
        differs = (x != self.flat[np.minimum(y, last)]) & ~outside
        shifted = (x != self.flat[np.minimum(y + 1, last)]) & ~outside
        # Inserted: equal up to some place, and from there on with b one letter ahead.
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), size)
        after = np.where(shifted.any(axis=1), len(at) - shifted[:, ::-1].argmax(axis=1), 0)
        return np.where(self.length[b] == size, differs.sum(axis=1) == 1, after <= first)


def gram_pairs(words: Words, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (a, b): rows of one group whose letter counts are at most two apart, squared.

    Rows are sorted by group and length. Blocks of rows are multiplied with the rows of their own
    and the next length; small groups share a block.
    """
    counts, length = words.counts, words.length
    norm = (counts * counts).sum(axis=1)
    n = len(group)
    place = np.concatenate([[True], group[1:] != group[:-1]])
    number = np.cumsum(place) - 1
    # Where the rows of this group that are at most one longer end: a sorted key of both.
    step = int(length.max(initial=0)) + 3
    key = number * step + length
    reach = np.searchsorted(key, key + 1, side="right")
    reach = np.minimum(reach, np.searchsorted(number, number, side="right"))
    for s in range(0, n, GRAM_ROWS):
        e = min(n, s + GRAM_ROWS)
        for c in range(s, int(reach[e - 1]), GRAM_COLUMNS):
            d = min(int(reach[e - 1]), c + GRAM_COLUMNS)
            apart = norm[s:e, None] + norm[None, c:d] - 2 * (counts[s:e] @ counts[c:d].T)
            a, b = np.nonzero(apart <= 2)
            far = apart[a, b]
            a, b = a + s, b + c
            longer = length[b] - length[a]
            # One letter more is at distance 1, one letter for another at distance 2.
            good = (b > a) & (number[a] == number[b]) & (((far == 1) & (longer == 1)) | ((far == 2) & (longer == 0)))
            yield a[good], b[good]


def near_in_groups(group: np.ndarray, choice: np.ndarray, side: np.ndarray, words: list[bytes], n: np.ndarray, part: np.ndarray, parts: int):
    """(row, near words, count of the most frequent one, that word) over the near pairs of a batch.

    ``choice`` is the number of the parts that a group agrees on, ``side`` the block of a tile a row
    comes from, -1 where all rows of the group meet. A pair counts in the first choice of parts
    that it agrees on only, so over all groups it counts once.
    """
    held = Words(words)
    choices = list(combinations(range(parts), parts - 2))
    of = part[held.letters] if len(held.letters) else np.zeros(1, dtype=np.int64)
    us, vs = [], []
    for a, b in gram_pairs(held, group):
        keep = (side[a] != side[b]) | (side[a] < 0)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        changed = held.counts[a] != held.counts[b]
        same = np.stack([~changed[:, of == p].any(axis=1) for p in range(parts)])
        agreed = np.stack([same[list(c)].all(axis=0) for c in choices])
        keep = agreed.any(axis=0) & (agreed.argmax(axis=0) == choice[a])
        a, b = a[keep], b[keep]
        near = held.one_edit(a, b) if len(a) else np.zeros(0, dtype=bool)
        us.append(a[near])
        vs.append(b[near])
    u, v = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in (us, vs))
    row, other = np.concatenate([u, v]), np.concatenate([v, u])
    if not len(row):
        return row, row, row, []
    seen = np.unique(other)
    rank = np.zeros(len(words), dtype=np.int64)
    rank[np.array(sorted(seen.tolist(), key=words.__getitem__))] = np.arange(len(seen))
    order = np.lexsort((rank[other], -n[other], row))
    row, other = row[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    best = other[first]
    return row[first], np.diff(np.concatenate([first, [len(row)]])), n[best], [words[i] for i in best.tolist()]


def keyed(words: DataFrame, part: np.ndarray, parts: int) -> DataFrame:
    """(unit, choice, word, n): each word under a key per choice of parts: their letter counts."""
    kind = schema_of("unit long, choice int, word binary, size int, n long")
    arrow = pa.schema([("unit", pa.int64()), ("choice", pa.int32()), ("word", pa.binary()), ("size", pa.int32()), ("n", pa.int64())])
    choices = list(combinations(range(parts), parts - 2))

    def run(batches):
        weight = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, "word"):
                own = [w.decode().encode("latin-1") for w in piece.column("word").to_pylist()]
                held = Words(own)
                counts = held.counts.astype(np.int64)
                of = part[held.letters]
                sums = [counts[:, of == p] @ weight[held.letters[of == p]] for p in range(parts)]
                for i, choice in enumerate(choices):
                    unit = np.full(len(own), i, dtype=np.int64)
                    for p in choice:
                        unit = (unit * np.int64(1_000_003)) ^ sums[p]
                    yield record_batch([pa.array(unit), np.full(len(own), i, np.int32), own, held.length.astype(np.int32), piece.column("n")], arrow)

    return words.select(F.col("word").cast("binary").alias("word"), "n").mapInArrow(run, kind)


def near_words(words: DataFrame, parts: int = PARTS, tile: int = TILE_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of every word of ``words`` (word, n) with a near word.

    Words that agree on the letter counts of a choice of parts meet in one task, sorted by length.
    A key of more than ``tile`` words is dealt into blocks, and each two blocks meet in a tile of
    their own, so no task's share grows with a key. Counts and best words are added up per
    batch of a task before the shuffle: pairs are never emitted.
    """
    part = letter_parts(words, parts)
    rows = cut_lineage(keyed(words, part, parts), "keyed")
    large = rows.groupBy("unit").agg(F.count("*").alias("all")).where(F.col("all") > tile)
    large = large.select("unit", F.ceil(F.col("all") / tile).cast("int").alias("blocks"))
    rows = rows.join(large, "unit", "left")
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, block).alias("i"), F.greatest(o, block).alias("j")))
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    rows = rows.withColumn("tile", F.explode(F.coalesce(tiles, whole)))
    unit = F.when(F.col("blocks").isNull(), F.col("unit")).otherwise(F.xxhash64("unit", "tile"))
    # Within one block's own tile all rows meet; between two blocks only rows of unlike ones.
    side = F.when(F.col("tile.i") == F.col("tile.j"), F.lit(-1)).otherwise(block)
    rows = rows.select(unit.alias("unit"), "choice", F.coalesce(side, F.lit(-1)).alias("side"), "word", "size", "n")
    dealt = rows.repartition("unit").sortWithinPartitions("unit", "choice", "size")
    kind = schema_of("word binary, near long, best_n long, best binary")
    arrow = pa.schema([("word", pa.binary()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.binary())])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table):
            unit, choice, side, n = (table.column(c).to_numpy().astype(np.int64) for c in ("unit", "choice", "side", "n"))
            own = table.column("word").to_pylist()
            row, near, best_n, best = near_in_groups(unit, choice, side, own, n, part, parts)
            utf8 = lambda ws: [w.decode("latin-1").encode() for w in ws]
            if len(row):
                return record_batch([utf8(own[i] for i in row.tolist()), pa.array(near), pa.array(best_n), utf8(best)], arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS_HELD:
                continue
            # Rows before the last unit's first one end units; the last unit may go on.
            table = pa.Table.from_batches(held)
            unit = table.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))
            if cut and (out := work(table.slice(0, cut))) is not None:
                yield out
            held = table.slice(cut).combine_chunks().to_batches()
        if held and (out := work(pa.Table.from_batches(held))) is not None:
            yield out

    found = dealt.mapInArrow(run, kind)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").cast("string").alias("best")))
    found = found.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def variants(docs: DataFrame, parts: int = PARTS, tile: int = TILE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts of ``docs``.

    Two words are near if they differ by exactly one inserted, deleted or replaced letter. ``form``
    is a word's most frequent near word (ties: the smallest) if that occurs RATIO times as often;
    ``root`` is the last word along forms. Null and empty texts hold no word. A null doc_id is
    written as nothing before the colon; repeated rows count each; other columns are ignored.

    A form occurs ten times as often as its word, so a chain has at most as many forms as the
    largest count has digits, and doubling steps over the links follow it.
    """
    words = cut_lineage(word_counts(docs), "words")
    near = near_words(words, parts, tile)
    form = F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best"))
    out = words.join(near, "word", "left").select(
        "word",
        form.alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(form.isNotNull(), F.col("best_n")).alias("form_n"),
    )
    out = cut_lineage(out, "near")
    links = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(math.log10(most) + 1)) if most > 1 else 0):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut_lineage(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return out.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


#: The same by deletion keys: words with equal rests at one place, or equal to a rest, are near.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c
         WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b::BIGINT) ORDER BY b) AS crc_table FROM range(256) r(b)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), counted AS (
  SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_transform(range(1, 2 * octet_length(encode(doc || ':' || run)) + 1, 2),
      lambda i: ('0x' || substr(hex(encode(doc || ':' || run)), i::INTEGER, 2))::BIGINT),
    lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS h
  FROM counted, bits
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
    ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7
), rests AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM rests a JOIN words b ON a.rest = b.word
), near AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM pairs GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form,
    CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN near USING (word)
), chain AS (
  SELECT word, word AS reached, 0 AS hop FROM formed
  UNION ALL SELECT c.word, f.form, hop + 1 FROM chain c JOIN formed f ON f.word = c.reached WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(reached, hop) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
