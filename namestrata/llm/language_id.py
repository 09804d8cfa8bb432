"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namestrata.llm.batches import BROADCAST_ROWS, keep_rows, map_slices, text_bytes

ORDER = 4
#: Bound of the fitted model: characters of labelled text over all languages, and a text of each
#: language more. Every text is scored; only the fit is on a sample.
SAMPLE_CHARS = 4_000_000
#: Languages whose values share a table. More languages are more tables, with no more values.
TABLE_LANGUAGES = 64
#: A text is rejected beyond the median cross-entropy of its language by SLACK bits plus SPREADS
#: times the deviation, for its length, that nine of ten calibration texts stay below.
SLACK, SPREADS = 1.0, 4.0
#: Letters and gaps that count in the score, so that a long text is not certain beyond reason.
EVIDENCE = 100

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def normal(text: str) -> np.ndarray:
    """Code points of the letters in lower case, one gap for whatever stands between them.

    Empty if there is no letter; else with ORDER - 1 gaps before and one after it.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = letters()[points]
    if not letter.any():
        return points[:0]
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = points[keep]
    if not letter[-1] and points[-1] != 32:
        points = np.append(points, np.uint32(32))
    lead = np.full(ORDER - 1, 32, dtype=np.uint32)
    tail = np.full(int(points[-1] != 32), 32, dtype=np.uint32)
    return np.concatenate([lead, points[1:] if points[0] == 32 else points, tail])


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` code points."""
    wide = points.astype(np.uint64) + np.uint64(1)
    count = len(points) - n + 1
    x = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        x = (x + wide[k : k + count]) * MULTIPLIER
        x ^= x >> np.uint64(32)
    return x


@dataclass
class Table:
    """Values of hashes, sorted for lookup; a column per language."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, rows: dict[str, list[float]], n: int, languages: int) -> Table:
        if not rows:
            return cls(np.zeros(0, np.uint64), np.zeros((0, languages), np.float32))
        points = np.array([[ord(c) for c in g] for g in rows], dtype=np.uint32).reshape(len(rows), n)
        keys = gram_hashes(points.reshape(-1), n)[::n] if n else np.zeros(1, np.uint64)
        order = np.argsort(keys)
        return cls(keys[order], np.array(list(rows.values()), dtype=np.float32)[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, found) of every key."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


@dataclass
class Block:
    """Some languages: log probabilities of grams and log weights of contexts by order, in columns."""

    grams: list[Table]
    contexts: list[Table]
    unseen: np.ndarray

    def part(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.unseen))
        # Position of each predicted character that the order at hand still has to answer for.
        at = np.arange(ORDER - 1, len(points))
        for n in range(ORDER, 0, -1):
            row, found = self.grams[n - 1].find(gram_hashes(points, n)[at - n + 1])
            total += self.grams[n - 1].values[row[found]].sum(axis=0, dtype=np.float64)
            at = at[~found]
            if not len(at):
                return total
            if n > 1:
                row, found = self.contexts[n - 1].find(gram_hashes(points, n - 1)[at - n + 1])
                total += self.contexts[n - 1].values[row[found]].sum(axis=0, dtype=np.float64)
        return total + len(at) * self.unseen


@dataclass
class Models:
    """One model per language, in blocks of TABLE_LANGUAGES, and the limits of rejection."""

    languages: list[str]
    blocks: list[Block]
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    def log_likelihood(self, points: np.ndarray) -> np.ndarray:
        """Log probability of a normalised text under every language."""
        total = np.zeros(len(self.languages))
        step = max(1024, (1 << 20) // max(1, min(len(self.languages), TABLE_LANGUAGES)))
        for begin in range(0, len(points) - ORDER + 1, step):
            total += self._part(points[begin : begin + step + ORDER - 1])
        return total

    def _part(self, points: np.ndarray) -> np.ndarray:
        return np.concatenate([b.part(points) for b in self.blocks])

    def predict(self, text: bytes | None) -> tuple[str, float, float | None, int]:
        """(language, score, cross-entropy in bits, length); ``und`` where there is no letter."""
        points = normal(text.decode("utf-8", "replace")) if text and self.languages else ()
        n = len(points) - ORDER + 1
        if n < 1:
            return "und", 0.0, None, 0
        bits = -self.log_likelihood(points) / (n * math.log(2))
        best = int(np.argmin(bits))
        weight = np.exp2((bits[best] - bits) * min(n, EVIDENCE))
        return self.languages[best], float(1 / weight.sum()), float(bits[best]), n

    def rejects(self, language: str, bits: float | None, n: int) -> bool:
        """No letter, or further from the language than texts of such a length are."""
        middle, spread = self.limits.get(language, (math.inf, 0.0))
        return bits is None or bits > middle + SLACK + SPREADS * spread / math.sqrt(n)


def kneser_ney(counts: dict[str, Counter]) -> Models:
    """Models from the counts of runs of ORDER characters by language.

    Lower orders count the distinct characters a run follows; each order takes one discount
    from its share of runs seen once and twice, and hands it on to the next lower order.
    """
    languages = sorted(counts)
    alphabet = len({c for grams in counts.values() for g in grams for c in g}) + 1
    probability, weight = [], []
    for language in languages:
        levels: dict[int, Counter] = {ORDER: counts[language]}
        for n in range(ORDER - 1, 0, -1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])
        p: list[dict[str, float]] = [{"": 1 / alphabet}]
        back: list[dict[str, float]] = [{}]
        for n in range(1, ORDER + 1):
            total, kinds = Counter(), Counter()
            for g, v in levels[n].items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            seen = Counter(levels[n].values())
            discount = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] else 0.5
            discount = min(max(discount, 0.1), 0.9)
            back.append({h: discount * kinds[h] / t for h, t in total.items()})
            p.append(
                {
                    g: (v - discount) / total[g[:-1]] + back[n][g[:-1]] * p[n - 1][g[1:] if n > 1 else ""]
                    for g, v in levels[n].items()
                }
            )
        probability.append(p)
        weight.append(back)

    def chance(k: int, g: str) -> float:
        factor = 1.0
        while g not in probability[k][len(g)]:
            factor *= weight[k][len(g)].get(g[:-1], 1.0)
            g = g[1:]
        return factor * probability[k][len(g)][g]

    def block(some: range) -> Block:
        grams, contexts = [], []
        for n in range(1, ORDER + 1):
            every = sorted({g for k in some for g in probability[k][n]})
            grams.append(Table.of({g: [math.log(chance(k, g)) for k in some] for g in every}, n, len(some)))
            every = sorted({h for k in some for h in weight[k][n]}) if n > 1 else []
            contexts.append(
                Table.of({h: [math.log(weight[k][n].get(h, 1.0)) for k in some] for h in every}, n - 1, len(some))
            )
        return Block(grams, contexts, np.array([math.log(chance(k, "\0")) for k in some]))

    count = len(languages)
    return Models(languages, [block(range(i, min(count, i + TABLE_LANGUAGES))) for i in range(0, count, TABLE_LANGUAGES)])


def labelled_sample(docs: DataFrame, chars: int) -> DataFrame:
    """Rows (lang, text, calibrates) of about ``chars`` characters of text, evenly over languages.

    ``docs`` has doc_id, text and lang. Rows are taken in the order of a hash of doc_id until a
    language has its part, so the last one may go beyond it and every language has one; one in
    eight, never a language's first, is set aside for calibration. The labels alone are gathered.
    """
    size = F.length("text")
    place = F.xxhash64("doc_id", F.lit("sample"))
    spot = F.pmod(place, F.lit(1 << 30))
    langs = docs.groupBy("lang").agg(F.sum(size).alias("size"), F.min(spot).alias("least")).collect()
    room = chars // max(1, len(langs))
    spark = docs.sparkSession
    # The share of a language that fills its room once and a half, and its first row at least; the
    # window below cuts exactly.
    until = [max(r.least, int(min(1.0, 1.5 * room / max(1, r.size)) * (1 << 30))) for r in langs]
    # By way of Arrow: a list of rows starts a Python daemon of another kind on executors, which stays.
    bounds = pa.table({"lang": pa.array([r.lang for r in langs], pa.string()), "until": pa.array(until, pa.int64())})
    bounds = spark.createDataFrame(bounds)
    bounds = F.broadcast(bounds) if len(langs) <= BROADCAST_ROWS else bounds
    taken = docs.join(bounds, "lang").withColumn("place", place)
    taken = taken.where(spot <= F.col("until"))
    by = Window.partitionBy("lang").orderBy("spot", "place", "doc_id", F.xxhash64("text"))
    before = F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, -1))
    taken = taken.withColumn("spot", spot).withColumn("before", F.coalesce(before, F.lit(0)))
    taken = taken.withColumn("first", F.row_number().over(by) == 1).where(F.col("first") | (F.col("before") < room))
    aside = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(8)) == 0
    return taken.select("lang", text_bytes(), (aside & ~F.col("first")).alias("calibrates"))


def gram_counts(sample: DataFrame) -> dict[str, Counter]:
    """Counts of runs of ORDER characters by language; bounded by the sample."""

    def start():
        def step(piece):
            found: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
                points = normal(text.decode("utf-8", "replace"))
                if len(points):
                    s = "".join(map(chr, points.tolist()))
                    found[lang].update(s[i : i + ORDER] for i in range(len(s) - ORDER + 1))
            rows = [(lang, g, n) for lang, grams in found.items() for g, n in grams.items()]
            return list(zip(*rows)) or None

        return step

    counted = map_slices(sample.select("lang", "text"), start, "lang string, gram string, n long", weight="text")
    out: dict[str, Counter] = defaultdict(Counter)
    for row in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.lang][row.gram] = row.n
    return dict(out)


def fit(docs: DataFrame, chars: int = SAMPLE_CHARS) -> Models:
    """Models and rejection limits from labelled ``docs`` (doc_id, text, lang).

    Rows without a letter or label take no part; every label with a letter is learned. With no labelled letter at all the models are
    empty and every text is ``und``. The limits come from texts the models were not fitted on
    (see SLACK); a language without such texts rejects nothing.
    """
    labelled = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    sample = labelled_sample(labelled.select("doc_id", "text", "lang"), chars)
    models = kneser_ney(gram_counts(sample.where("NOT calibrates")))
    if not models.languages:
        return models
    held = predictions(sample.where("calibrates").select(F.lit(0).cast("long").alias("doc_id"), "text"), models)
    held = held.where("bits IS NOT NULL")
    middle = held.groupBy("lang_pred").agg(F.median("bits").alias("middle"))
    off = held.join(F.broadcast(middle), "lang_pred").withColumn("off", F.expr("abs(bits - middle) * sqrt(n_letters)"))
    for r in off.groupBy("lang_pred", "middle").agg(F.percentile("off", F.lit(0.9)).alias("spread")).collect():
        models.limits[r.lang_pred] = r.middle, r.spread
    return models


def predictions(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, bits, n_letters) for every row of ``docs``.

    Null text and text without a letter give ``und`` with score 0 and are rejected. Of equally
    likely languages the first in order of name is taken. Repeated rows give repeated results;
    other columns are ignored. No shuffle.
    """

    def start():
        def step(piece):
            out = []
            for text in piece.column("text").to_pylist():
                lang, score, bits, n = models.predict(text)
                out.append((lang, score, models.rejects(lang, bits, n), bits, n))
            return [piece.column("doc_id"), *zip(*out)]

        return step

    return map_slices(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()),
        start,
        "doc_id long, lang_pred string, score double, rejected boolean, bits double, n_letters long",
        weight="text",
    )


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of ``docs``, all columns of whatever names, whose language the models do not reject."""

    def start():
        def good(text: bytes | None) -> bool:
            lang, _, bits, n = models.predict(text)
            return not models.rejects(lang, bits, n)

        return good

    return keep_rows(docs, start)


def fold(column: str = "doc_id", folds: int = 3):
    """The held-out remainder of a document: of the CRC-32 of its id as text."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def identify(docs: DataFrame, chars: int = SAMPLE_CHARS, folds: int = 3) -> DataFrame:
    """Fit on the documents whose fold is not 1, predict all: (doc_id, held_out, lang_pred, ...)."""
    models = fit(docs.where(fold(folds=folds) != 1), chars)
    out = predictions(docs, models)
    held = F.coalesce(fold(folds=folds) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected", "bits", "n_letters")
