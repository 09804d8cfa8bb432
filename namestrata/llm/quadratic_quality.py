"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namestrata.llm.batches import map_slices, record_batch, schema_of, text_bytes
from namestrata.session import cut_lineage

#: Statistics of a text, in the order of ``statistics``.
NAMES = (
    "log_words log_chars word_length word_spread short_words long_words upper symbols pipes exclaims digits stops commas "
    "other_marks wide lines repeated_lines kinds top_word echoes pairs line_words entropy"
).split()
#: Scores from here on are predicted as label 1.
LIMIT = 0.3
#: Shares of the pooled covariance and of the identity in a class's own, of which the pair with the
#: least loss on folds set aside is taken.
POOLED, ROUND = (0.0, 0.1, 0.3, 0.7), (0.003, 0.03, 0.2)
#: Parts of the labelled rows that are set aside in turn.
PARTS = 4
#: Log density differences are rounded and clipped to this many classes for the calibration.
BINS, REACH = 400, 40.0
ASCII = 128
MARKS = bytes(b for b in range(0x21, 0x7F) if not bytes([b]).isalnum())
SYMBOLS = b"#*$%&<>"


def odds(n: float, of: float) -> float:
    """Log odds of a share, steady for none and for all."""
    return math.log((n + 0.5) / (max(of - n, 0) + 0.5))


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one whole text; null is an empty text."""
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    tally = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    count = lambda chars: int(tally[list(chars)].sum())
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    mean = float(lengths.mean()) if n else 0.0
    low = text.lower().split()
    often = Counter(low)
    echoes = sum(a == b for a, b in zip(low, low[1:]))
    pairs = len(set(zip(low, low[1:])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = tally[tally > 0] / max(1, size)
    marks, letters = count(MARKS), count(range(0x41, 0x5B)) + count(range(0x61, 0x7B))
    return [
        math.log1p(n),
        math.log1p(size),
        math.log1p(mean),
        math.log1p(float(lengths.std())) if n else 0.0,
        odds(float((lengths <= 3).sum()), n),
        odds(float((lengths >= 12).sum()), n),
        odds(count(range(0x41, 0x5B)), letters),
        odds(count(SYMBOLS), size),
        odds(count(b"|"), size),
        odds(count(b"!"), size),
        odds(count(range(0x30, 0x3A)), size),
        odds(count(b"."), n),
        odds(count(b","), n),
        odds(marks - count(SYMBOLS + b"|!.,"), size),
        odds(count(range(0xC0, 0x100)), size),
        math.log1p(len(lines)),
        odds(len(lines) - len(set(lines)), len(lines)),
        odds(len(often), n),
        odds(max(often.values(), default=0), n),
        odds(echoes, n),
        odds(pairs, max(0, n - 1)),
        math.log1p(n / max(1, len(lines))),
        float(-(share * np.log2(share)).sum()),
    ]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row of ``docs``."""

    def start():
        kind = pa.list_(pa.float64())

        def step(piece):
            rows = [statistics(t) for t in piece.column("text").to_pylist()]
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES))
            return [piece.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(np.array(rows).reshape(-1)), type=kind)]

        return step

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    return map_slices(docs, start, "doc_id long, x array<double>", weight="text")


@dataclass
class Moments:
    """Rows, mean and covariance of one class."""

    n: float
    mean: np.ndarray
    cov: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray) -> Moments:
        """From (1, x, x outer x) added up over rows."""
        d = len(NAMES)
        n = sums[0]
        mean = sums[1 : d + 1] / max(n, 1)
        return cls(n, mean, sums[d + 1 :].reshape(d, d) / max(n, 1) - np.outer(mean, mean))


@dataclass
class Discriminant:
    """Two Gaussian densities over scaled statistics, and the calibration of their difference."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    covs: list[np.ndarray]
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def of(cls, sums: np.ndarray, pooled: float, rounded: float) -> Discriminant:
        """From the sums of both classes, each with at least a row."""
        whole = Moments.of(sums.sum(axis=0))
        scale = np.sqrt(np.maximum(np.diag(whole.cov), 1e-6))
        own = [Moments.of(s) for s in sums]
        within = sum(c.n * c.cov for c in own) / whole.n
        covs = []
        for c in own:
            cov = ((1 - pooled) * c.cov + pooled * within) / np.outer(scale, scale)
            covs.append((1 - rounded) * cov + rounded * np.eye(len(scale)))
        return cls(whole.mean, scale, [(c.mean - whole.mean) / scale for c in own], covs, math.log(own[1].n / own[0].n))

    @cached_property
    def factors(self) -> list[tuple[np.ndarray, float]]:
        """By class the inverse Cholesky factor and the logarithm of the determinant."""
        lower = [np.linalg.cholesky(c) for c in self.covs]
        return [(np.linalg.inv(f), 2 * float(np.log(np.diag(f)).sum())) for f in lower]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, and the prior."""
        z = (x - self.centre) / self.scale
        half = []
        for mean, (inverse, log_det) in zip(self.means, self.factors):
            half.append(-0.5 * ((((z - mean) @ inverse.T) ** 2).sum(axis=1) + log_det))
        return half[1] - half[0] + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * np.clip(self.difference(x), -REACH, REACH) + self.offset)


def sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -500, 500)))


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def learning_rows(described: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(label, part, x) of the labelled documents of the folds to learn from.

    Labels of one doc_id are 1 if any is; its texts all count. Null ids and labels teach nothing.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max("quality").cast("int").alias("label"))
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = described.withColumn("digest", digest).where(F.pmod("digest", F.lit(folds)) != 0).join(marks, "doc_id")
    return rows.select("label", F.floor(F.col("digest") / folds).alias("d"), "x").select(
        "label", F.pmod("d", F.lit(PARTS)).cast("int").alias("part"), "x"
    )


def class_sums(rows: DataFrame) -> np.ndarray:
    """By part and class: rows, sums and sums of products. Tasks add up, so do exchanges; the driver
    takes a fixed number of sums."""
    d = len(NAMES)
    width = 1 + d + d * d
    kind = schema_of("cell int, value double")
    arrow = pa.schema([("cell", pa.int32()), ("value", pa.float64())])

    def run(batches):
        sums = np.zeros((PARTS * 2, width))
        for batch in batches:
            x = matrix(batch.column("x"))
            group = batch.column("part").to_numpy() * 2 + batch.column("label").to_numpy()
            for g in np.unique(group):
                own = x[group == g]
                sums[g] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
        cells = np.flatnonzero(sums.reshape(-1))
        yield record_batch([cells.astype(np.int32), sums.reshape(-1)[cells]], arrow)

    sums = np.zeros(PARTS * 2 * width)
    for r in rows.mapInArrow(run, kind).groupBy("cell").agg(F.sum("value").alias("value")).collect():
        sums[r.cell] = r.value
    return sums.reshape(PARTS, 2, width)


def set_aside(rows: DataFrame, models: dict[tuple[int, int], Discriminant]) -> np.ndarray:
    """By choice of shrinkage, label and bin of the log density difference: rows of the part that the
    model did not see."""
    choices = len(POOLED) * len(ROUND)
    shared = rows.sparkSession.sparkContext.broadcast(models)
    kind = schema_of("cell int, n long")
    arrow = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches):
        counts = np.zeros(choices * 2 * BINS, dtype=np.int64)
        for batch in batches:
            x, label, part = matrix(batch.column("x")), batch.column("label").to_numpy(), batch.column("part").to_numpy()
            for (choice, p), model in shared.value.items():
                own = part == p
                at = np.floor((np.clip(model.difference(x[own]), -REACH, REACH) + REACH) / (2 * REACH) * (BINS - 1) + 0.5).astype(np.int64)
                counts += np.bincount((choice * 2 + label[own]) * BINS + at, minlength=len(counts))
        cells = np.flatnonzero(counts)
        yield record_batch([cells.astype(np.int32), counts[cells]], arrow)

    counts = np.zeros(choices * 2 * BINS)
    for r in rows.mapInArrow(run, kind).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r.cell] = r.n
    return counts.reshape(choices, 2, BINS)


def calibrated(counts: np.ndarray, steps: int = 50) -> tuple[float, float, float]:
    """(loss a row, slope, offset) of the logistic curve over binned differences, by Newton steps."""
    t = (np.arange(BINS) / (BINS - 1) * 2 - 1) * REACH
    n = counts.sum(axis=0)
    beta = np.array([0.3, 0.0])
    for _ in range(steps):
        p = sigmoid(beta[0] * t + beta[1])
        w = np.maximum(n * p * (1 - p), 1e-12)
        # A weak pull to the start keeps the curve finite where a line divides the labels.
        slope = np.array([(counts[1] - n * p) @ t - (beta[0] - 0.3), (counts[1] - n * p).sum() - 0.1 * beta[1]])
        curve = np.array([[w @ t**2 + 1.0, w @ t], [w @ t, w.sum() + 0.1]])
        step = np.linalg.solve(curve, slope)
        beta = beta + step / max(1.0, np.abs(step).max())
    p = np.clip(sigmoid(beta[0] * t + beta[1]), 1e-9, 1 - 1e-9)
    loss = -(counts[1] @ np.log(p) + counts[0] @ np.log(1 - p)) / max(1.0, n.sum())
    return float(loss), float(max(beta[0], 1e-3)), float(beta[1])


def fit(rows: DataFrame) -> Discriminant | float:
    """The model of the labelled rows; with one class only or none, a constant score.

    All rows count. Each choice of shrinkage is judged on parts set aside, in one pass; the
    calibration of the best one comes from the same pass.
    """
    sums = class_sums(rows)
    n = sums[:, :, 0].sum(axis=0)
    if not n.all():
        return float((n[1] + 1) / (n.sum() + 2))
    grid = [(a, b) for a in POOLED for b in ROUND]
    models = {}
    for p in range(PARTS):
        rest = np.delete(sums, p, axis=0).sum(axis=0)
        if rest[:, 0].all():
            models |= {(i, p): Discriminant.of(rest, *g) for i, g in enumerate(grid)}
    found = [calibrated(c) for c in set_aside(rows, models)]
    best = min(range(len(grid)), key=lambda i: found[i][0])
    model = Discriminant.of(sums.sum(axis=0), *grid[best])
    model.slope, model.offset = found[best][1:]
    return model


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from labelled documents whose fold is not 0. Null and empty texts are described and
    scored as texts without words; a null doc_id is scored and not held out; repeated rows are
    scored each and taught each. With labels of one class or none all scores are equal. Of
    ``docs`` doc_id and text are read, of ``labels`` doc_id and quality.
    """
    rows = cut_lineage(described(docs), "described")
    learn = cut_lineage(learning_rows(rows, labels, folds), "learning")
    shared = docs.sparkSession.sparkContext.broadcast(fit(learn))

    def start():
        model = shared.value

        def step(piece):
            x = matrix(piece.column("x"))
            return [piece.column("doc_id"), np.full(len(x), model) if isinstance(model, float) else model.score(x)]

        return step

    scored = map_slices(rows, start, "doc_id long, score double")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted")
    )
