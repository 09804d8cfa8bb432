"""Quality rules: zstandard ratios of whole documents and fixed chunks inside bands by length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namestrata.llm.batches import keep_rows, map_slices, text_bytes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


#: Scripts, each with limits of its own.
PLAIN, NUMERIC, TWO_BYTE, WIDE = "plain", "numeric", "two_byte", "wide"
DIGITS, SPACES = b"0123456789", b" \t\n\r\x0b\x0c"
#: First bytes of the letters of two bytes, without those of Latin ones, and of three and four bytes.
TWO_BYTE_LEADS, WIDE_LEADS = bytes(range(0xC7, 0xE0)), bytes(range(0xE0, 0xF5))


def script(text: bytes) -> str:
    """NUMERIC if digits are two fifths of all but white space; else WIDE or TWO_BYTE if such letters
    are a third of it; else PLAIN."""
    solid = len(text) - count(text, SPACES)
    if count(text, DIGITS) * 5 > solid * 2:
        return NUMERIC
    if text.isascii():
        return PLAIN
    if count(text, WIDE_LEADS) * 9 > solid:
        return WIDE
    return TWO_BYTE if count(text, TWO_BYTE_LEADS) * 6 > solid else PLAIN


def count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


@dataclass(frozen=True)
class Bands:
    """Limits of the compressed size as a share of the raw size.

    ``least`` and ``most`` by script: (from this many bytes on, share). Short texts compress little,
    so their band reaches higher; below the first entry there is no verdict. Letters or digits
    drawn at random stay above ``most`` from some length on: plain letters of one case from 2400
    bytes, of both cases, hexadecimal and plain digits from 200; below it they compress no worse
    than prose. Prose in the same script stays below. Words of random letters of three bytes are as
    dense as prose in them, so WIDE is left wide.

    ``chunk_least`` and ``chunk_most`` are the band of a chunk of ``chunk_bytes`` (a shorter rest
    counts from half a chunk on), by the chunk's own script. A document fails if its own share
    leaves its band, or if more than ``chunk_part`` of its chunks leave theirs.
    """

    least: tuple[tuple[int, float], ...] = (
        (200, 0.32), (400, 0.30), (800, 0.28), (1600, 0.26), (3200, 0.24), (12800, 0.22), (51200, 0.20)
    )
    most: tuple[tuple[str, tuple[tuple[int, float], ...]], ...] = (
        (PLAIN, ((200, 0.82), (400, 0.75), (800, 0.69), (1600, 0.63), (2400, 0.58), (3200, 0.565), (6400, 0.55), (12800, 0.52), (51200, 0.50))),
        (NUMERIC, ((200, 0.54), (400, 0.48), (800, 0.46), (1600, 0.45), (3200, 0.44), (12800, 0.43), (51200, 0.42))),
        (TWO_BYTE, ((200, 0.80), (400, 0.68), (800, 0.58), (1600, 0.515), (3200, 0.48), (6400, 0.47), (12800, 0.455), (51200, 0.44))),
        (WIDE, ((200, 1.00), (400, 0.90), (800, 0.80), (1600, 0.74), (3200, 0.70), (12800, 0.68), (51200, 0.66))),
    )
    chunk_least: float = 0.24
    chunk_most: tuple[tuple[str, float], ...] = ((PLAIN, 0.575), (NUMERIC, 0.455), (TWO_BYTE, 0.49), (WIDE, 0.74))
    chunk_bytes: int = 4096
    chunk_part: float = 1 / 3
    level: int = 3


def word_measures(text: bytes | None) -> tuple[int, int, int, int, int]:
    """(words, word_chars, symbols, repeated lines, words in repeated 3-word windows)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    chars = len(text.translate(None, b" \t\n\r\x0b\x0c").decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words covered by windows of ``width`` words that occur twice or more."""
    if len(words) <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    key = ids[: len(ids) - width + 1]
    for k in range(1, width):
        # Renumbered after each word, so the product never overflows.
        key = key * len(numbers) + ids[k : k + len(key)]
        found, key = np.unique(key, return_inverse=True)
    if len(found) == len(key):
        return 0
    often = np.bincount(key)[key] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(width):
        covered[k : k + len(often)] |= often
    return int(covered.sum())


def shares(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """Compressed share of the whole text and of its chunks."""
    step = bands.chunk_bytes
    whole = len(packer.compress(text)) / len(text)
    if len(text) <= step:
        return whole, []
    chunks = [text[i : i + step] for i in range(0, len(text), step)]
    return whole, [len(packer.compress(c)) / len(c) for c in chunks if 2 * len(c) >= step]


def limit(steps: tuple[tuple[int, float], ...], size: int, below: float) -> float:
    """The limit for a text of ``size`` bytes; ``below`` where the first step is not reached."""
    for least, share in steps:
        if size >= least:
            below = share
    return below


def verdict(size: int, whole: float, chunks: list[float], bands: Bands, kind: str = PLAIN, kinds: list[str] | None = None) -> tuple[bool, int]:
    """(inside all bands, chunks outside theirs); ``kind`` and ``kinds`` are the scripts of the text
    and of its chunks."""
    most = dict(bands.chunk_most)
    out = sum(not bands.chunk_least <= c <= most[k] for c, k in zip(chunks, kinds or [PLAIN] * len(chunks)))
    low, high = limit(bands.least, size, 0.0), limit(dict(bands.most)[kind], size, float("inf"))
    return low <= whole <= high and out <= bands.chunk_part * len(chunks), out


def judge(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[bool, float, int, int]:
    """(inside all bands, share of the whole, chunks, chunks outside theirs) of a text that is not empty."""
    whole, chunks = shares(text, bands, packer)
    step = bands.chunk_bytes
    kinds = [script(text[i * step : (i + 1) * step]) for i in range(len(chunks))]
    inside, out = verdict(len(text), whole, chunks, bands, script(text), kinds)
    return inside, whole, len(chunks), out


def quality(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """Measures and verdict for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty text count as no words: all measures 0, ``base_failed`` true. Repeated rows
    give repeated results; a null doc_id stays null. No shuffle: one pass over the texts.
    """
    bands = bands or Bands()

    def start():
        packer = zstandard.ZstdCompressor(level=bands.level)

        def step(piece):
            rows = []
            for text in piece.column("text").to_pylist():
                counts = word_measures(text)
                base = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                inside, ratio, n, out = judge(text, bands, packer) if text else (True, None, 0, 0)
                rows.append((*counts, base, inside and not base, ratio, n, out))
            return [piece.column("doc_id"), *zip(*rows, strict=True)]

        return step

    return map_slices(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()),
        start,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, zstd_share double, n_chunks long, n_chunks_out long",
        weight="text",
    )


def keep_good(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """The rows of ``docs``, all columns of whatever names, that ``quality`` keeps; none without a word."""
    bands = bands or Bands()

    def start():
        packer = zstandard.ZstdCompressor(level=bands.level)

        def good(text: bytes | None) -> bool:
            counts = word_measures(text)
            if counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]:
                return False
            return judge(text, bands, packer)[0]

        return good

    return keep_rows(docs, start)
