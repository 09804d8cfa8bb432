import base64
import random
import re
from collections import Counter

import zstandard

from namestrata.llm.compression_bands import Bands, judge, keep_good, quality, repeated_words, script, verdict, word_measures
from tests.conftest import SF

SCHEMA = "doc_id long, text string, kept string, n_words int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k for i, w in enumerate(windows) if w in often for k in range(i, i + 3)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), base


def odd_rows(spark):
    rng = random.Random(1)
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    noise = base64.b85encode(rng.randbytes(9000)).decode()
    spaced = " ".join(noise[i : i + 8] for i in range(0, len(noise), 8))
    loop = " ".join(f"{a} {b}" for a in "abcdefgh" for b in "ijklmnop") + "\n"
    texts = [*prose, None, "", " \n\t", "a b c a b c", "é ü # | <", "x\ny\nx\n\nx \n", spaced, loop * 60, "w " * 40_000]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    return rows + [rows[1], rows[1], (None, prose[0], None, None)], len(prose)


def test_measures_match_plain_version(spark):
    rows, n = odd_rows(spark)
    got = quality(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = sorted((str(d), *plain(t)) for d, t, *_ in rows)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r.doc_id), *(r[c] for c in columns)) for r in got) == want
    packer = zstandard.ZstdCompressor(level=3)
    for r in got:
        text = rows[r.doc_id][1] if r.doc_id is not None else rows[0][1]
        inside = not text or judge(text.encode(), Bands(), packer)[0]
        assert r.kept == (inside and not r.base_failed)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    # Prose passes; noise and loops that the word rules let through do not.
    good = [r for i, r in by_id.items() if i < n and not r.base_failed]
    assert sum(r.kept for r in good) == len(good) > 100
    assert not by_id[n + 6].kept and not by_id[n + 6].base_failed
    assert not by_id[n + 7].kept


def test_kept_rows_keep_their_columns(spark):
    rows, _ = odd_rows(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = keep_good(docs)
    want = {(str(r.doc_id)) for r in quality(docs).collect() if r.kept}
    assert kept.columns == docs.columns and {str(r.doc_id) for r in kept.collect()} == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality(empty).count() == 0 and keep_good(empty).count() == 0


def test_bands_by_length():
    bands = Bands()
    assert verdict(100, 1.4, [], bands)[0] and not verdict(5000, 0.1, [], bands)[0] and not verdict(5000, 0.9, [], bands)[0]
    assert verdict(9000, 0.4, [0.4, 0.4, 0.1, 0.4], bands) == (True, 1)
    assert verdict(9000, 0.4, [0.1, 0.1, 0.4], bands) == (False, 2)


def test_repeated_words_of_many_kinds():
    words = [b"%d" % i for i in range(5000)]
    assert repeated_words(words) == 0
    assert repeated_words(words + words[10:13]) == 6
    assert repeated_words([b"a"] * 4) == 4 and repeated_words([b"a"] * 3) == 0
    assert word_measures(None) == word_measures(b"") == (0, 0, 0, 0, 0)


def words_of(letters, size, seed=0):
    """Words of random letters, of at least so many bytes in all."""
    rng = random.Random(seed)
    out, n = [], 0
    while n < size:
        out.append("".join(rng.choices(letters, k=rng.randint(2, 9))))
        n += len(out[-1].encode()) + 1
    return " ".join(out)


LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Whether each length (300, 600, 1000, 2500, 9000, 60000 bytes) passes: below 2400 bytes letters of
#: one case pack no better or worse than prose.
NOISE = {
    "plain": (LOWER, (True, True, True, False, False, False)),
    "both cases": (LOWER + LOWER.upper(), (False, False, False, False, False, False)),
    "base 64": (LOWER + LOWER.upper() + "0123456789+/", (False, False, False, False, False, False)),
    "hexadecimal": ("0123456789abcdef", (False, False, False, False, False, False)),
    "digits": ("0123456789", (False, False, False, False, False, False)),
    "cyrillic": ("абвгдежзийклмнопрстуфхцчшщъыьэюя", (True, True, True, False, False, False)),
}


def test_noise_fails_and_its_verdicts_are_known():
    packer = zstandard.ZstdCompressor(level=3)
    for name, (letters, want) in NOISE.items():
        for size, passes in zip((300, 600, 1000, 2500, 9000, 60_000), want):
            for seed in range(3):
                text = words_of(letters, size, seed).encode()
                assert judge(text, Bands(), packer)[0] == passes, (name, size)


def prose(vocabulary, size, seed):
    """Words drawn as often as the inverse of their rank, as in prose."""
    rng = random.Random(seed)
    weights = [1 / (i + 3) for i in range(len(vocabulary))]
    out, n = [], 0
    while n < size:
        out.append(rng.choices(vocabulary, weights)[0])
        n += len(out[-1].encode()) + 1
    return " ".join(out)


def test_clean_text_of_several_scripts_passes(spark):
    packer = zstandard.ZstdCompressor(level=3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    for r in docs:
        n = word_measures(r.text.encode())
        if n[0] >= 50 and 100 * n[4] <= 50 * n[0]:
            assert judge(r.text.encode(), Bands(), packer)[0]
    rng = random.Random(9)
    syllables = {
        "cyrillic": [a + b for a in "бвгдклмнпрст" for b in "аеиоу"],
        "greek": [a + b for a in "βγδκλμνπρστ" for b in "αεηιο"],
        "han": [chr(0x4E00 + 7 * i) for i in range(700)],
        "latin": [a + b for a in "bcdfglmnprst" for b in "aeiou"],
    }
    for name, parts in syllables.items():
        vocabulary = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(3000)]
        for size in (300, 600, 1000, 2500, 9000, 60_000):
            assert judge(prose(vocabulary, size, size).encode(), Bands(), packer)[0], (name, size)


def test_scripts():
    assert script(b"plain words 12") == "plain" and script(b"a1b2c3 99") == "numeric" and script(b"") == "plain"
    assert script("слово words".encode()) == "two_byte" and script("écoute là-bas".encode()) == "plain"
    assert script("汉字 and words".encode()) == "wide"


def test_kept_rows_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.withColumns({"whole_text": docs.lang, "__text": docs.lang, "a`b.c": docs.lang})
    kept = keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == keep_good(docs).count() > 100
    assert all(r["a`b.c"] == r.whole_text == r.lang for r in kept.collect())
