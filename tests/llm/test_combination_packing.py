import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from namestrata.llm.combination_packing import WASTE, combinations, make_plan, pack, repeat_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start int, length string"


def check(rows, docs, window):
    """Every id in exactly one piece, every sequence gapless and within the window."""
    library = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for doc, text, *_ in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[doc, ids.tobytes()] += 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    left = dict(want)
    for (doc, raw), copies in want.items():
        ids = np.frombuffer(raw, dtype="<u4")
        own = [r for r in by_doc[doc] if r.doc_tokens == len(ids)]
        assert sum(r.length for r in own) % len(ids) == 0
        for r in own:
            assert 0 < r.length <= window
        good = [r for r in own if zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert sum(r.length for r in good) >= copies * len(ids)
    assert sum(r.length for r in rows) == sum(n * len(raw) // 4 for (_, raw), n in left.items())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        short += window - at > WASTE
    assert short <= 1 and sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("window", [64, 2048])
def test_round_trip(spark, window):
    rng = random.Random(3)
    words = ["tion", "the", "a", "wh", "<|endoftext|>", "é", "'s", "\n", "  "]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 400))), 1, "x") for i in range(120)]
    docs += [(500 + i, "same text here", 1, "x") for i in range(90)]
    docs += [(900, None, 1, "x"), (901, "", 1, "x"), (902, "long " * 30000, None, None), (903, "z" * 5000, 1, "x")]
    docs += [docs[7], docs[7], (None, "no id", 1, "x"), (7, "other text", 1, "x")]
    rows = pack(spark.createDataFrame(docs, SCHEMA).repartition(5), PATH, public_tokenizers.PATTERN, window=window).collect()
    check(rows, docs, window)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN).count() == 0


def test_solver_meets_a_histogram_it_can_meet():
    rng = np.random.default_rng(1)
    combos = combinations(np.arange(1, 65), 64)
    x = rng.integers(0, 40, len(combos))
    histogram = np.zeros(65)
    for c, n in zip(combos, x):
        for k in c:
            histogram[k] += n
    got = repeat_counts(combos, histogram, rounds=3000)
    used = np.zeros(65)
    for c, n in zip(combos, got):
        for k in c:
            used[k] += n
    assert (got >= 0).all() and abs(used - histogram).max() < 0.02 * histogram.max()


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything_once(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(257, dtype=np.int64)
    histogram[1:] = rng.poisson(rng.choice([0.3, 5, 200]), 256)
    histogram[rng.integers(1, 257)] = 3000
    plan = make_plan(histogram, 256)
    length = np.repeat(np.arange(257), histogram)
    number = np.concatenate([np.arange(n) for n in histogram])
    sequence, offset = plan.place(length, number)
    used = np.zeros(plan.sequences * 256 + 512, dtype=np.int64)
    for s, o, n in zip(sequence, offset, length):
        used[s * 256 + o : s * 256 + o + n] += 1
    assert used.max() == 1 and used.sum() == length.sum()
    assert plan.sequences * 256 - length.sum() <= WASTE * plan.sequences + 256
