import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from namestrata.llm import near_copies, substring_dedup
from namestrata.llm.batches import PIECE_BYTES, map_slices, slices
from namestrata.llm.fm_index import NONE, FMIndex
from namestrata.llm.substring_dedup import answer_shard, repeated_passages

SCHEMA = "doc_id long, text string, check string, words int"


def brute(rows, width=13):
    """{(doc_id, text): (words, removed, kept)} by a dictionary of all windows."""
    least = {}
    for doc, text, *_ in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - width + 1):
            if doc is not None:
                w = tuple(words[i : i + width])
                least[w] = min(least.get(w, doc), doc)
    out = []
    for doc, text, *_ in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if doc is not None and least[tuple(words[i : i + width])] < doc:
                gone[i : i + width] = [True] * width
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((str(doc), len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "the", "of"] + [f"w{i}" for i in range(300)]
    passages = [" ".join(rng.choices(vocab, k=rng.randint(13, 90))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(vocab, k=rng.randint(1, 60))))
        rows.append((i * 7 % 151 - 20, "\n".join(parts), "clash", i))
    rows += [rows[3], rows[3], (rows[4][0], rows[9][1], "x", 1), (None, rows[5][1], None, None)]
    rows += [(1000 + i, t, "x", 0) for i, t in enumerate([None, "", " \n ", "x " * 3000, "x " * 40, "a b " * 500, "b a " * 90])]
    rows += [(2000 + i, passages[0] + " " + str(i) + " " + passages[0], "x", 0) for i in range(40)]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    out = repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out) == brute(rows)
    assert all(sum(x.n for x in r.ranges) == r.n_removed for r in out)
    assert sum(r.n_removed > 0 for r in out) > 50


def test_small_indexes_and_runs_give_the_same():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        words = rng.integers(0, 3, rng.integers(13, 40))
        rows.append((0, i, i, 100, b" ".join(b"%d" % w for w in words)))
    whole = answer_shard(rows, 13)
    assert whole == answer_shard(rows, 13, per_index=50)
    assert any(o < r[2] for r, a in zip(rows, whole) for o in a[2])


@pytest.mark.parametrize("width", [1, 2, 5, 8, 13])
def test_index_finds_smallest_owner(width):
    rng = np.random.default_rng(width)
    lengths = rng.integers(1, 60, 40)
    words = rng.integers(1, 5, lengths.sum())
    owners = rng.permutation(40) * 3
    index = FMIndex(words, lengths, owners, 7, width)
    q_lengths = rng.integers(1, 50, 30)
    queries = rng.integers(0, 7, q_lengths.sum())
    got = index.least_owners(queries, q_lengths)
    least = {}
    for s, n, o in zip(np.cumsum(lengths) - lengths, lengths, owners):
        for i in range(s, s + n - width + 1):
            k = tuple(words[i : i + width])
            least[k] = min(least.get(k, o), o)
    for s, n in zip(np.cumsum(q_lengths) - q_lengths, q_lengths):
        for i in range(s, s + n):
            want = least.get(tuple(queries[i : i + width]), NONE) if i <= s + n - width else NONE
            assert got[i] == want


def test_runs_depend_on_content_only():
    rolling = substring_dedup.Rolling()
    rng = np.random.default_rng(0)
    inner = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    texts = [np.concatenate([rng.integers(0, 1 << 62, k).astype(np.uint64), inner]) for k in (0, 5, 31)]
    counts = np.array([len(t) for t in texts])
    number, at, windows, key, content = substring_dedup.runs_of(counts, np.concatenate(texts), rolling, 13)
    assert windows.sum() == sum(counts - 12)
    tails = [{(k, c) for n, k, c in zip(number, key, content) if n == t} for t in range(3)]
    assert len(tails[0] & tails[1] & tails[2]) >= len(tails[0]) - 2


def test_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_passage_of_many_documents_is_no_group_of_one_shard(spark, monkeypatch):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(20))
    fresh = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(14))
    rows = [(i, f"{fresh()} {passage} {fresh()}", "x", 0) for i in range(300)]
    rows += [(300 + i, rows[i][1] if i % 2 else rows[i][1].replace("p19 ", "p19 q "), "x", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)
    monkeypatch.setattr(substring_dedup, "PROBE_SHARE", 1, raising=False)
    base, width = substring_dedup.base_of(docs), 13
    runs = substring_dedup.run_words(base, substring_dedup.shared_runs(base, width), width).collect()
    words = {}
    for r in runs:
        words[r.key] = words.get(r.key, 0) + len(bytes(r.words).split())
    # Before, a boundary minimizer of the passage held a run of each of the 300 documents.
    assert max(words.values()) <= 500
    out = repeated_passages(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out) == brute(rows)


def test_pieces_of_text_are_small(spark, monkeypatch):
    """Tasks that hold texts as words and arrays take a megabyte at once, whatever the batch."""
    texts = pa.RecordBatch.from_pydict({"text": [b"x" * 3000] * 1000 + [b"y" * (5 << 20), None, b""]})
    pieces = list(slices(texts, "text", PIECE_BYTES))
    assert sum(p.num_rows for p in pieces) == texts.num_rows
    assert all(p.num_rows == 1 or sum(len(t or b"") for t in p.column(0).to_pylist()[:-1]) < PIECE_BYTES for p in pieces)
    bounds = []

    def watched(df, start, schema, weight=None, most=None):
        bounds.append(most)
        return map_slices(df, start, schema, weight, most)

    monkeypatch.setattr(substring_dedup, "map_slices", watched)
    monkeypatch.setattr(near_copies, "map_slices", watched)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 3, 40))) for i in range(9)], "doc_id long, text string")
    substring_dedup.drop_repeated_passages(near_copies.drop_near_copies(docs)).collect()
    assert len(bounds) >= 4 and set(bounds) == {PIECE_BYTES}
