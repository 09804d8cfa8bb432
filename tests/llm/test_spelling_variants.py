import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from namestrata.llm.spelling_variants import Words, gram_pairs, letter_parts, runs, variants, word_counts
from tests.conftest import SF

SCHEMA = "doc_id long, text string, word string, n int, unit long"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    count = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            count[run if h % 31 else run[:k] + run[k + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def plain_variants(rows):
    words = plain_counts(rows)
    form, out = {}, {}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def odd_rows():
    rng = random.Random(4)
    stems = ["Variante", "straßeén", "ÀÀÀÀÀÀÀ", "lettersoup", "abababab", "aaaaaaaa"]
    rows = []
    for i in range(160):
        words = []
        for _ in range(60):
            w = list(rng.choice(stems[:4] if i % 3 else stems))
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice("abstuzé×")], [w[k], rng.choice("aesè")]])
            words.append("".join(w))
        rows.append((i, rng.choice([" ", ", ", "ł", "1"]).join(words), "clash", i, 7))
    chain = ["chainword"] * 500 + ["chainxord"] * 30 + ["chainxorde"] * 2
    rows += [(1000 + i, w, None, None, None) for i, w in enumerate(chain)]
    rows += [(None, "Variante lettersoup variante", None, 1, 1), (7, None, None, 1, 1), (8, "", None, 1, 1), rows[3], rows[3]]
    rows.append((9, "x" * 50_000 + " " + "y" * 30_000 + " " + "x" * 50_000 + " " + "x" * 50_001 + " " + "x" * 50_001, "", 0, 0))
    return rows


def test_odd_rows_match_brute_force(spark):
    rows = odd_rows()
    want = plain_variants([r[:2] for r in rows])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {r.word: r.n for r in word_counts(docs).collect()} == {w: v[3] for w, v in want.items()}
    got = variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = got.collect()
    assert len(got) == len(want) and {r.word: tuple(r) for r in got} == want
    assert any(w[1] not in (None, w[2]) for w in want.values())
    # A key dealt out in tiles gives the same.
    assert sorted(map(str, variants(docs, parts=3, tile=5).collect())) == sorted(map(str, got))


def test_whole_table_by_deletion_keys(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = plain_counts([(r.doc_id, r.text) for r in docs.collect()])
    rests = {}
    for w in words:
        for i in range(len(w)):
            rests.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (_, rest), group in rests.items():
        for w in group:
            near[w] |= group - {w}
            if rest in near:
                near[w].add(rest)
                near[rest].add(w)
    assert {r.word: (r.n, r.n_near) for r in variants(docs).collect()} == {w: (n, len(near[w])) for w, n in words.items()}


@pytest.mark.parametrize("seed", range(3))
def test_gram_blocks_find_every_pair(seed):
    rng = random.Random(seed)
    group = sorted(rng.randrange([1, 3, 400][seed]) for _ in range(900))
    words = [bytes(rng.choice(b"ab\xe9") for _ in range(rng.randint(1, 6))) for _ in group]
    order = sorted(range(900), key=lambda i: (group[i], len(words[i])))
    group, words = np.array(group)[order], [words[i] for i in order]
    held = Words(words)
    found = set()
    for a, b in gram_pairs(held, group):
        good = held.one_edit(a, b)
        found |= set(zip(a[good].tolist(), b[good].tolist()))
    text = [w.decode("latin-1") for w in words]
    want = {(i, j) for i in range(900) for j in range(i + 1, 900) if group[i] == group[j] and abs(len(words[i]) - len(words[j])) < 2 and one_edit(text[i], text[j])}
    assert found == want


def test_runs_of_odd_text():
    for text in ("AbcÀÿDEF xĀy¿À", "a一b \U0001f600c", "", "éé", "A-B_c9d"):
        assert [r.decode() for r in runs(text.encode())] == [m.translate(LOWER) for m in RUN.findall(text)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert variants(empty).count() == 0
    assert letter_parts(word_counts(empty)).sum() == 0
