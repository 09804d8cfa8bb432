"""The stages against plain versions, one after the other, and cases planted on purpose."""

import random

import corpus_pipeline
from namestrata.llm.compression_bands import Bands, judge, word_measures
from namestrata.llm.near_copies import shingles, words_of
from namestrata.llm.substring_dedup import drop_repeated_passages, without
from tests.conftest import SF
from tests.llm.test_combination_packing import check


def plain_repeats(rows, width=13):
    """{doc_id: words left} by a dictionary of windows."""
    least = {}
    for doc, text in rows:
        w = text.encode().split()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            least[key] = min(least.get(key, doc), doc)
    out = {}
    for doc, text in rows:
        w = text.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < doc:
                gone[i : i + width] = [True] * width
        if not w or not all(gone):
            out[doc] = [x for x, g in zip(w, gone) if not g]
    return out


def test_stages_match_plain_versions(spark):
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    packer, bands = zstandard.ZstdCompressor(level=3), Bands()
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, SF).cache()
    want = set()
    for r in docs.collect():
        b = r.text.encode()
        n = word_measures(b)
        if n[0] >= 50 and 100 * n[4] <= 50 * n[0] and judge(b, bands, packer)[0]:
            want.add(tuple(r))
    assert {tuple(r) for r in good.collect()} == want and 100 < len(want) < 200

    spoken = stages["language"](spark, good, SF).cache()
    assert {tuple(r) for r in spoken.collect()} <= want and spoken.count() > 0.97 * len(want)

    single = stages["near_duplicates"](spark, spoken, SF).cache()
    rows = sorted(spoken.collect())
    sets = [set(shingles(words_of(r.text.encode()), 5).tolist()) for r in rows]
    close = {(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    root = list(range(len(rows)))
    for i, j in sorted(close):
        root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    got = sorted(single.collect())
    # Every text left is one of a group of copies; of the groups, nine in ten at least are down to one.
    left = [i for i, r in enumerate(rows) if r in got]
    assert len(left) == len(got) and {root[i] for i in left} == set(root)
    assert set(left) >= {i for i in range(len(rows)) if root.count(root[i]) == 1}
    copied = [i for i in range(len(rows)) if root[i] != i]
    assert len(copied) > 5 and sum(i not in left for i in copied) >= 0.9 * len(copied)

    clean = stages["repeats"](spark, single, SF).cache()
    left = plain_repeats([(r.doc_id, r.text) for r in single.collect()])
    got = clean.collect()
    assert {r.doc_id: r.text.encode().split() for r in got} == left and len(got) == len(left)
    before = {r.doc_id: r for r in single.collect()}
    for r in got:
        assert r.n_chars == len(r.text)
        assert r.text == before[r.doc_id].text or len(r.text) < len(before[r.doc_id].text)

    packed = stages["packing"](spark, clean, SF)
    check(packed.collect(), [(r.doc_id, r.text) for r in got], 2048)
    assert all(x.columns == columns for x in (good, spoken, single, clean))


def test_run_over_planted_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rng = random.Random(1)
    words = " ".join(r.text for r in docs.collect()).split()
    fresh = lambda n: " ".join(rng.choice(words) for _ in range(n))
    kind = docs.schema.add("text_", "string")
    base, passage = fresh(200), fresh(60)
    planted = [(9000, base), (9001, base), (9002, base + " Tail"), (9003, fresh(150) + "\n" + passage), (9004, passage + "\n" + fresh(150))]
    planted += [(9005, None), (9006, ""), (9007, "word " * 500), (9008, "123 456 " * 10), (9009, fresh(300))]
    rows = [(*r, "x") for r in docs.collect()] + [(d, t, "en", "s", len(t or ""), "x") for d, t in planted]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert {9000, 9003, 9004, 9009} <= ids and not ids & {9001, 9005, 9006, 9007, 9008}
    total = {r.doc_id: r.doc_tokens for r in out}
    assert total[9004] < 0.9 * total[9003]


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_cutting_keeps_the_rest_as_it_was():
    import numpy as np

    text = b"  one two\n three\tfour  five "
    assert without(text, np.array([False, True, True, False, False])) == b"  one four  five "
    assert without(text, np.array([True, False, False, False, True])) == b"  two\n three\tfour  "


def test_repeats_with_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(2, "a " + passage, None, "x"), (1, passage + " b", None, "x"), (None, passage, 5, None), (3, None, 1, "x")]
    rows += [(4, passage, 1, "x"), (5, "", 1, "x"), (1, passage + " b", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, doc string")
    got = sorted(map(str, drop_repeated_passages(docs).collect()))
    want = [rows[1], rows[6], (2, "a ", 2, "x"), rows[2], rows[3], rows[5]]
    assert got == sorted(map(str, spark.createDataFrame(want, docs.schema).collect()))


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = {"__text": docs.lang, "own_text": docs.lang, "cuts": docs.lang, "__id": docs.doc_id, "a`b.c": docs.lang}
    odd = docs.limit(120).withColumns(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        rows = out.collect()
        assert out.columns == odd.columns and len(rows) > 50, name
        assert all(r["a`b.c"] == r["__text"] == r["own_text"] == r["cuts"] == r.lang for r in rows)
