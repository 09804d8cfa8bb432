import random

import public_tokenizers
from tokenizers import Tokenizer

from namestrata.llm.prefix_counts import PrefixCounter, count_tokens, truncate
from tests.llm.test_rank_codec import PARTS, odd_texts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, n_bytes string"


def tokens(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_counts_as_the_library_does():
    counter, library = PrefixCounter(PATH, PATTERN), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    parts = [*PARTS, "they're", " 'll", "<|endof", "the", " ing", " transformation", "ation"]
    for _ in range(1200):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        prefixes = counter.prefixes(text)
        assert prefixes.tolist() == [tokens(library, text[:i]) for i in range(len(text) + 1)], repr(text)
        assert counter.count(text) == prefixes[-1]
        budget = rng.randint(0, 6)
        assert counter.fitting(text, budget) == max(i for i, n in enumerate(prefixes) if n <= budget)


def test_whole_texts(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t, "clash") for i, t in enumerate(odd_texts(300, 5))]
    rows += [(i, r.text, "x") for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())]
    rows += [(900, None, "x"), (901, "", None), rows[2], rows[2], (None, "no id", "x"), (902, "word " * 50_000, "x"), (903, "y" * 20_000, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = []
    for doc, text, _ in rows:
        n = tokens(library, text or "")
        want.append((str(doc), len((text or "").encode()), n, n > 1024))
    got = count_tokens(docs, PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(want)
    assert count_tokens(docs.limit(0), PATH, PATTERN).count() == 0


def test_truncation(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t, "x") for i, t in enumerate([*odd_texts(40, 6), None, "", "a longer text of several words " * 9])]
    for r in truncate(spark.createDataFrame(rows, SCHEMA), PATH, PATTERN, 7).collect():
        text = rows[r.doc_id][1] or ""
        longest = max(i for i in range(len(text) + 1) if tokens(library, text[:i]) <= 7)
        assert r.text == text[:longest] and r.n_tokens == tokens(library, r.text)
