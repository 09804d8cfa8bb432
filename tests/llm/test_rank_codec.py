import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from namestrata.llm.rank_codec import RankCodec, decode, encode, file_codec, file_ranks, load_ranks
from namestrata.llm.words import safe_pieces

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string, n_tokens int"
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "!", "1", "é", "\x1c", "\xa0", "don't", "　", "🙂", "\r\n", " \n", "<|endoftext|>", " 漢字"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)]


def library():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def test_same_ids_as_the_library():
    codec, plain = RankCodec(load_ranks(PATH), PATTERN), library()
    for text in [*odd_texts(5000), " " * 3000 + "x", "x" + "\n" * 2500 + " y", " " * 2000, "\n" * 1500 + "!", "a" * 100_000]:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_cuts_change_nothing():
    plain = library()
    for text in odd_texts(3000, 2):
        for size in (1, 4):
            assert [i for p in safe_pieces(text, size) for i in plain.encode_ordinary(p)] == plain.encode_ordinary(text)


def test_file_of_the_other_library_gives_its_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    codec, other = RankCodec(pattern=PATTERN, **file_ranks(path)), Tokenizer.from_file(path)
    for text in odd_texts(3000, 3):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_runs_longer_than_the_library_takes():
    text = "x" + " " * 1_500_000 + "y"
    codec = RankCodec(load_ranks(PATH), PATTERN)
    assert codec.decode(codec.encode(text)).decode() == text


def test_query_columns(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(odd_texts(200, 4))]
    rows += [(500, None, None, 1), (501, "", "x", 1), rows[3], rows[3], (None, "no id", "x", 1), (502, "long text " * 40_000, "x", 1)]
    out = encode(spark.createDataFrame(rows, SCHEMA), PATH, PATTERN, with_ids=True)
    plain = library()
    want = []
    for doc, text, *_ in rows:
        raw = np.array(plain.encode_ordinary(text or ""), dtype="<u4").tobytes()
        want.append((str(doc), len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == sorted(want)
    back = {(str(r.doc_id), bytes(r.bytes)) for r in decode(out, PATH, PATTERN).collect()}
    assert back == {(str(r[0]), (r[1] or "").encode()) for r in rows}
    assert encode(spark.createDataFrame([], SCHEMA), PATH, PATTERN).count() == 0


def test_few_remembered_words_give_the_same_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    many, few = file_codec(path, PATTERN), file_codec(path, PATTERN, 3)
    texts = ["a b c d e f  g\n h", "a b", "", "f e d c b a " * 50]
    assert [few.encode(t) for t in texts] == [many.encode(t) for t in texts]
    assert len(few.memo.known) == 3 < len(many.memo.known)
    assert corpus_pipeline.PACKING_WORDS <= 100_000
