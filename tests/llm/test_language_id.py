import math
import random
from collections import Counter

import pytest

from namestrata.llm import language_id
from namestrata.llm.language_id import ORDER, fold, identify, keep_identified, kneser_ney, normal, predictions
from namestrata.session import cut_lineage
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, score int"


def grams(text):
    s = "".join(map(chr, normal(text).tolist()))
    return Counter(s[i : i + ORDER] for i in range(len(s) - ORDER + 1))


def test_normal_text():
    assert "".join(map(chr, normal("  Ab, 1c\n").tolist())) == "   ab c "
    assert len(normal("12 !")) == 0 and len(normal("")) == 0


def test_probabilities_sum_to_one():
    models = kneser_ney({"x": grams("the cat sat on the mat and the hat"), "y": grams("der hut und die katze")})
    alphabet = {c for t in ("the cat sat on the mat and the hat", "der hut und die katze") for c in t}
    for context in ("   ", "the", "zzz", "e k"):
        for k in range(2):
            total = 0.0
            for c in [*alphabet, "\0"]:
                points = [ord(x) for x in context + c]
                total += math.exp(models.log_likelihood(language_id.np.array(points, dtype="uint32"))[k])
            assert total == pytest.approx(1, abs=1e-5)


def test_parts_of_long_texts_add_up(monkeypatch):
    models = kneser_ney({"x": grams("abra kadabra"), "y": grams("lorem ipsum")})
    rng = random.Random(1)
    points = normal("".join(rng.choices("abr klmo", k=20000)))
    whole = models.log_likelihood(points)
    parts = sum(models._part(points[i : i + 1 + ORDER - 1]) for i in range(len(points) - ORDER + 1))
    assert whole == pytest.approx(parts)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.03 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = language_id.fit(docs.where(fold() != 1))
    rows = [(1, None, "en", 1), (2, "", None, 1), (3, "123 !", "de", 1), (None, "the and of", "en", 1)]
    rows += [(5, "Ж" * 3000, "ru", 1), (6, "the and of that " * 20000, None, 1), (6, "the and of", "en", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in predictions(docs, models).collect()]
    assert got[:4] == [(1, "und", True), (2, "und", True), (3, "und", True), (None, "en", False)]
    assert got[4][2] and got[5][1:] == ("en", False) and got[6][1:] == ("en", False)
    kept = keep_identified(docs, models)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["6", "6", "None"]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert identify(empty).count() == 0
    only = spark.createDataFrame([(1, "some text", None, 0), (2, None, "en", 0)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in identify(only).collect()} == {("und", 0.0)}


def test_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = language_id.labelled_sample(docs.select("doc_id", "text", "lang"), 40_000).collect()
    chars, largest = Counter(), Counter()
    for r in sample:
        n = len(r.text.decode())
        chars[r.lang] += n
        largest[r.lang] = max(largest[r.lang], n)
    # A language ends with the text that fills its part.
    assert len(chars) == 4 and all(chars[k] - largest[k] < 10_000 for k in chars)


def test_every_label_with_a_letter_is_learned(spark):
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 7)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    rows = [(i, text("abcdef", 60), "en", 0) for i in range(40)] + [(100 + i, text("uvwxyz", 9000), "de", 0) for i in range(8)]
    # Many labels, of few and short texts, and one whose only text may be set aside.
    rows += [(200 + i, text(chr(0x430 + i // 2) + "q", 30), f"l{i // 2:03d}", 0) for i in range(0, 300)]
    rows += [(900, "Ж", "one", 0), (901, "12 34", "none", 0), (902, None, "void", 0), (903, "words", None, 0)]
    models = language_id.fit(spark.createDataFrame(rows, SCHEMA), chars=20_000)
    assert models.languages == sorted({"en", "de", "one", *(f"l{i:03d}" for i in range(150))})
    assert len(models.blocks) == 3
    for letters, lang in (("uvwxyz", "de"), ("abcdef", "en"), (chr(0x430 + 140) + "q", "l140")):
        assert models.predict(text(letters, 50).encode())[0] == lang


def test_blocks_of_languages_change_nothing(monkeypatch):
    counts = {k: grams(t) for k, t in zip("abcde", ("the cat sat", "der hut und", "le chat noir", "el gato y", "ok"))}
    whole = kneser_ney(counts)
    monkeypatch.setattr(language_id, "TABLE_LANGUAGES", 2)
    parts = kneser_ney(counts)
    assert len(whole.blocks) == 1 and len(parts.blocks) == 3
    points = normal("the hut noir gato zzz ok")
    assert parts.log_likelihood(points) == pytest.approx(whole.log_likelihood(points))


def plain_kneser_ney(counts, alphabet, context, c):
    """Interpolated Kneser-Ney by its definition, over Counters of runs of ORDER characters."""

    def level(n):
        if n == ORDER:
            return counts
        longer = level(n + 1)
        return Counter(g[1:] for g in longer)

    def p(n, context):
        if n == 0:
            return 1 / alphabet
        grams = level(n)
        seen = Counter(grams.values())
        d = min(max(seen[1] / (seen[1] + 2 * seen[2]) if seen[1] else 0.5, 0.1), 0.9)
        after = {g[-1]: v for g, v in grams.items() if g[:-1] == context}
        if not after:
            return p(n - 1, context[1:])
        total = sum(after.values())
        return max(after.get(c, 0) - d, 0) / total + d * len(after) / total * p(n - 1, context[1:])

    return p(ORDER, context)


def test_probabilities_match_the_definition():
    texts = {"x": "the cat sat on the mat and the hat sat", "y": "der hut und die katze und der hund"}
    counts = {k: grams(t) for k, t in texts.items()}
    models = kneser_ney(counts)
    alphabet = len({c for g in counts.values() for k in g for c in k}) + 1
    for text in ("the hat", "und der hat", "qqq", "cat und"):
        points = normal(text)
        s = "".join(map(chr, points.tolist()))
        want = [sum(math.log(plain_kneser_ney(counts[k], alphabet, s[i : i + ORDER - 1], s[i + ORDER - 1])) for i in range(len(s) - ORDER + 1)) for k in "xy"]
        assert models.log_likelihood(points) == pytest.approx(want, rel=1e-5)


def test_kept_rows_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = language_id.fit(docs)
    odd = docs.limit(40).withColumns({"whole_text": docs.lang, "__text": docs.lang, "a`b.c": docs.lang})
    kept = keep_identified(odd, models)
    assert kept.columns == odd.columns and kept.count() > 20
    assert all(r["a`b.c"] == r.whole_text == r.lang for r in kept.collect())


def test_sample_starts_no_other_python_on_executors(spark):
    """Rows of a Python list come through an RDD of Python, which has a daemon and workers of its own."""
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("one two", "en"), ("eins zwei", "de")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    sample = language_id.labelled_sample(cut_lineage(docs, "labelled"), 1000)
    plan = sample._jdf.queryExecution().optimizedPlan().toString()
    assert "RDD" not in plan and sample.count() == 10
