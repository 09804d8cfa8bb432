import math
import zlib

import numpy as np

from namestrata.llm import quadratic_quality as q
from tests.conftest import SF

DOCS = "doc_id long, text string, label int, x string, score double"
LABELS = "doc_id long, quality int, text string"


def fold(doc, n=5):
    return zlib.crc32(str(doc).encode()) % n


def plain_model(rows, pooled, rounded):
    """Means, covariances and prior by the textbook, from (label, x)."""
    y, x = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    scale = np.sqrt(np.maximum(x.var(axis=0), 1e-6))
    z = (x - x.mean(axis=0)) / scale
    within = sum(np.cov(z[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / len(y)
    parts = []
    for k in (0, 1):
        cov = (1 - pooled) * np.cov(z[y == k].T, bias=True) + pooled * within
        cov = (1 - rounded) * cov + rounded * np.eye(len(scale))
        parts.append((z[y == k].mean(axis=0), cov))

    def difference(v):
        v = (v - x.mean(axis=0)) / scale
        logs = [-0.5 * ((v - m) @ np.linalg.solve(c, v - m) + np.linalg.slogdet(c)[1]) for m, c in parts]
        return logs[1] - logs[0] + math.log((y == 1).sum() / (y == 0).sum())

    return difference


def test_scores_match_a_plain_model_and_hold_out_well(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.doc_id, q.statistics(r.text.encode())) for r in docs.collect()]
    learn = [(marks[d], x) for d, x in rows if d in marks and fold(d)]
    model = q.fit(q.learning_rows(q.described(docs), labels))
    sums = q.class_sums(q.learning_rows(q.described(docs), labels))
    assert sums[:, :, 0].sum() == len(learn)
    for pooled, rounded in ((0.1, 0.03), (0.7, 0.2)):
        plain = plain_model(learn, pooled, rounded)
        mine = q.Discriminant.of(sums.sum(axis=0), pooled, rounded).difference(np.array([x for _, x in rows[:60]]))
        assert np.allclose(mine, [plain(np.array(x)) for _, x in rows[:60]], rtol=1e-4, atol=1e-4)
    got = {r.doc_id: r for r in q.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    for d, x in rows[:200]:
        r = got[d]
        assert r.held_out == (fold(d) == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1
        assert abs(r.score - model.score(np.array([x]))[0]) < 1e-9
    held = [(got[d].score, m) for d, m in marks.items() if d in got and fold(d) == 0]
    good, bad = [s for s, m in held if m], [s for s, m in held if not m]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.3) == m for s, m in held]) > 0.9


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()
    flipped = [(r.doc_id, 1 - r.quality if fold(r.doc_id) == 0 else r.quality) for r in labels]
    a, b = (spark.createDataFrame([tuple(r) for r in x], "doc_id long, quality int") for x in (labels, flipped))
    near = lambda t: sorted((r.doc_id, round(r.score, 9)) for r in q.classify(docs, t).collect())
    assert near(a) == near(b)


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    labels = [(r.doc_id, r.quality, "clash") for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    rows = [(r.doc_id, r.text, 1, "x", 0.5) for r in docs]
    odd = [(9001, None, 0, "", None), (9002, "", None, None, None), (9003, " \n\t", 0, "", 0.0), (9004, "long text " * 100_000, 0, "", 0.0), (None, rows[0][1], 0, "", 0.0)]
    rows += odd + [rows[5], rows[5]]
    labels += [(None, 1, ""), (9001, None, ""), (9002, 7, ""), labels[0], (labels[0][0], 1 - labels[0][1], "")]
    out = q.classify(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    assert by_id[9001].score == by_id[9002].score and not by_id[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id == rows[5][0]}) == 1


def test_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "some words here", 0, "", 0.0) for i in range(9)], DOCS)
    labels = spark.createDataFrame([(i, 1, "") for i in range(9)], LABELS)
    one = {r.score for r in q.classify(docs, labels).collect()}
    assert len(one) == 1 and one.pop() > 0.5
    assert {r.score for r in q.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert q.classify(docs.limit(0), labels).count() == 0


def test_statistics_are_finite():
    for text in (None, b"", b" ", b"a", b"\n\n", b"#" * 1000, "中".encode() * 50, b"A!! B!! | c"):
        values = q.statistics(text)
        assert len(values) == len(q.NAMES) and np.isfinite(values).all()
