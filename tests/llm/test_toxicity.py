import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomwork.llm import toxicity as tx


def corpus(n=600):
    r = random.Random(5)
    words = [f"v{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(5, 60))]
        bad = r.random() < 0.25
        if bad:
            t.insert(r.randrange(len(t)), r.choice(["slur", "insult", "curse"]))
            t.insert(r.randrange(len(t)), r.choice(["slur", "insult", "curse"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 != 1], "doc_id long, toxic int")
    w = tx.fit_toxicity(docs, train)
    got = {r.doc_id: r for r in tx.score_toxicity(docs, w).collect()}
    test = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == y for i, y in test) / len(test) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert 0 < (w[:-1] != 0).sum() < 50_000


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (7, None), (None, 1), (9, 0), (99, 1)], "doc_id long, toxic int")
    w = tx.fit_toxicity(odd, labels)
    rows = tx.score_toxicity(odd, w).collect()
    assert len(rows) == 12 and all(r.score is not None for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert tx.score_toxicity(odd, w).columns == [*(c for c in odd.columns if c != "score"), "score", "predicted"]
    assert tx.score_toxicity(none, w).count() == 0
    empty = tx.fit_toxicity(odd, labels.limit(0))
    assert {(r.score, r.predicted) for r in tx.score_toxicity(odd, empty).collect()} == {(0.0, 0)}


def ftrl(rows, c):
    """The update rule over named features, one coordinate at a time."""
    z, n = {}, {}

    def weight(k):
        l1 = 0.0 if k == "bias" else c.l1
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[k]) - z[k]) / ((c.beta + math.sqrt(n[k])) / c.alpha + c.l2)

    def names(text):
        w = re.findall(r"[a-z0-9]+", text.lower())
        return {"bias", *w, *(("stem", x[:5]) for x in w), *zip(w, w[1:]), *(("gap", a, b) for a, b in zip(w, w[2:]))}

    def score(text):
        return 1 / (1 + math.exp(-sum(map(weight, names(text)))))

    for _ in range(c.epochs):
        for text, y in rows:
            g, keys = score(text) - y, names(text)
            for k, w in [(k, weight(k)) for k in keys]:
                old = n.get(k, 0.0)
                n[k] = old + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(old)) / c.alpha * w
    return score


@pytest.mark.parametrize("epochs", [1, 3])
def test_equals_brute_force(spark, epochs):
    rows, labels = corpus(40)
    c = tx.ToxicityConfig(epochs=epochs, l1=0.2, bits=24)  # so few features hardly collide
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = [r.doc_id for r in docs.select("doc_id", F.xxhash64("doc_id").alias("o")).orderBy("o").collect()]
    text, label = dict(rows), dict(labels)
    want = ftrl([(text[i], label[i]) for i in order], c)
    w = tx.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), c)
    for r in tx.score_toxicity(docs, w, c).collect():
        assert r.score == pytest.approx(want(r.text), abs=1e-5)
    c = tx.ToxicityConfig(epochs=epochs, l1=0.2, bits=24, max_train_rows=25)
    few = tx.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), c)
    want = ftrl([(text[i], label[i]) for i in order[:25]], c)
    assert {r.doc_id: round(r.score, 4) for r in tx.score_toxicity(docs, few, c).collect()} == pytest.approx({i: want(t) for i, t in rows}, abs=1e-4)


def test_rejecting_keeps_columns_and_values(spark):
    rows = [(i, "slur insult" if i % 2 else "fine words", f"s{i}", i * 10, None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, Predicted long, `order` string")
    w = tx.fit_toxicity(docs.select("doc_id", "text"), spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int"), tx.ToxicityConfig(l1=0.1))
    assert {tuple(r) for r in tx.reject_toxic(docs, w).collect()} == {r for r in rows if r[0] % 2 == 0}
