import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import lm


def tokens(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() + ["\0end"]


def brute(rows, train, order):
    counts = [None] + [Counter() for _ in range(order)]
    for i, t in rows:
        if train(i):
            s = ["\0start", *tokens(t)]
            counts[1].update(s[1:])
            for n in range(2, order + 1):
                counts[n].update(tuple(s[j : j + n]) for j in range(len(s) - n + 1))
    total, words, texts = sum(counts[1].values()), len(counts[1]), sum(train(i) for i, _ in rows)
    out = {}
    for i, t in rows:
        s, base, score, known = ["\0start", *tokens(t)], 0.0, 0.0, 0
        for j in range(1, len(s)):
            p = (counts[1][s[j]] + 0.1) / (total + 0.1 * (words + 1))
            base += math.log10(p)
            known += counts[1][s[j]] > 0
            for n in range(2, min(order, j + 1) + 1):
                g = tuple(s[j - n + 1 : j + 1])
                h = (texts if g[0] == "\0start" else counts[1][g[0]]) if n == 2 else counts[n - 1][g[:-1]]
                p = (counts[n][g] + lm.PRIOR * p) / (h + lm.PRIOR)
            score += math.log10(p)
        out[i] = (len(s) - 1, known, total, base, score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_brute_force(spark, order):
    rows = [(i, " ".join(["The", "cat", "sat", "on", "a", "mat."][(i * k) % 6] for k in range(i % 13))) for i in range(80)] + [(900, "Ünseen words, 日本")]
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    col = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    found = lm.score_texts(docs, col, order=order, block_bytes=300, bucket_bytes=200).collect()
    want = brute(rows, train, order)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out != train(r.doc_id)
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score == pytest.approx(want[r.doc_id][4])


def block(texts, order, train=None):
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    g = lm.Grams(np.frombuffer(b"".join(texts), np.uint8), off, order)
    learn = np.isin(g.doc, train if train is not None else np.arange(len(texts)))
    counts = {}
    for n, k in g.keys.items():
        at = g.at[n][learn]
        counts[n] = np.bincount(at[at >= 0], minlength=len(k)).astype(float)
    return g, counts, lm.Automaton(g, counts, int(counts[1].sum()), int((counts[1] > 0).sum()))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_arcs_and_failures_of_every_state_sum_to_one(order):
    g, counts, a = block([b"a b a b c", b"a c a b d", b"b a", b"", b"e f zz a b"], order, [0, 1, 2, 3])
    p = 10**a.arc_weight
    word = np.concatenate([g.at[1][a._token(n)[counts[n] > 0 if n > 1 else slice(None)]] for n in g.keys])
    root = {w: p[i] for i, w in enumerate(word) if a.arc_source[i] == 0}
    known = counts[1] > 0
    assert sum(x for w, x in root.items() if known[w]) + a.unknown == pytest.approx(1)
    assert all(x == pytest.approx(a.unknown) for w, x in root.items() if not known[w])

    def prob(s, w):
        i = np.flatnonzero((a.arc_source == s) & (word == w))
        return p[i[0]] if len(i) else 10 ** a.fail_weight[s] * prob(a.fail_state[s], w)

    for s in range(1, len(a.level)):
        if a.total[s]:
            every = sum(prob(s, w) for w in np.flatnonzero(known))
            assert every + prob(s, np.flatnonzero(~known)[0]) == pytest.approx(1), s
            assert a.level[a.fail_state[s]] == a.level[s] - 1


def test_stretches_walk_like_whole_texts():
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.choice([0, 3, 50, 400]))).encode() for _ in range(30)]
    for order in (1, 2, 3, 4):
        g, _, a = block(texts, order, range(20))
        whole = a.traverse(10**6)
        for stretch in (1, 2, 7, 50):
            assert np.allclose(whole, a.traverse(stretch))


def test_odd_rows(odd, none):
    rows = lm.score_texts(odd, F.lit(True)).collect()
    assert len(rows) == 12 and all(r.score <= 0 and r.base_score <= 0 and not r.held_out for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    untrained = lm.score_texts(odd, F.lit(None).cast("boolean")).collect()
    assert {(r.score, r.n_known, r.train_tokens) for r in untrained} == {(0.0, 0, 0)}
    assert lm.score_texts(none, F.lit(True)).count() == 0


def test_equal_blocks(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id long, text string").coalesce(1)
    rows = lm.score_texts(docs.union(docs), F.lit(True)).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2, 2] and {r.train_tokens for r in rows} == {14}


def test_clashing_names(odd):
    named = odd.withColumn("id", F.lit(5)).withColumn("train", F.lit("x")).withColumn("held_out", F.lit("x")).withColumn("block", F.lit("x"))
    assert lm.score_texts(named, F.col("train") == "x").count() == 12


def test_other_file_systems_are_named_at_once(odd, monkeypatch):
    monkeypatch.setattr("loomwork.llm._store.shared_dir", lambda spark: "dbfs:///x")
    with pytest.raises(ValueError, match="dbfs"):
        lm.score_texts(odd, F.lit(True))
