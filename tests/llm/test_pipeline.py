import os
import re

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomwork.llm.queries import PIECES, QUERIES, SQL
from tests.llm.test_decontam import brute as hits
from tests.llm.test_minhash import brute as groups

TEXT = "the old river runs past seven quiet mills and turns north under a wooden bridge where boats"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, f"{TEXT} number {i} " + " ".join(f"w{i}_{k}" for k in range(60)), "en", "s", 0) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " extra", "en", "s", 0) for i in range(5)]
    docs += [(200 + i, " ".join(f"z{i}_{k}" for k in range(30)) + " slur insult slur", "en", "s", 0) for i in range(40)]
    docs += [(300, "clean start " + " ".join(f"bench{k}" for k in range(12)), "en", "s", 0), (301, "key token='abcdefghijklmnop' done", "en", "s", 0), (302, None, "en", "s", 0), (303, "", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 300)) for i in [*range(60), *range(200, 240)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.skipif(not os.path.exists(PIECES), reason="no vocabulary file")
def test_decisions_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        rows = out.collect()
        after = {r.doc_id: r.text for r in rows}
        if name == "toxicity":
            assert not any(200 <= i < 300 for i in after) and set(before) - set(after) <= set(range(200, 240))
        elif name.startswith("minhash"):
            want = groups(before.items(), 5)
            assert set(after) == {i for i, (_, c) in want.items() if c == i} and 100 not in after
        elif name.startswith("benchmark"):
            found = hits(list(before.items()), [(1, " ".join(f"bench{k}" for k in range(12)))], 10)
            assert set(after) == {i for i, (_, n, _) in found.items() if not n} and 300 not in after
        else:
            assert set(after) == set(before) and after[301] == "key [SECRET]' done"
            assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        before, docs = after, spark.createDataFrame(rows, docs.schema)
    assert {r.doc_id for r in cp.run(spark, folder).collect()} == set(before)


def test_registered():
    numbered = [n for n in QUERIES if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in numbered) == list(range(1, 11))
    assert set(QUERIES) - set(numbered) <= set(SQL)
    assert 4 <= len(cp.STAGES) <= 5


def test_stages_keep_the_values_of_all_columns(spark, folder):
    """Columns named as whatever the stages add or work with."""
    names = (
        "score predicted spans n_words n_hit items longest_words longest_at longest_item _key _row _id row id node lead n kept _rules _cut _all _spans _s0 _m__s0 _z__s0 _c__s0"
        " _salt _whole order label features epoch sketch bucket path slice doc canonical Score SPANS_ text_a member g a b"
    ).split()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names if n != "Score"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names if n != "Score"), name
        before = {r.doc_id: r for r in wide.collect()}
        assert all(r.lang == before[r.doc_id].lang and r.source == before[r.doc_id].source for r in rows)
    last = cp.STAGES[-1][1](spark, wide, folder)
    assert last.count() == docs.count() and {f"{n}:{r.doc_id}" == r[n] for r in last.collect() for n in ("score", "_key", "spans")} == {True}


def test_near_dedup_verifies_a_cluster_once(spark, monkeypatch):
    """88 like texts, of which the least id stays, and 12 that are under 0.8 to all of them: no quota after quota."""
    import random

    from loomwork.llm import minhash

    calls, true_verify = [], minhash._verify
    monkeypatch.setattr(minhash, "_verify", lambda *args: calls.append(1) or true_verify(*args))
    monkeypatch.setattr(minhash, "QUOTA", 1)
    r, rows = random.Random(3), []
    for i in range(100):
        t = [f"b{k}" for k in range(200)]
        for k in r.sample(range(1, 40), 6 if i >= 88 else 1):
            t[5 * k] = f"x{i}_{k}"
        rows.append((i, " ".join(t)))
    left = cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(x.doc_id for x in left) == [0, *range(88, 100)]
    assert len(calls) == 2
