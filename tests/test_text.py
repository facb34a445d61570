import math

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as tx


def test_cleaning_and_tokens(spark):
    df = spark.createDataFrame([("a\nBig\tDog!",), ("",), ("?!.",), ("é",), (None,)], "t string")
    out = [tuple(r) for r in df.select(tx.clean_text(F.col("t")), tx.tokens(tx.clean_text(F.col("t"))), tx.clean_text(F.col("t"), False)).collect()]
    assert out == [("a Big Dog", ["big", "dog"], "a Big Dog!"), ("emptydoc", ["emptydoc"], "emptydoc"), ("emptydoc", ["emptydoc"], "?!."), ("emptydoc", ["emptydoc"], "é"), (None, None, None)]


def test_ngrams(spark):
    row = spark.range(1).select(tx.ngrams(F.array(*map(F.lit, "abcd")), 1, 3).alias("g"), tx.ngrams(F.array(F.lit("x")), 2, 2).alias("e")).first()
    assert row.g == ["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d"] and row.e == []


def test_class_tfidf_by_hand(spark):
    df = spark.createDataFrame([("x", "red red blue"), ("y", "blue"), ("y", "green blue")], "c string, t string")
    counts = tx.term_counts(df, "c", "t")
    got = {(r.c, r.term): r.score for r in tx.class_tfidf(counts, "c").collect()}
    assert got == pytest.approx({("x", "red"): 2 / 3 * math.log(3 / 2 + 1), ("x", "blue"): 1 / 3 * math.log(2), ("y", "blue"): 2 / 3 * math.log(2), ("y", "green"): 1 / 3 * math.log(4)})
    bm = {(r.c, r.term): r.score for r in tx.class_tfidf(counts, "c", bm25=True, reduce_frequent=True).collect()}
    assert bm[("x", "red")] == pytest.approx(math.sqrt(2 / 3) * math.log(1 + (3 - 2 + 0.5) / 2.5))
    seeds = tx.seed_factors(spark.createDataFrame([("red",), ("blue",)], "term string"), spark.createDataFrame([("blue",)], "term string"))
    sd = {(r.c, r.term): r.score for r in tx.class_tfidf(counts, "c", seeds=seeds).collect()}
    assert sd[("x", "red")] == pytest.approx(2 * got[("x", "red")]) and sd[("x", "blue")] == pytest.approx(1.2 * got[("x", "blue")])


def test_top_terms_break_ties_by_term(spark):
    df = spark.createDataFrame([("x", "b", 1.0), ("x", "a", 1.0), ("x", "c", 2.0)], "c string, term string, score double")
    assert [(r["rank"], r.term) for r in tx.top_terms(df, "c", 2).orderBy("rank").collect()] == [(1, "c"), (2, "a")]
    r = tx.word_lists(tx.top_terms(df, "c", 3), "c").first()
    assert r.words == ["c", "a", "b"] and r.word_scores == [2.0, 1.0, 1.0]


def test_prompts(spark):
    df = spark.createDataFrame([(1, "hi"), (2, None)], "i int, s string")
    out = tx.prompt(df, "{}-{}: {}", ["lit", F.col("i"), F.col("s")])
    assert [r.prompt for r in out.orderBy("i").collect()] == ["lit-1: hi", None]
    assert tx.prompt(df, "{}", [F.col("i")], keep=False).columns == ["prompt"]
    with pytest.raises(ValueError):
        tx.prompt(df, "{} {}", [F.col("i")])
    with pytest.raises(ValueError):
        tx.prompt(df, "{}", [])


def test_templates_endpoints_and_json(spark):
    df = spark.createDataFrame([("fold_1_x_ab",), ("other",)], "s string")
    got = [r.p and (r.p.a, r.p.b) for r in df.select(tx.parse_template(F.col("s"), "fold_{}_x_{}", ["a", "b"]).alias("p")).collect()]
    assert got == [("1", "ab"), None]
    urls = spark.createDataFrame([("https://h.x/v1/embeddings",), ("https://h.x/openai/deployments/d/chat/completions?api-version=2",), ("ftp://x",)], "u string")
    assert [r[0] for r in urls.select(tx.endpoint_of(F.col("u"))).collect()] == ["embeddings", "chat/completions", None]
    one = spark.range(1).select(tx.structs_to_string(F.array(F.struct(F.lit("u").alias("role"), F.lit(None).cast("string").alias("content")))).alias("s")).first()
    assert one.s == '{"role":"u","content":null}'


def test_ngrams_of_a_long_text_are_linear(spark):
    import time

    text = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([("c", text)], "c string, t string")
    began = time.monotonic()
    assert df.select(F.size(tx.ngrams(tx.tokens(tx.clean_text(F.col("t"))), 1, 2))).first()[0] == 39_999
    assert tx.term_counts(df, "c", "t", ngram_range=(1, 2)).count() == 39_999
    assert time.monotonic() - began < 20


def test_term_counts_are_those_of_the_expressions(spark, monkeypatch):
    texts = ["The cat,\tthe\nCAT sat; a cat", "", "?!", "a b c", "é", None, "Ünder ñ x1\r\ny2  z", " ", "the cat sat", "𝒳x the the"] * 3
    rows = [(("a", "b", None)[i % 3], (i % 2, [i % 2]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "c string, s struct<i:int,l:array<int>>, t string").coalesce(1)
    for held in (tx.HELD_COUNTS, 2):
        monkeypatch.setattr(tx, "HELD_COUNTS", held)
        for by in ("c", "s", ("c", "s")):
            for span in ((1, 1), (1, 2), (2, 3)):
                keys = (by,) if isinstance(by, str) else by
                plain = df.select(*keys, F.explode(tx.ngrams(tx.tokens(tx.clean_text(F.col("t"))), *span)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
                found = tx.term_counts(df, by, "t", ngram_range=span)
                assert found.columns == plain.columns and sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))


def test_counts_of_a_class_stay_in_one_task(spark):
    df = spark.createDataFrame([(1, "a1 b1 a1"), (1, "a1"), (2, "b1")], "d long, t string")
    shuffles = {}
    for together in (False, True):
        counts = tx.term_counts(df, "d", "t", together=together)
        assert sorted(map(tuple, counts.collect())) == [(1, "a1", 3), (1, "b1", 1), (2, "b1", 1)]
        plan = counts.join(counts.groupBy("d").agg(F.sum("n").alias("s")).hint("merge"), "d")._jdf.queryExecution().executedPlan().toString()
        shuffles[together] = plan.count("hashpartitioning(")
    assert shuffles[True] < shuffles[False]
