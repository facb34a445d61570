from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import features as ft
from loomwork.operators import folds as fd
from loomwork.operators import topics as tp
from loomwork.operators import train as tr
from loomwork.plans import model_queries as mq
from loomwork.sources import tables as tb
from loomwork.streaming import events as ev


def test_scalers(spark):
    x = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v, 5.0) for v in x], "x double, c double")
    get = lambda k, **a: [tuple(r) for r in ft.Scaler(k, ["x", "c"]).fit(df, **a).transform(df).collect()]
    a = np.array(x)
    assert [r[0] for r in get("standard")] == pytest.approx((a - a.mean()) / a.std()) and {r[1] for r in get("standard")} == {0.0}
    assert [r[0] for r in get("robust")] == pytest.approx((a - 3) / 2)
    assert [r[0] for r in get("minmax")] == pytest.approx((a - 1) / 99) and [r[0] for r in get("maxabs")] == pytest.approx(a / 100)
    assert [r[0] for r in get("normalizer")] == pytest.approx(a / np.sqrt(a**2 + 25))
    power = [r[0] for r in get("power")]
    assert np.mean(power) == pytest.approx(0, abs=1e-9) and np.std(power) == pytest.approx(1) and power == sorted(power)
    assert [r[0] for r in get("quantile", quantiles=4)] == pytest.approx([0, 0.25, 0.5, 0.75, 1])
    with pytest.raises(ValueError):
        ft.Scaler("other", ["x"]).fit(df)


def test_categories(spark):
    df = spark.createDataFrame([("b", "p"), ("a", "q"), (None, "r"), ("b", "s")] * 3, "k string, u string")
    assert ft.low_cardinality(df, 0.2) == ["k"]
    assert [r.k for r in ft.encode_categories(df, ["k"]).distinct().orderBy("k", "u").select("k").distinct().orderBy("k").collect()] == [None, 0, 1]
    with pytest.raises(ValueError):
        ft.low_cardinality(df, 1.0)
    with pytest.raises(Exception, match="unknown category"):
        df.select(ft.one_hot(F.col("k"), ["a"])).collect()


def test_feature_checks(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (0, "b", [1.0])], "target int, s string, v array<double>")
    for s in (ft.FeatureSet(numerical=(ft.Numerical("s"),)), ft.FeatureSet(numerical=(ft.Numerical("zz"),)), ft.FeatureSet(embeddings=(ft.Embedding("v", 2),)), ft.FeatureSet(categorical=(ft.Categorical("s", one_hot=False),))):
        with pytest.raises(ValueError):
            s.check(df)
    assert ft.FeatureSet((ft.Numerical("b"),), (), (ft.Categorical("a"),)).name == "a_b"
    with pytest.raises(ValueError):
        ft.vector_width(df, "v")


def test_nested_training_learns(spark):
    r = np.random.default_rng(0)
    rows = [(i, int(i % 2), float(i % 2) + float(r.normal(0, 0.2)), [float(r.normal()), float(i % 2)], "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "cv_index long, target int, x double, v array<double>, k string")
    sets = (ft.FeatureSet((ft.Numerical("x"),), (ft.Embedding("v", 2, "standard"),), (ft.Categorical("k"),)),)
    classifiers = [tr.Logistic(max_iter=10), tr.Forest(n_estimators=3, max_depth=2)]
    predictions, metrics = tr.train_nested_cv(df, ft.InputConfig(sets), classifiers, fd.NestedCV(inner=fd.KFold(k=2)), threads=2)
    assert predictions.count() == 2 * 2 * 60
    got = metrics.collect()
    assert len(got) == 4 and all(m.accuracy_val > 0.9 and m.mcc_val > 0.8 and m.accuracy_test is None for m in got)
    assert {m.classifier_name: m.hyper_parameters["max_iter"] if "max_iter" in m.hyper_parameters else None for m in got} == {"Logistic": "10", "Forest": None}


def test_topics(spark):
    docs = spark.createDataFrame([(i, f"{w} {w} common", t) for i, (w, t) in enumerate([("apple", 0), ("apple", 0), ("pear", 1), ("pear", 1), ("car", 2), ("noise", -1)])], "id long, text string, topic int")
    m = tp.fit_topics(docs, "id", "text", top_n=2, fraction=1.0)
    assert m.topic(0)[0][0] == "apple"
    assert {r.topic: (r.size, r.label) for r in m.info.collect()}[1] == (2, "1_pear_common")
    assert {r.id for r in m.docs.where("topic = 0").collect()} == {0, 1}
    h = tp.hierarchy(m.counts)
    assert len(h) == 2 and h[-1]["topics"] == [0, 1, 2] and "├─" in tp.tree(h)
    assert tp.ward(np.array([[0, 1, 5], [1, 0, 5], [5, 5, 0.0]]))[0] == (0, 1, 1.0)
    with pytest.raises(ValueError):
        tp.ward(np.array([[0, 1], [2, 0]]))
    t = tp.TopicMapper([0, 1, 2])
    t.add({0: 0, 1: 0, 2: 1})
    t.add({0: 5, 1: 1})
    assert t.mapping() == {0: 5, 1: 5, 2: 1} and t.mapping(False) == {0: 5, 1: 1}


def test_sinks_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(6)], "cv_index long, target int, x double")
    tb.save_feature_sets(df, {"x": ["x"]}, str(tmp_path))
    assert tb.load_feature_set(spark, str(tmp_path), "x").count() == 6
    tb.check_feature_sets(spark, str(tmp_path), ["x"])
    with pytest.raises(FileNotFoundError):
        tb.check_feature_sets(spark, str(tmp_path), ["y"])
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert tb.read_tsv(spark, str(tmp_path / "t.tsv")).first().asDict() == {"a": 1, "b": "x"}
    rows = spark.sql("select timestamp'2024-01-01 00:05:00' + make_interval(0,0,0,0,0,i*30) ts, i % 2 user_id, 1.0 value, 'e' event_type from (select explode(sequence(0, 9)) i)")
    rows.write.parquet(str(tmp_path / "s"))
    stream = ev.read_stream(spark, str(tmp_path / "s"), rows.schema)
    out = ev.run_available(ev.tumbling(stream), "windows").collect()
    assert sorted(r.n for r in out) == [2] * len(out) and len(out) == 4  # the last window stays open
    assert ev.run_available(ev.unique_requests(ev.read_stream(spark, str(tmp_path / "s"), rows.schema), "user_id", late="1 day"), "unique").count() == 2


def _brute_knn(train, test, k):
    """Of (key, vector, label): votes of the k most similar by rounded cosine, then key."""
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1)
    near = lambda v: sorted((-round(float(unit(v) @ unit(w)), 12) if np.any(w) and np.any(v) else np.inf, i, t) for i, w, t in train)[:k]
    return {i: min((-c, t) for t, c in Counter(x[2] for x in near(v)).items())[1] for i, v, _ in test}


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tr, "KNN_BLOCK", 40)  # several blocks a side
    g = np.random.default_rng(3)
    rows = [(i, [float(x) for x in g.integers(-2, 3, 3)], int(g.integers(0, 4))) for i in range(300)]  # ties and zero vectors
    df = spark.createDataFrame(rows, "id long, v array<float>, label int")
    train, test = rows[:200], rows[200:]
    got = {r.id: r.prediction for r in tr.knn_predict(df.where("id < 200"), df.where("id >= 200"), "v", "label", "id", 3).collect()}
    assert got == _brute_knn(train, test, 3)
    bad = spark.createDataFrame([(0, None, 9), (1, [1.0, None, 0.0], 9), (2, [1.0], 9), (3, [1.0, 0.0, 0.0], 5)], "id long, v array<float>, label int")
    assert [tuple(r) for r in tr.knn_predict(bad, df.where("id = 200"), "v", "label", "id", 1).collect()] == [(200, 5 if np.any(rows[200][1]) else 9)]
    many = spark.range(20_001).selectExpr("id", "array(float(id % 7), 1f) as v", "int(id % 7) as label")
    monkeypatch.setattr(tr, "KNN_BLOCK", 8192)
    assert tr.knn_predict(many, many.where("id < 7"), "v", "label", "id", 5).where("id != prediction").count() == 0


def test_neighbours_of_all_folds(spark):
    d = "/root/testdata/sf0.001"
    e = [(r.vec_id, r.embedding, r.label) for r in tb.table(spark, d, "embeddings").collect()]
    folds = fd.cv_folds(tb.table(spark, d, "embeddings"), fd.KFold(k=5, seed=4), "vec_id").collect()
    want = {}
    for f in range(5):
        role = {r.vec_id: r.role for r in folds if r.fold_number == f}
        want |= _brute_knn([x for x in e if role[x[0]] == "train"], [x for x in e if role[x[0]] == "test"], 5)
    got = [tuple(r) for r in mq.neighbour_predictions(spark, d).collect()]
    assert len(got) == len(e) and dict(got) == want


def test_large_dictionaries(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i % 300}",) for i in range(900)] + [("é",), ("Z",), (None,)], "k string")
    few = {r.value: r.code for r in ft.dictionary(df, "k").collect()}
    monkeypatch.setattr(ft, "SMALL", 20)
    many = {r.value: r.code for r in ft.dictionary(df, "k").collect()}
    assert few == many and sorted(few.values()) == list(range(302)) and few["Z"] == 0 and few["é"] == 301


def test_boosting_perceptron_and_weights(spark):
    r = np.random.default_rng(1)
    rows = [(i, int(i % 5 == 0), [float(i % 5 == 0) + float(r.normal(0, 0.1)), float(r.normal())], "train" if i % 4 else "test") for i in range(200)]
    df = spark.createDataFrame(rows, "cv_index long, target int, v array<double>, role string")
    s = ft.FeatureSet(embeddings=(ft.Embedding("v", 2),))
    for c in (tr.Boosting(max_iter=3, min_samples_leaf=2, max_depth=2), tr.Boosting(max_iter=3, min_samples_leaf=2, class_weight="balanced"), tr.Perceptron(hidden=4, max_iter=60, random_state=1), tr.Logistic(class_weight="balanced"), tr.Forest(n_estimators=5, class_weight=((0, 1.0), (1, 4.0)), max_samples=0.8)):
        out = tr.fit_and_score(df, s, c, "target", "cv_index").where("role = 'test'").collect()
        assert len(out) == 50 and sum(x.target == x.prediction for x in out) >= 47, c
    three = df.withColumn("target", F.expr("target + case when cv_index % 5 = 1 then 2 else 0 end")).withColumn("v", F.array(F.col("target").cast("double"), F.get("v", F.lit(1))))
    out = tr.fit_and_score(three, s, tr.Boosting(max_iter=2, min_samples_leaf=1, max_depth=2), "target", "cv_index").collect()
    assert sum(x.target == x.prediction for x in out) >= 190
    none = tr.fit_and_score(df.withColumn("v", F.array(F.lit(0.0), F.lit(0.0))), s, tr.Logistic(class_weight=((1, 100.0),)), "target", "cv_index")
    assert {x.prediction for x in none.collect()} == {1}


def test_settings_by_name():
    assert tr.Forest.of({"n_estimators": 7, "n_jobs": -1, "ccp_alpha": 0.0, "class_weight": {0: 1.0}}, {"ccp_alpha": 0.0}) == tr.Forest(n_estimators=7, class_weight=((0, 1.0),))
    with pytest.raises(ValueError, match="ccp_alpha, monotonic_cst"):
        tr.Forest.of({"ccp_alpha": 0.1, "monotonic_cst": {"a": 1}}, {"ccp_alpha": 0.0})
    assert tr.Logistic().id == "C_1.0_fit_intercept_True_max_iter_100_penalty_l2_tol_0.0001"


def test_a_run_goes_on_where_it_was_cut_off(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, i % 2, float(i % 2)) for i in range(40)], "cv_index long, target int, x double")
    inputs, cv = ft.InputConfig((ft.FeatureSet((ft.Numerical("x"),)),)), fd.NestedCV(inner=fd.KFold(k=3))
    fits, true_fit = [], tr.fit_and_score

    def failing(*a):
        fits.append(1)
        if len(fits) == 2:
            raise RuntimeError("lost")
        return true_fit(*a)

    monkeypatch.setattr(tr, "fit_and_score", failing)
    with pytest.raises(RuntimeError, match="lost"):
        tr.train_nested_cv(df, inputs, [tr.Logistic(max_iter=2)], cv, threads=1, folder=f"file://{tmp_path}")
    done = len(list(tmp_path.glob("*/_SUCCESS")))
    assert done >= 1
    before = len(fits)
    predictions, metrics = tr.train_nested_cv(df, inputs, [tr.Logistic(max_iter=2)], cv, threads=1, folder=f"file://{tmp_path}")
    assert len(fits) - before == 3 - done and metrics.count() == 3 and predictions.count() == 3 * 40


def test_soft_topics_and_strategies(spark):
    r = np.random.default_rng(2)
    docs = [(i, ["apple pie", "fast car"][i % 2], [float(i % 2) * 5 + float(r.normal(0, 0.1)), float(r.normal(0, 0.1)), 0.1 * (i % 3)]) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, text string, v array<double>")
    model, placed = tp.topics_of_vectors(df, "id", "text", "v", tp.SoftClusters(2, reduce_to=2), top_n=2)
    rows = placed.collect()
    assert len({(x.id % 2, x.topic) for x in rows}) == 2 and all(0.5 <= x.probability <= 1 and abs(sum(x.probabilities) - 1) < 1e-6 for x in rows)
    assert {w for t in {x.topic for x in rows} for w, _ in model.topic(t)} == {"apple", "pie", "fast", "car"}
    assert {x.topic for x in tp.soft_cluster(df, "v", 2, 2, least=1.1).collect()} == {-1}
    _, hard = tp.topics_of_vectors(df, "id", "text", "v", tp.HardClusters(2, reduce_to=None))
    assert len({(x.id % 2, x.topic) for x in hard.collect()}) == 2


def test_readers_sinks_and_hooks(spark, tmp_path):
    from loomwork.functions import vectors as vx

    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    assert sorted(x.x for x in tb.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 2]
    assert tb.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x string").dtypes == [("x", "string")]
    p, m = spark.createDataFrame([(1, 0)], "cv_index long, prediction long"), spark.createDataFrame([(0.5,)], "mcc_val double")
    for run in ("one", "two"):
        tb.save_results(p, m, str(tmp_path / "results"), run)
    got = spark.read.parquet(str(tmp_path / "results/metrics"))
    assert sorted(x.run for x in got.collect()) == ["one", "two"]
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "cv_index long, x double")
    out = vx.map_batches(df, lambda f: f.assign(x=f.x * 2), "cv_index long, x double")
    assert sorted(x.x for x in out.collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]
    s = ft.FeatureSet((ft.Numerical("x"),))
    assert ft.needed_columns(df.withColumn("target", F.lit(1)).withColumn("g", F.lit(1)).withColumn("z", F.lit(1)), ft.InputConfig((s,)), ("g",)).columns == ["cv_index", "target", "x", "g"]
    words = spark.createDataFrame([("t", [1.0, 0.0], w, v) for w, v in (("a", [1.0, 0.0]), ("b", [0.99, 0.1]), ("c", [0.5, 0.8]))], "k string, t array<double>, w string, v array<double>")
    assert [x.w for x in vx.mmr(words, "k", "t", "w", "v", diversity=0.7, n=2).orderBy("rank").collect()] == ["a", "c"]


def test_typed_chat_results_fail_fast(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('[{"messages": []}, {"choices": "none"}]\n')
    assert tb.read_chat_results(spark, str(tmp_path / "bad.jsonl")).first().choice is None
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tb.read_chat_results(spark, str(tmp_path / "bad.jsonl"), typed=True).collect()


def test_documents_are_checked(spark):
    df = spark.createDataFrame([(1, 2, 0)], "id long, text long, topic int")
    for text, match in (("text", "not text"), ("other", "no column")):
        with pytest.raises(ValueError, match=match):
            tp.fit_topics(df, "id", text)


def test_tasks_join_nothing_and_share_scalers(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 2, float(i % 7)) for i in range(40)], "cv_index long, target int, x double")
    plans, scaled = [], []
    fit, features = tr.fit_and_score, tr.feature_vector
    monkeypatch.setattr(tr, "fit_and_score", lambda rows, *a: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), fit(rows, *a))[1])
    monkeypatch.setattr(tr, "feature_vector", lambda *a: (scaled.append(1), features(*a))[1])
    inputs = ft.InputConfig((ft.FeatureSet(numerical=(ft.Numerical("x", "standard"),)),))
    cv = fd.NestedCV(outer=fd.KFold(k=2, seed=1), inner=fd.KFold(k=2, seed=2))
    predictions, metrics = tr.train_nested_cv(df, inputs, [tr.Logistic(max_iter=2), tr.Logistic(max_iter=3)], cv, threads=1)
    assert len(plans) == 8 and len(scaled) == 4 and not [p for p in plans if "Join" in p]
    folds = fd.nested_folds(df, cv)
    assert metrics.count() == 8 and predictions.count() == 2 * folds.count()
    where = ["k_outer", "k_inner", "cv_index", "role"]
    assert sorted(map(tuple, predictions.select(*where).distinct().collect())) == sorted(map(tuple, folds.select(*where).collect()))


def test_hierarchy_makes_the_counts_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(t, f"w{t % 2}{i}", 1 + (t + i) % 3) for t in range(4) for i in range(5)] + [(-1, "out", 9)]
    counts = spark.createDataFrame(rows, "topic int, term string, n long").mapInArrow(count, "topic int, term string, n long")
    found = tp.hierarchy(counts)
    assert made.value == len(rows)
    assert [m["topics"] for m in found][-1] == [0, 1, 2, 3] and {tuple(m["topics"]) for m in found[:2]} == {(0, 2), (1, 3)}
    assert found[-1]["parent_name"] and "out" not in found[-1]["parent_name"]


def test_near_is_exact_and_few_are_compared_twice():
    r = np.random.default_rng(5)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r.normal(size=(700, 16)), r.normal(size=(3000, 16))))
    b[1500:1600] = b[:100]  # ties go to the least row
    for n in (3000, 30, 3, 0):
        at, of, by = tr._near(a, b[:n], 5)
        s = 0.0 - np.round(a @ b[:n].T, 12)
        assert len(at) == 700 * min(n, 5)
        for i in (0, 1, 255, 256, 699):
            assert of[at == i].tolist() == np.lexsort((np.arange(n), s[i]))[:5].tolist() and np.allclose(by[at == i], np.sort(s[i])[:5], atol=1e-11)
    assert tr._blocks(0) == 1 and tr._blocks(51_282) == 7 and tr._blocks(102_564) == 8 and tr._blocks(615_384) == 19


def test_representative_documents_count_words_in_batches(spark):
    docs = spark.createDataFrame([(i, f"Apple, {w}\tapple", t) for i, (w, t) in enumerate([("x1", 0), ("pie", 0), ("pear", 1), ("", 1)])], "id long, text string, topic int")
    m = tp.fit_topics(docs, "id", "text", top_n=2, fraction=1.0)
    plan = m.docs._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    assert sorted((r.topic, r.id) for r in m.docs.collect()) == [(0, 0), (0, 1), (1, 2), (1, 3)]
