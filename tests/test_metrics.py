import math

import numpy as np
import pytest

from loomwork.functions import vectors as vx
from loomwork.operators import joins as jn
from loomwork.operators import metrics as mt


def test_accuracy_and_mcc(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("a", 1, 0), ("a", 0, 0), ("b", 1, 1), ("b", 1, 1), ("c", 0, 1), ("c", 2, 1), ("c", 2, 2)], "g string, y int, p int")
    got = {r.g: (r.n, r.accuracy, r.mcc) for r in mt.accuracy_and_mcc(df, "y", "p", ["g"]).collect()}
    assert got["a"] == (4, 0.75, pytest.approx((1 * 2 - 0 * 1) / math.sqrt(1 * 2 * 2 * 3)))
    assert got["b"] == (2, 1.0, 0.0)
    assert got["c"] == (3, pytest.approx(1 / 3), pytest.approx((1 * 3 - 2) / math.sqrt((9 - 5) * (9 - 5))))
    assert mt.accuracy_and_mcc(df, "y", "p").first().n == 9


def test_roll_ups(spark):
    rows = [("f", "c", "c1", 0, k, 0, 0, *([0.5 + 0.1 * k] * 6)) for k in range(3)]
    m = spark.createDataFrame(rows, ["feature_set_name", "classifier_name", "classifier_id", "r_outer", "k_outer", "r_inner", "k_inner", *mt.METRICS])
    r = mt.by_inputs(m).first()
    assert r.mcc_val == pytest.approx(0.6) and r.mcc_val_std == pytest.approx(0.1) and r["len"] == 3
    assert mt.by_inputs_and_test_fold(m).count() == 3 and mt.summary(m).count() == 1
    q = mt.quartiles(m, ["feature_set_name"]).first()
    assert (q.low, q.median, q.high) == pytest.approx((0.5, 0.6, 0.7))


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, s string")
    b = spark.createDataFrame([(1, 10), (1, 11), (None, 12)], "k int, v int")
    assert jn.join(a, b, ["k"], unique=True).count() == 3 and jn.join(a, b, ["k"]).count() == 4
    assert jn.keep_ids(a, b, "k").count() == 1
    assert jn.null_safe_join(a.select("s"), spark.createDataFrame([(None, 5)], "s string, z int"), ["s"]).count() == 2
    assert sorted(r.s or "" for r in jn.map_values(a, "s", {"x": "y"}).collect()) == ["", "", "y"]
    assert jn.union_all(a, b).columns == ["k", "s", "v"]
    with pytest.raises(ValueError):
        jn.join(a, b, ["k"], "sideways")


def test_vectors(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 2, [3.0, 4.0]), (3, 2, None)], "id int, c int, v array<float>")
    got = {r.c: (r.size, r.centroid) for r in vx.centroids(df, "c", "v").collect()}
    assert got == {1: (2, [0.5, 0.5]), 2: (1, [3.0, 4.0])}
    near = vx.nearest_centroid(df.where("v is not null"), vx.centroids(df, "c", "v"), "c", "v")
    assert {r.id: r.predicted for r in near.collect()} == {0: 1, 1: 2, 2: 2}
    assert vx.spread_columns(df, "v", 2).columns == ["id", "c", "v_0", "v_1"]
    words = spark.createDataFrame([("t", [1.0, 0.1], w, v) for w, v in (("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [0.0, 1.0]))], "t string, tv array<double>, w string, v array<double>")
    assert [r.w for r in vx.mmr(words, "t", "tv", "w", "v", diversity=0.7, n=2).orderBy("rank").collect()] == ["b", "c"]


def test_quantiles_are_exact(spark):
    from loomwork.functions.quantiles import column_quantiles, quantiles

    r = np.random.default_rng(3)
    groups = {"a": r.normal(size=1), "b": r.integers(0, 5, 500).astype(float), "c": r.normal(size=777), None: r.normal(size=2)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("b", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    p = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {x.g: x.q for x in quantiles(df, ["g"], "v", p).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g] == pytest.approx(np.quantile(x, p))
    wide = spark.createDataFrame([(float(i), None) for i in range(10)], "x double, y double")
    assert column_quantiles(wide, ["x", "y"], [0.5]) == {"x": [4.5], "y": None}


def test_predictions_of_a_model(spark):
    rows = [("f", "Logistic", i, 0, k, 0, 0, n, "test", 1, 1) for i in ("c1", "c2") for k in range(2) for n in range(3)]
    p = spark.createDataFrame(rows, "feature_set_name string, classifier_name string, classifier_id string, r_outer int, k_outer int, r_inner int, k_inner int, cv_index long, role string, target int, prediction long")
    assert mt.predictions_of(p, "f", "Logistic", "c1").count() == 6
    assert mt.predictions_of(p, "f", "Logistic", "c2", [(0, 1, 0, 0)]).count() == 3
    assert [(a, b, c, d.count()) for a, b, c, d in mt.predictions_by_model(p)] == [("f", "Logistic", "c1", 6), ("f", "Logistic", "c2", 6)]
    with pytest.raises(ValueError, match="no predictions"):
        mt.predictions_of(p, "f", "Forest", "c1")
    with pytest.raises(ValueError, match="folds"):
        mt.predictions_of(p, "f", "Logistic", "c1", [(0, 5, 0, 0)])
