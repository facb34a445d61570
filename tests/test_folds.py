from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from loomwork.operators import folds as fd

MC = fd.FoldMode.MONTE_CARLO


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, f"g{i % 7}" if i % 11 else None, "abc"[i % 3], i % 2 == 0) for i in range(103)], "cv_index long, user string, kind string, target boolean")


def collect(df):
    out = defaultdict(lambda: defaultdict(set))
    for r in df.collect():
        out[r.fold_number][r.role].add(r.cv_index)
    return out


@pytest.mark.parametrize(
    "c",
    [fd.KFold(k=5, n_test=2), fd.Purged(k=4, n_test=1, groups=("user",)), fd.Stratified(k=4, n_test=2, groups=("kind",)), fd.KFold(k=5, mode=MC), fd.Purged(k=4, mode=MC, groups=("user",)), fd.Stratified(k=4, mode=MC, groups=("kind",))],
)
def test_invariants(rows, c):
    folds = collect(fd.cv_folds(rows, c))
    everyone = set(range(103))
    assert len(folds) == (c.replicas if c.mode is MC else comb(c.k, c.n_test))
    for f in folds.values():
        assert f["train"] | f["test"] == everyone and not f["train"] & f["test"] and f["train"] and f["test"]
    if c.mode is not MC:
        assert set(Counter(i for f in folds.values() for i in f["test"]).values()) == {comb(c.k - 1, c.n_test - 1)}
    user = {r.cv_index: r.user for r in rows.collect()}
    if isinstance(c, fd.Purged):
        assert all(not {user[i] for i in f["train"]} & {user[i] for i in f["test"]} for f in folds.values())


def test_same_folds_under_any_partitioning(rows):
    c = fd.Stratified(k=4, groups=("kind", "user"), seed=3)
    a = {tuple(r) for r in fd.cv_folds(rows, c).collect()}
    assert a == {tuple(r) for r in fd.cv_folds(rows.repartition(7), c).collect()}
    assert a != {tuple(r) for r in fd.cv_folds(rows, fd.Stratified(k=4, groups=("kind", "user"), seed=4)).collect()}


def test_remainders_and_few_rows(spark, rows):
    sizes = sorted(len(f["test"]) for f in collect(fd.cv_folds(rows, fd.KFold(k=5))).values())
    assert sizes == [20, 20, 20, 20, 23]
    dropped = collect(fd.cv_folds(rows, fd.KFold(k=5, drop_remainder=True)))
    assert all(len(f["test"]) == 20 and len(f["train"]) == 80 for f in dropped.values())
    few = spark.createDataFrame([(i, "a") for i in range(3)], "cv_index long, g string")
    tests = {k: len(f["test"]) for k, f in collect(fd.cv_folds(few, fd.Stratified(k=5, groups=("g",)))).items()}
    assert tests == {0: 0, 1: 0, 2: 0, 3: 0, 4: 3}
    assert fd.cv_folds(few.limit(0), fd.KFold(k=2)).count() == 0


def test_uniform_strata(rows):
    least = min(Counter(r.kind for r in rows.collect()).values())
    strict = fd.cv_folds(rows, fd.Stratified(k=3, groups=("kind",), strat_mode=fd.StratMode.UNIFORM_STRICT)).where("fold_number = 0")
    assert strict.count() == 3 * least
    relaxed = fd.cv_folds(rows, fd.Stratified(k=3, groups=("kind",), strat_mode=fd.StratMode.UNIFORM_RELAXED, group_size=5)).where("fold_number = 0")
    assert relaxed.count() == 15


def test_nested(rows):
    c = fd.NestedCV(outer=fd.Purged(k=3, groups=("user",)), inner=fd.Stratified(k=2, groups=("kind",)), outer_replicas=2, inner_replicas=2)
    by = defaultdict(lambda: defaultdict(set))
    for r in fd.nested_folds(rows, c).collect():
        by[r.r_outer, r.k_outer, r.r_inner, r.k_inner][r.role].add(r.cv_index)
    assert len(by) == 2 * 3 * 2 * 2
    tests = defaultdict(set)
    for (ro, ko, _, _), f in by.items():
        assert f["train"] | f["val"] | f["test"] == set(range(103)) and sum(map(len, f.values())) == 103
        tests[ro, ko].add(frozenset(f["test"]))
    assert all(len(t) == 1 for t in tests.values())
    alone = fd.nested_folds(rows, fd.NestedCV(inner=fd.KFold(k=2)))
    assert {r.role for r in alone.collect()} == {"train", "val"}


def test_balance_samples_and_index(rows):
    out = fd.balanced(rows, "target", "cv_index", size=10)
    assert Counter(r.target for r in out.collect()) == {True: 10, False: 10}
    assert fd.sample_per_group(rows, "cv_index", ("kind",), n=4).count() == 12
    t, f = fd.divide_by_target(rows.withColumn("target", F.when(F.col("cv_index") > 2, F.col("target"))), "target")
    assert t.count() + f.count() == 100
    index = fd.with_row_index(rows.withColumnRenamed("cv_index", "k"), ["kind", "k"]).orderBy("kind", "k").collect()
    assert [r.cv_index for r in index] == list(range(103))
    with pytest.raises(ValueError):
        fd.check_row_index(rows.drop("cv_index"), ["kind"], strict=True)
    assert fd.check_row_index(rows, ["kind"]) is rows


def test_errors(rows):
    with pytest.raises(ValueError):
        fd.KFold(k=3, n_test=3)
    with pytest.raises(ValueError):
        fd.cv_folds(rows.drop("cv_index"), fd.KFold())


def test_folds_of_sorted_keys_and_split_views(rows):
    c = fd.KFold(k=4, shuffle=False)
    folds = fd.cv_folds(rows, c)
    seen = 0
    ids = sorted(r.cv_index for r in rows.collect())
    for number, replica, train, test in fd.split_ids(folds):
        got = sorted(r.cv_index for r in test.collect())
        assert replica == 0 and got == ids[seen : seen + len(got)] and sorted(got + [r.cv_index for r in train.collect()]) == ids
        seen += len(got)
    assert seen == len(ids)


def test_nested_labels_joined_and_precomputed(rows):
    cv = fd.NestedCV(inner=fd.KFold(k=2), outer=fd.KFold(k=2))
    wide = fd.nested_labels(rows, cv)
    assert wide.columns == ["cv_index", "fold_0_0_0_0", "fold_0_0_0_1", "fold_0_1_0_0", "fold_0_1_0_1"]
    joined = fd.nested_labels(rows, cv, return_joined=True)
    assert joined.count() == rows.count() and set(rows.columns) <= set(joined.columns)
    assert {r[0] for r in joined.select("fold_0_0_0_0").distinct().collect()} == {"train", "val", "test"}
    assert fd.nested_labels(joined, None).columns == wide.columns and fd.nested_labels(joined, None, return_joined=True).columns == joined.columns
    with pytest.raises(ValueError):
        fd.nested_labels(rows.drop("fold_0"), None)


def test_frames_of_a_fold(rows):
    folds = fd.cv_folds(rows, fd.KFold(k=4, seed=1))
    frames = fd.fold_frames(rows, folds, fold_number=2)
    assert set(frames) == {"train", "test"} and frames["train"].count() + frames["test"].count() == rows.count()
    assert frames["test"].columns[0] == "cv_index" and frames["test"].join(frames["train"], "cv_index").count() == 0
    with pytest.raises(ValueError, match="no fold"):
        fd.fold_frames(rows, folds, fold_number=9)
