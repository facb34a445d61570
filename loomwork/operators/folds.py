"""Deterministic folds as relations.

Order is a hash of seed and key, so the same seed gives the same folds under any partitioning. Ranks
come from counts per hash prefix and a window inside each prefix, or without shuffling from range partitions of
the keys: no group, and not the whole table either, is ever sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Iterator
from enum import Enum
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators.joins import null_safe_join

#: Rows of a hash prefix, about.
PREFIX_ROWS = 1 << 20


class FoldMode(Enum):
    COMBINATORIAL = "combinatorial"
    MONTE_CARLO = "monte_carlo"


class StratMode(Enum):
    PROPORTIONAL = "proportional"
    UNIFORM_STRICT = "uniform_strict"
    UNIFORM_RELAXED = "uniform_relaxed"


@dataclass(frozen=True)
class KFold:
    """``drop_remainder``: leave out the n mod k last rows instead of adding them to the last fold. Without ``shuffle`` folds
    are runs of the sorted keys; Monte-Carlo splits are always drawn."""

    k: int = 5
    n_test: int = 1
    mode: FoldMode = FoldMode.COMBINATORIAL
    shuffle: bool = True
    seed: int = 0
    replicas: int = 5
    drop_remainder: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.n_test < self.k:
            raise ValueError("0 < n_test < k is needed")


@dataclass(frozen=True)
class Stratified(KFold):
    groups: tuple[str, ...] = ()
    strat_mode: StratMode = StratMode.PROPORTIONAL
    group_size: int | None = None


@dataclass(frozen=True)
class Purged(KFold):
    groups: tuple[str, ...] = ()


@dataclass(frozen=True)
class NestedCV:
    inner: KFold = field(default_factory=KFold)
    inner_replicas: int = 1
    outer: KFold | None = None
    outer_replicas: int = 1


def hash_order(key: Column, seed: int | str | Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")))


def ranked(df: DataFrame, key: str, by: tuple[str, ...] = (), seed: int | str | Column = 0, shuffle: bool = True) -> DataFrame:
    """``df`` with ``rn`` (1, 2, ... within ``by``) and ``n`` (rows of the group), in hash order, or by key without ``shuffle``."""
    if not shuffle:
        return _ranked_by_key(df, key, by)
    full = df.withColumn("_h", hash_order(F.col(key), seed))
    full = full.withColumn("_p", F.substring("_h", 1, _prefix(df)))
    count = full.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    before = count.withColumn("_before", F.coalesce(F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_c").over(w))
    joined = null_safe_join(full, before.drop("_c"), [*by, "_p"])
    inside = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", key))
    return joined.withColumn("rn", (inside + F.col("_before")).cast("long")).drop("_h", "_p", "_before")


def _prefix(df: DataFrame) -> int:
    """Hexadecimal digits that cut the table into prefixes of about PREFIX_ROWS, by the plan's estimate of its size: 3, more for
    large tables. Ranks don't depend on it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    digits = 3
    while digits < 8 and size / 16 > PREFIX_ROWS * 16**digits:
        digits += 1
    return digits


def _ranked_by_key(df: DataFrame, key: str, by: tuple[str, ...]) -> DataFrame:
    from loomwork.sources.tables import materialised

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialised(df.repartitionByRange(n, *by, key).withColumn("_part", F.spark_partition_id()), "ranks")
    count = placed.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    before = count.withColumn("_before", F.coalesce(F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_c").over(w))
    joined = null_safe_join(placed, before.drop("_c"), [*by, "_part"])
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(key))
    return joined.withColumn("rn", (inside + F.col("_before")).cast("long")).drop("_part", "_before")


def fold_of(k: int, one_fold_if_few: bool = True) -> Column:
    """Fold of rank ``rn`` among ``n``: k slices of floor(n / k), the last takes the rest. Fewer than k rows: all in the
    last fold, or one in each of the first without ``one_fold_if_few``."""
    rn, n = F.col("rn"), F.col("n")
    plain = F.least(F.floor((rn - 1) / F.greatest(F.floor(n / k), F.lit(1))), F.lit(k - 1))
    return (F.when(n < k, k - 1).otherwise(plain) if one_fold_if_few else plain).cast("int")


def splits(spark: SparkSession, k: int, n_test: int) -> DataFrame:
    """(fold_number, fold, role): C(k, n_test) splits in lexicographic order, a row per fold of each."""
    rows = [(i, f, "test" if f in test else "train") for i, test in enumerate(combinations(range(k), n_test)) for f in range(k)]
    return spark.createDataFrame(rows, "fold_number int, fold int, role string")


def _with_fold(df: DataFrame, key: str, c: KFold, seed: int | str | Column, scope: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its fold by the strategy of ``c``; ``scope``: columns within which folds are made anew."""
    if isinstance(c, Purged):
        groups = df.select(*scope, *c.groups).distinct().withColumn("_g", F.concat_ws("\x1f", *(F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for g in c.groups)))
        placed = ranked(groups, "_g", scope, seed, c.shuffle).withColumn("fold", fold_of(c.k, False)).drop("_g", "rn", "n")
        return null_safe_join(df, placed, [*scope, *c.groups])
    if isinstance(c, Stratified):
        out = ranked(df, key, (*scope, *c.groups), seed, c.shuffle)
        if c.strat_mode is not StratMode.PROPORTIONAL:
            limit = F.lit(c.group_size if c.group_size is not None else 2**62)
            if c.strat_mode is StratMode.UNIFORM_STRICT:
                least = df.groupBy(*scope, *c.groups).count().agg(F.min("count").alias("_least"))
                out = out.join(F.broadcast(least))  # one row
                limit = F.least(limit, F.col("_least"))
            out = out.where(F.col("rn") <= limit).withColumn("n", F.least("n", limit)).drop("_least")
        return out.withColumn("fold", fold_of(c.k)).drop("rn", "n")
    out = ranked(df, key, scope, seed, c.shuffle)
    if c.drop_remainder:
        out = out.where(F.col("rn") <= c.k * F.floor(F.col("n") / c.k))
    return out.withColumn("fold", fold_of(c.k, False)).drop("rn", "n")


def cv_folds(df: DataFrame, c: KFold, key: str = "cv_index", scope: tuple[str, ...] = (), replica: Column | None = None) -> DataFrame:
    """The fold relation: scope, key, fold_number, replica, role.

    Combinatorial: one split for each choice of test folds. Monte-Carlo: ``replicas`` splits by seed + i;
    test is n_test / k of the rows (of each stratum, or of the groups), train the rest.
    """
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    groups = getattr(c, "groups", ())
    base = df.select(*dict.fromkeys([*scope, key, *groups]))
    seed = lambda i: F.concat_ws("/", F.lit(str(c.seed + i)), replica.cast("string")) if replica is not None else c.seed + i
    if c.mode is FoldMode.COMBINATORIAL:
        placed = _with_fold(base, key, c, seed(0), scope)
        table = splits(df.sparkSession, c.k, c.n_test)  # k * C(k, n_test) rows
        out = placed.join(F.broadcast(table), "fold").withColumn("replica", F.lit(0))
    elif c.mode is FoldMode.MONTE_CARLO:
        parts = []
        for i in range(c.replicas):
            if isinstance(c, Purged):
                part = _with_fold(base, key, c, seed(i), scope).withColumn("role", F.when(F.col("fold") < c.k - c.n_test, "train").otherwise("test"))
            else:
                part = ranked(base, key, (*scope, *groups) if isinstance(c, Stratified) else scope, seed(i)).withColumn(
                    "role", F.when(F.col("rn") <= F.floor(F.col("n") * c.n_test / c.k), "test").otherwise("train")
                )
            parts.append(part.select(*scope, key, F.lit(i).alias("fold_number"), F.lit(i).alias("replica"), "role"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    else:
        raise ValueError(f"mode {c.mode}")
    return out.select(*scope, key, "fold_number", "replica", "role")


def nested_folds(df: DataFrame, c: NestedCV, key: str = "cv_index") -> DataFrame:
    """(r_outer, k_outer, r_inner, k_inner, key, role): role test for the outer test rows, train or val inside dev.

    Without ``outer`` there is no test role and r_outer = k_outer = 0.
    """
    groups = tuple(dict.fromkeys([*getattr(c.inner, "groups", ()), *(getattr(c.outer, "groups", ()) if c.outer else ())]))
    base = df.select(*dict.fromkeys([key, *groups]))
    if c.outer is None:
        dev = base.withColumn("r_outer", F.lit(0)).withColumn("k_outer", F.lit(0))
        test = None
    else:
        outers = []
        for r in range(c.outer_replicas):
            o = cv_folds(base, _seeded(c.outer, r), key).withColumn("r_outer", F.lit(r)).withColumnRenamed("fold_number", "k_outer")
            outers.append(o.select("r_outer", "k_outer", key, "role"))
        outer = outers[0]
        for o in outers[1:]:
            outer = outer.unionByName(o)
        dev = outer.where("role = 'train'").drop("role").join(base, key)
        test = outer.where("role = 'test'").drop("role")
    inners = []
    for r in range(c.inner_replicas):
        i = cv_folds(dev, _seeded(c.inner, r), key, ("r_outer", "k_outer"), F.concat_ws(",", "r_outer", "k_outer"))
        inners.append(i.select("r_outer", "k_outer", F.lit(r).alias("r_inner"), F.col("fold_number").alias("k_inner"), key, F.when(F.col("role") == "test", "val").otherwise("train").alias("role")))
    inner = inners[0]
    for i in inners[1:]:
        inner = inner.unionByName(i)
    if test is None:
        return inner
    n_inner = c.inner.replicas if c.inner.mode is FoldMode.MONTE_CARLO else len(list(combinations(range(c.inner.k), c.inner.n_test)))
    inside = [F.struct(F.lit(r).alias("r"), F.lit(k).alias("k")) for r in range(c.inner_replicas) for k in range(n_inner)]
    shared = test.withColumn("_i", F.explode(F.array(*inside)))
    return inner.unionByName(shared.select("r_outer", "k_outer", F.col("_i.r").alias("r_inner"), F.col("_i.k").alias("k_inner"), key, F.lit("test").alias("role")))


def _seeded(c: KFold, r: int) -> KFold:
    return c if r == 0 else type(c)(**{**c.__dict__, "seed": c.seed + 1000 * r})


def split_ids(folds: DataFrame, key: str = "cv_index") -> Iterator[tuple[int, int, DataFrame, DataFrame]]:
    """(fold number, replica, keys of train, keys of test) of each split of a fold relation; the keys stay relations."""
    for r in folds.select("fold_number", "replica").distinct().orderBy("fold_number", "replica").collect():  # a row a split
        here = folds.where((F.col("fold_number") == r.fold_number) & (F.col("replica") == r.replica))
        yield r.fold_number, r.replica, here.where("role = 'train'").select(key), here.where("role = 'test'").select(key)


def nested_labels(df: DataFrame, c: NestedCV | None, key: str = "cv_index", return_joined: bool = False) -> DataFrame:
    """key and a column of roles per nested fold, ``fold_{r_outer}_{k_outer}_{r_inner}_{k_inner}``; with ``return_joined`` beside all
    columns of ``df``. Without ``c`` the folds are precomputed: the columns of ``df`` with ``fold`` in their names."""
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    if c is None:
        given = [x for x in df.columns if "fold" in x and x != key]
        if not given:
            raise ValueError("no precomputed fold columns")
        return df if return_joined else df.select(key, *given)
    wide = fold_labels(nested_folds(df, c, key), key, F.concat(F.lit("fold_"), fold_name("r_outer", "k_outer", "r_inner", "k_inner")))
    return df.join(wide, key, "left") if return_joined else wide


def fold_name(*parts: str) -> Column:
    return F.concat_ws("_", *(F.col(p).cast("string") for p in parts))


def fold_labels(folds: DataFrame, key: str, name: Column, values: list[str] | None = None) -> DataFrame:
    """A wide table: one label column per fold, by one pivot."""
    return folds.withColumn("_name", name).groupBy(key).pivot("_name", values).agg(F.first("role"))


def kfold_labels(df: DataFrame, c: KFold, key: str = "cv_index", labels: tuple = ("train", "test")) -> DataFrame:
    """key and ``fold_0`` ... ``fold_{k-1}`` with the two labels."""
    folds = cv_folds(df, c, key).withColumn("role", F.when(F.col("role") == "test", labels[1]).otherwise(labels[0]))
    return fold_labels(folds, key, F.concat(F.lit("fold_"), F.col("fold_number").cast("string")), [f"fold_{i}" for i in range(len(list(combinations(range(c.k), c.n_test))))])


def balanced(df: DataFrame, target: str, key: str, seed: int = 0, size: int | None = None) -> DataFrame:
    """As many rows of either target value, at most ``size`` of each, in hash order; null targets go."""
    ranks = ranked(df.where(F.col(target).isNotNull()), key, (target,), seed)
    counts = df.groupBy().agg(F.count_if(F.col(target).cast("boolean")).alias("_p"), F.count_if(~F.col(target).cast("boolean")).alias("_q"))
    limit = F.least("_p", "_q", F.lit(size if size is not None else 2**62))
    return ranks.join(F.broadcast(counts)).where(F.col("rn") <= limit).drop("rn", "n", "_p", "_q")  # one row


def resampled_folds(df: DataFrame, target: str, c: KFold, key: str = "cv_index") -> DataFrame:
    """Balanced on a boolean target, then stratified by it."""
    return cv_folds(balanced(df, target, key, c.seed), Stratified(**{**c.__dict__, "groups": (target,)}), key)


def sample_per_group(df: DataFrame, key: str, by: tuple[str, ...], fraction: float | None = None, n: int | None = None, seed: int = 1) -> DataFrame:
    """The first floor(fraction * size), or n, rows of each group in hash order: distinct, and the same each time."""
    ranks = ranked(df, key, by, seed)
    limit = F.floor(F.col("n") * fraction) if fraction is not None else F.lit(n)
    return ranks.where(F.col("rn") <= limit).drop("rn", "n")


def divide_by_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows where the boolean target is true, and where it is false; nulls are in neither."""
    return df.where(F.col(target)), df.where(~F.col(target))


def train_test_val(df: DataFrame, folds: DataFrame, key: str = "cv_index") -> DataFrame:
    """Rows with the role of each fold: one join, not a filter per role."""
    return folds.join(df, key)


def fold_frames(df: DataFrame, folds: DataFrame, key: str = "cv_index", **fold: int) -> dict[str, DataFrame]:
    """The rows of each role of one fold, such as ``fold_number=2`` or ``k_outer=0, k_inner=1``; ValueError if there is no such fold."""
    here = folds
    for name, value in fold.items():
        here = here.where(F.col(name) == value)
    roles = sorted(r.role for r in here.select("role").distinct().collect())  # three at most
    if not roles:
        raise ValueError(f"no fold {fold}")
    return {role: df.join(here.where(F.col("role") == role).select(key), key) for role in roles}


def with_row_index(df: DataFrame, order: list[str], name: str = "cv_index") -> DataFrame:
    """A dense 0-based index in the order of ``order`` (which should be unique), without one-task sorting: range
    partitions are sorted and written once, their sizes give the offsets."""
    from loomwork.sources.tables import materialised

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = materialised(placed, "index")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_c"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_at") + F.col("_off")).cast("long")).drop("_part", "_at", "_off")  # a row per partition


def check_row_index(df: DataFrame, order: list[str], name: str = "cv_index", strict: bool = False) -> DataFrame:
    """``df`` with an index: its own, or a new one; ``strict``: a missing one is an error."""
    if name in df.columns:
        return df
    if strict:
        raise ValueError(f"no column {name}")
    return with_row_index(df, order, name)
