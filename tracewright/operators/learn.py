"""Scorers and models: MAD, isolation forest, conformal intervals, severity, classes, calibration."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml import functions as MF
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import argmax_class, safe_div
from ..session import cut
from .guards import GuardError
from .metrics import calibration_split
from .ordered import order_rows
from .profile import robust_scale
from .quantiles import median_mad, quantiles

MAD_TO_SIGMA = 1.4826
MIN_SIGMA = 1e-9


def robust_score(x: Column, med: Column, mad: Column, absolute: bool = False) -> Column:
    d = F.abs(x - med) if absolute else x - med
    return d / F.greatest(F.lit(MIN_SIGMA), MAD_TO_SIGMA * mad)


def mad_scores(df: DataFrame, keys: Sequence[str], x: str, out: str = "score_mad", absolute: bool = False, longest: int | None = None) -> DataFrame:
    """Robust z of ``x`` within each key."""
    stats = median_mad(df, keys, x, longest).drop("n")
    joined = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))
    return joined.withColumn(out, robust_score(F.col(x), F.col("med"), F.col("mad"), absolute)).drop("med", "mad")


def _fold_sizes(df: DataFrame, fold: str) -> dict[int, int]:
    """Rows of every fold that holds any; a row without a fold is an error."""
    sizes = {r[0]: r[1] for r in df.groupBy(F.col(fold).cast("long")).count().collect()}
    if None in sizes:
        raise GuardError(f"rows without a fold in {fold}")
    return dict(sorted(sizes.items()))


def _fold_list(df: DataFrame, fold: str, folds: int) -> list[int]:
    """``range(folds)`` and every other fold the table names; a row without a fold is an error."""
    return sorted({*_fold_sizes(df, fold), *range(folds)})


def out_of_fold_mad(df: DataFrame, fold: str, folds: int, x: str, out: str = "score_mad", longest: int | None = None) -> DataFrame:
    """Robust z of each row against the rows of all other folds, all folds in one pass.

    Folds beyond ``range(folds)`` count as well. Where no other fold has a value the score is null.
    """
    others = F.filter(F.array(*[F.lit(k).cast("long") for k in _fold_list(df, fold, folds)]), lambda k: k != F.col(fold).cast("long"))
    stats = median_mad(df.select(F.col(x), F.explode(others).alias("__f")), ["__f"], x, longest).drop("n")
    joined = df.withColumn("__f", F.col(fold).cast("long")).join(stats, "__f", "left")
    return joined.withColumn(out, robust_score(F.col(x), F.col("med"), F.col("mad"))).drop("__f", "med", "mad")


def contamination_threshold(scores: DataFrame, score: str, contamination: float, keys: Sequence[str] = (), longest: int | None = None) -> DataFrame:
    return quantiles(scores, keys, score, {"threshold": 1.0 - contamination}, longest)


class MadModel:
    """Robust z of one column against the training rows; ``threshold`` is the score that a share ``contamination`` of them exceeds."""

    def __init__(self, column: str, contamination: float = 0.05):
        self.column, self.contamination = column, contamination

    def fit(self, train: DataFrame) -> MadModel:
        got = median_mad(train, [], self.column).first()
        if got is None or got["med"] is None:
            raise GuardError(f"no values of {self.column} to fit on")
        self.med, self.mad = float(got["med"]), float(got["mad"])
        self.threshold = float(contamination_threshold(self.score(train, "__s"), "__s", self.contamination).first()["threshold"])
        return self

    def score(self, df: DataFrame, out: str = "score_mad") -> DataFrame:
        return df.withColumn(out, robust_score(F.col(self.column), F.lit(self.med), F.lit(self.mad)))


class RobustScaler:
    """Median and interquartile scaling: fitted once, then applied to any frame."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self._stats: dict[str, tuple[float, float]] | None = None

    def fit(self, df: DataFrame) -> RobustScaler:
        if self._stats is not None:
            raise GuardError("already fitted")
        # one row per feature
        self._stats = {r["feature"]: (r["median"], r["iqr"]) for r in robust_scale(df, self.columns).collect()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self._stats is None:
            raise GuardError("transform before fit")
        scaled = {c: (F.col(c) - self._stats[c][0]) / self._stats[c][1] for c in self.columns}
        return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class IsolationForest:
    """Random split trees on small samples; rows isolated after few splits score high."""

    columns: tuple[str, ...]
    trees: int = 300
    sample: int = 256
    contamination: float = 0.02
    seed: int = 42
    emphasised: tuple[str, ...] = ()
    repeats: int = 5
    array: str | None = None

    def _matrix(self, df: DataFrame) -> Column:
        if self.array:
            # an array column holds the values of ``columns`` in order
            return F.transform(self.array, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))
        return F.array(*[F.coalesce(F.when(~F.isnan(c), F.col(c).cast("double")), F.lit(0.0)) for c in self.columns])

    def fit(self, df: DataFrame, row_id: str) -> IsolationForestModel:
        """Grow the trees in parallel, each on about ``sample`` rows drawn by hash, and set the offset.

        The sample has ``trees * sample`` rows however large the table is.
        """
        rows = df.select(F.col(row_id).cast("string").alias("__id"), self._matrix(df).alias("x"), F.array(F.lit(0)).alias("__for"))
        n = rows.count()
        model = self._grown(rows, {0: n})[0]
        scores = cut(model.score(df, "__s").select("__s"))  # read twice below
        offset = contamination_threshold(scores, "__s", self.contamination).first()["threshold"]
        return replace(model, offset=offset)

    def _grown(self, rows: DataFrame, sizes: dict[int, int]) -> dict[int, IsolationForestModel]:
        """Forests by number, without their offset, all in one pass.

        ``rows``: __id, x and ``__for``, the forests whose training rows include the
        row; ``sizes``: how many training rows a forest has. A row's draws are the
        same for every forest.
        """
        wanted = self.trees * self.sample
        slots = {k: max(1, -(-wanted // max(1, n))) for k, n in sizes.items()}
        share = {k: min(1.0, wanted / max(1, n) / slots[k]) for k, n in sizes.items()}
        u = lambda tag: F.xxhash64(F.lit(self.seed), F.lit(tag), F.col("__id"), F.col("__slot"))
        picked = rows.withColumn("__slot", F.explode(F.sequence(F.lit(1), F.lit(max(slots.values()))))).withColumn(
            "__pick", u("pick") / F.lit(2.0**64) + 0.5
        ).filter(F.col("__pick") < max(share.values()))
        forests = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(slots[k]).alias("slots"), F.lit(share[k]).alias("share")) for k in sizes])
        mine = F.filter(forests, lambda f: F.array_contains("__for", f["k"]) & (F.col("__slot") <= f["slots"]) & (F.col("__pick") < f["share"]))
        drawn = picked.select("__id", "x", F.pmod(u("tree"), F.lit(self.trees)).cast("int").alias("tree"), F.explode(mine).alias("__f"))
        drawn = drawn.select("__id", "x", "tree", F.col("__f.k").alias("forest")).dropDuplicates(["forest", "tree", "__id"])
        weights = [self.repeats if c in self.emphasised else 1 for c in self.columns]
        odds = np.array(weights, dtype=float) / sum(weights)
        depths, seed = {k: max(1, math.ceil(math.log2(max(2, min(self.sample, n))))) for k, n in sizes.items()}, self.seed

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree, forest = int(pdf["tree"].iloc[0]), int(pdf["forest"].iloc[0])
            depth = depths[forest]
            rng = np.random.default_rng([seed, tree])
            data = np.stack(pdf.sort_values("__id")["x"].to_numpy())
            nodes: list[list[float]] = []
            todo = [(np.arange(len(data)), 0, -1, 0)]
            while todo:
                members, level, parent, side = todo.pop()
                me = len(nodes)
                if parent >= 0:
                    nodes[parent][2 + side] = me
                sub = data[members]
                spread = sub.max(axis=0) - sub.min(axis=0) if len(members) else np.zeros(len(odds))
                usable = (spread > 0) * odds
                if level >= depth or len(members) <= 1 or usable.sum() == 0:
                    nodes.append([-1, level + _mean_path(len(members)), -1, -1])
                    continue
                f = int(rng.choice(len(odds), p=usable / usable.sum()))
                at = float(rng.uniform(sub[:, f].min(), sub[:, f].max()))
                nodes.append([f, at, -1, -1])
                right = sub[:, f] > at
                todo += [(members[~right], level + 1, me, 0), (members[right], level + 1, me, 1)]
            return pd.DataFrame({"forest": [forest], "tree": [tree], "nodes": [np.array(nodes).ravel().tolist()]})

        grown = drawn.groupBy("forest", "tree").applyInPandas(grow, "forest int, tree int, nodes array<double>")
        trees: dict[int, list] = {k: [] for k in sizes}
        # for each forest at most trees * 2 * sample nodes of four numbers
        for r in grown.orderBy("forest", "tree").collect():
            trees[r["forest"]].append(np.array(r["nodes"]).reshape(-1, 4))
        return {k: IsolationForestModel(self, trees[k], _mean_path(min(self.sample, n)), 0.0) for k, n in sizes.items()}


@dataclass(frozen=True)
class IsolationForestModel:
    config: IsolationForest
    forest: list
    norm: float
    offset: float

    def score(self, df: DataFrame, out: str = "score_if") -> DataFrame:
        """Adds the score less the contamination quantile: rows above 0 are the flagged share."""
        shared = df.sparkSession.sparkContext.broadcast([_walkable(nodes) for nodes in self.forest])
        norm, offset = self.norm, self.offset
        rows = df.withColumn("__x", self.config._matrix(df))

        @F.pandas_udf("double")
        def scored(xs: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=float)
            return pd.Series(np.power(2.0, -_mean_depth(shared.value, np.stack(xs.to_numpy())) / norm) - offset)

        return rows.withColumn(out, scored("__x")).drop("__x")


def _walkable(nodes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps to the deepest leaf, and per node its feature, its limit, both children side by side and a leaf's depth.

    A leaf is its own left child and no value is above its limit, so rows that have arrived stay.
    """
    feature, leaf = nodes[:, 0].astype(np.intp), nodes[:, 0] < 0
    own = np.arange(len(nodes))
    children = np.stack([np.where(leaf, own, nodes[:, 2]), np.where(leaf, own, nodes[:, 3])], axis=1).astype(np.intp)
    steps, level = 0, np.array([0])
    while not leaf[level].all():
        steps, level = steps + 1, children[level[~leaf[level]]].ravel()
    return steps, np.maximum(feature, 0), np.where(leaf, np.inf, nodes[:, 1]), children.ravel(), nodes[:, 1].copy()


def _mean_depth(forest: Sequence[tuple], data: np.ndarray) -> np.ndarray:
    """Mean over the trees of the depth of each row's leaf."""
    total, flat, first = np.zeros(len(data)), data.ravel(), np.arange(len(data)) * data.shape[1]
    for steps, feature, limit, children, depth in forest:
        at = np.zeros(len(data), dtype=np.intp)
        for _ in range(steps):
            right = flat.take(first + feature.take(at)) > limit.take(at)
            at = children.take(2 * at + right)
        total += depth.take(at)
    return total / len(forest)


def _mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + float(np.euler_gamma)) - 2.0 * (n - 1) / n


def out_of_fold_forest(df: DataFrame, fold: str, folds: int, row_id: str, forest: IsolationForest, out: str = "score_if") -> DataFrame:
    """Each row scored once by a forest grown on the other folds, also where its fold is beyond ``range(folds)``.

    One pass draws the samples of all forests and one scores every row by each of
    them: by its own fold's for the result, by the others for their offsets. Where no
    other fold has a row the score is null.
    """
    held = _fold_sizes(df, fold)
    if len(held) < 2:
        return df.withColumn(out, F.lit(None).cast("double"))
    sizes = {i: sum(held.values()) - n for i, n in enumerate(held.values())}
    number = F.array_position(F.array(*[F.lit(k).cast("long") for k in held]), F.col(fold).cast("long")).cast("int") - 1
    others = F.filter(F.array(*[F.lit(i) for i in sizes]), lambda i: i != number)
    rows = df.select(F.col(row_id).cast("string").alias("__id"), forest._matrix(df).alias("x"), others.alias("__for"))
    models = list(forest._grown(rows, sizes).values())
    shared = df.sparkSession.sparkContext.broadcast([([_walkable(nodes) for nodes in m.forest], m.norm) for m in models])

    @F.pandas_udf("array<double>")
    def scores(xs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype=object)
        data = np.stack(xs.to_numpy())
        return pd.Series(list(np.stack([np.power(2.0, -_mean_depth(trees, data) / norm) for trees, norm in shared.value], axis=1)))

    # the result and the offsets read them
    marked = cut(df.withColumn("__x", forest._matrix(df)).withColumn("__scores", scores("__x")).withColumn("__own", number).drop("__x"))
    every = marked.select("__own", F.posexplode("__scores").alias("__forest", "__s")).filter("__forest <> __own")
    found = contamination_threshold(every, "__s", forest.contamination, ["__forest"])
    offset = {r["__forest"]: r["threshold"] for r in found.select("__forest", "threshold").collect()}
    # none where a forest had a single row
    offsets = F.array(*[F.lit(offset.get(i)).cast("double") for i in sizes])
    return marked.withColumn(out, F.get("__scores", F.col("__own")) - F.get(offsets, F.col("__own"))).drop("__scores", "__own")


def conformal_margin(scores: DataFrame, score: str, alpha: float, keys: Sequence[str] = (), longest: int | None = None) -> DataFrame:
    """Quantile of the scores at ``min(1, ceil((n+1)(1-alpha))/n)`` per key.

    The level depends on the group size, so the scores are numbered and the two
    ranks around ``(n-1)*level`` read off.
    """
    keys = list(keys)
    base = scores if keys else scores.withColumn("__one", F.lit(1))
    by = keys or ["__one"]
    n = base.groupBy(*by).agg(F.count(score).alias("n"))
    ranked = order_rows(base.filter(F.col(score).isNotNull()), by, [score], idx="__i", longest=longest).df.join(n, by)
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"))
    h = (F.col("n") - 1) * level
    at = lambda r: F.max(F.when(F.col("__i") == r, F.col(score)))
    got = ranked.groupBy(*by, "n").agg(at(F.floor(h)).alias("a"), at(F.ceil(h)).alias("b"))
    return got.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * (h - F.floor(h))).alias("margin"), "n")


def mean_baseline(train: DataFrame, calibration: DataFrame, y: str, alpha: float) -> DataFrame:
    """One row: the training mean and the conformal half-width around it."""
    mean = train.agg(F.avg(y).alias("prediction"))
    resid = calibration.crossJoin(F.broadcast(mean)).select(F.abs(F.col(y) - F.col("prediction")).alias("e"))
    return mean.crossJoin(F.broadcast(conformal_margin(resid, "e", alpha).select("margin")))


def majority_baseline(train: DataFrame, klass: str, classes: Sequence[str]) -> DataFrame:
    """One row: share of the commonest class, the remainder spread equally over the others."""
    counts = train.groupBy(klass).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max_by(klass, F.struct("n", klass)).alias("major"), F.max("n").alias("n"), F.sum("n").alias("t"))
    share, rest = F.col("n") / F.col("t"), (1 - F.col("n") / F.col("t")) / max(1, len(classes) - 1)
    return top.select("major", F.array(*[F.when(F.col("major") == c, share).otherwise(rest) for c in classes]).alias("probabilities"))


def _vectors(df: DataFrame, columns: Sequence[str], out: str = "__fv") -> DataFrame:
    filled = F.array(*[F.coalesce(F.when(~F.isnan(c), F.col(c).cast("double")), F.lit(0.0)) for c in columns])
    return df.withColumn(out, MF.array_to_vector(filled))


@dataclass
class SeverityModel:
    """Forest whose leaves hold quantiles of the training severities, widened by a conformal margin."""

    columns: Sequence[str]
    alpha: float = 0.1
    trees: int = 50
    seed: int = 42
    levels: tuple[float, float, float] = (0.05, 0.5, 0.95)

    def fit(self, train: DataFrame, calibration: DataFrame, y: str) -> SeverityModel:
        known = _vectors(train.filter(F.col(y).isNotNull()), self.columns)
        forest = RandomForestRegressor(
            featuresCol="__fv", labelCol=y, numTrees=self.trees, maxDepth=5, minInstancesPerNode=3, seed=self.seed, leafCol="__leaf"
        )
        self._model = forest.fit(known)
        leaves = known.select(F.col(y).alias("__y"), "__fv")
        # a row's leaves stay one row; the quantiles, which read it twice, explode it in their tasks
        leaves = cut(self._model.transform(leaves).select("__y", MF.vector_to_array("__leaf").alias("__l"))).select("__y", F.posexplode("__l").alias("tree", "leaf"))
        table = quantiles(leaves, ["tree", "leaf"], "__y", {"lo": self.levels[0], "med": self.levels[1], "hi": self.levels[2]})
        # at most trees times 2^depth rows
        self._levels = _leaf_table(table.select("tree", "leaf", "lo", "med", "hi").collect(), self.trees)
        self._margin = 0.0
        raw = cut(self._raw(calibration.filter(F.col(y).isNotNull()).select(y, *[c for c in self.columns if c != y])))
        scores = raw.select(F.greatest(F.col("sev_lo") - F.col(y), F.col(y) - F.col("sev_hi")).alias("e"))
        got = conformal_margin(scores, "e", self.alpha).first()
        self._margin = float(got["margin"]) if got and got["margin"] is not None else 0.0
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        """Each level's mean over the trees, looked up by leaf in the row's own task."""
        levels = self._levels

        @F.pandas_udf("sev_lo double, sev_pred double, sev_hi double")
        def looked_up(leaf: pd.Series) -> pd.DataFrame:
            at = np.stack(leaf.to_numpy()).astype(np.int64) if len(leaf) else np.empty((0, levels.shape[0]), np.int64)
            return pd.DataFrame(np.nanmean(levels[np.arange(levels.shape[0]), at], axis=1), columns=["sev_lo", "sev_pred", "sev_hi"])

        got = self._model.transform(_vectors(df, self.columns)).select(*df.columns, looked_up(MF.vector_to_array("__leaf")).alias("__q"))
        return got.select(*df.columns, "__q.*")

    def predict(self, df: DataFrame, row: str) -> DataFrame:
        """Adds ``sev_pred``, ``sev_lo`` and ``sev_hi`` to the rows, which ``row`` identifies."""
        out = self._raw(df)
        return out.withColumn("sev_lo", F.col("sev_lo") - self._margin).withColumn("sev_hi", F.col("sev_hi") + self._margin)


def _leaf_table(rows: list, trees: int) -> np.ndarray:
    """Levels by tree and leaf."""
    out = np.full((trees, 1 + max((int(r["leaf"]) for r in rows), default=0), 3), np.nan)
    for r in rows:
        out[r["tree"], int(r["leaf"])] = r["lo"], r["med"], r["hi"]
    return out


@dataclass
class ClassModel:
    """Forest on balanced class weights, probabilities calibrated per class by isotonic regression."""

    columns: Sequence[str]
    classes: Sequence[str]
    trees: int = 50
    seed: int = 42

    def fit(self, train: DataFrame, calibration: DataFrame, klass: str) -> ClassModel:
        counts = {r[0]: r[1] for r in train.groupBy(klass).count().collect()}  # one row per class
        self._seen = [c for c in self.classes if c in counts]
        self._constant = self._seen[0] if len(self._seen) == 1 else (self.classes[0] if not self._seen else None)
        self._isotonic: dict[str, object] = {}
        if self._constant is not None:
            return self
        n = sum(counts[c] for c in self._seen)
        weight = F.lit(None).cast("double")
        label = F.lit(None).cast("double")
        for i, c in enumerate(self._seen):
            weight = F.when(F.col(klass) == c, n / (len(self._seen) * counts[c])).otherwise(weight)
            label = F.when(F.col(klass) == c, float(i)).otherwise(label)
        rows = _vectors(train.filter(F.col(klass).isin(self._seen)), self.columns).withColumn("__w", weight).withColumn("__y", label)
        self._model = RandomForestClassifier(
            featuresCol="__fv", labelCol="__y", weightCol="__w", numTrees=self.trees, maxDepth=5, seed=self.seed,
            probabilityCol="__prob", predictionCol="__pred", rawPredictionCol="__raw",
        ).fit(rows)
        present = {r[0] for r in calibration.select(klass).distinct().collect()}
        # a calibration set lacking a trained class leaves the raw probabilities
        if set(self._seen) <= present:
            raw = cut(self._raw(calibration).select(klass, "__p"))
            for i, c in enumerate(self._seen):
                one = raw.select(F.col("__p")[i].alias("p"), (F.col(klass) == c).cast("double").alias("hit"))
                self._isotonic[c] = fit_isotonic(one, "p", "hit")
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        got = self._model.transform(_vectors(df, self.columns)).withColumn("__p", MF.vector_to_array("__prob"))
        return got.drop("__fv", "__raw", "__prob", "__pred")

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``probabilities`` in the pinned class order (unseen classes 0), ``pred_type`` and ``pred_type_conf``."""
        if self._constant is not None:
            probs = F.array(*[F.lit(1.0 if c == self._constant else 0.0) for c in self.classes])
            out = df.withColumn("probabilities", probs)
        else:
            out = self._raw(df)
            cols = []
            for c in self.classes:
                if c not in self._seen:
                    cols.append(F.lit(0.0))
                    continue
                p = F.col("__p")[self._seen.index(c)]
                cols.append(isotonic_value(self._isotonic[c], p) if c in self._isotonic else p)
            arr = F.array(*cols)
            out = out.withColumn("probabilities", arr)
            total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
            even = F.array(*[F.lit(1.0 / len(self._seen) if c in self._seen else 0.0) for c in self.classes])
            out = out.withColumn("probabilities", F.when(total > 0, F.transform("probabilities", lambda p: p / total)).otherwise(even)).drop("__p")
        return out.withColumn("pred_type", argmax_class(F.col("probabilities"), self.classes)).withColumn("pred_type_conf", F.array_max("probabilities"))

    def importance(self, spark) -> DataFrame:
        values = [0.0] * len(self.columns) if self._constant is not None else self._model.featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.columns, [float(v) for v in values])), "feature string, importance double")


def fit_isotonic(df: DataFrame, x: str, y: str):
    """Non-decreasing fit of ``y`` on ``x``; equal ``x`` are averaged first, so the solver sees distinct values."""
    merged = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("__x")).agg(F.avg(y).alias("__y"), F.count(F.lit(1)).cast("double").alias("__w"))
    rows = VectorAssembler(inputCols=["__x"], outputCol="__v").transform(merged)
    return IsotonicRegression(featuresCol="__v", labelCol="__y", weightCol="__w").fit(rows)


def isotonic_value(model, x: Column) -> Column:
    """The fitted curve as a column: flat outside, linear between its knots."""
    xs, ys = model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()
    knots = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in zip(xs, ys)])
    lo = F.element_at(F.filter(knots, lambda k: k["x"] <= x), -1)
    hi = F.get(F.filter(knots, lambda k: k["x"] >= x), F.lit(0))
    between = lo["y"] + F.coalesce(safe_div(x - lo["x"], hi["x"] - lo["x"]), F.lit(0.0)) * (hi["y"] - lo["y"])
    has_lo, has_hi = x >= float(xs[0]), x <= float(xs[-1])
    return F.when(x.isNull(), F.lit(None).cast("double")).when(~has_lo, F.lit(float(ys[0]))).when(~has_hi, F.lit(float(ys[-1]))).otherwise(between)


def risk(indications: DataFrame, weight: Column) -> DataFrame:
    """Calibrated probability times severity times consequence; unknown severity gives no risk."""
    return indications.withColumn("risk_score", F.col("p_defect_cal") * F.col("sev_pred") * weight)


def fold_parts(df: DataFrame, fold: str, folds: int) -> list[tuple[int, DataFrame, DataFrame]]:
    """Number, training rows and held-out rows of every fold that holds any."""
    held = {r[0] for r in df.select(F.col(fold).cast("long")).distinct().collect()}
    at = F.col(fold).cast("long")
    return [(k, df.filter(at != k), df.filter(at == k)) for k in _fold_list(df, fold, folds) if k in held]


def split_for_calibration(dev: DataFrame, group: str, frac: float, seed: int, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Training and calibration rows, whole groups on one side; where too few groups leave no training rows, all rows train."""
    marked = cut(dev.join(calibration_split(dev, group, frac, seed, by=by), [*by, group]))
    train = marked.filter("not calibration").drop("calibration")
    if train.isEmpty():
        return marked.drop("calibration"), marked.drop("calibration").limit(0)
    return train, marked.filter("calibration").drop("calibration")


def predict_severity(dev: DataFrame, test: DataFrame, group: str, y: str, row: str, model: SeverityModel, frac: float, seed: int) -> DataFrame:
    """Intervals of the model and of the training mean for the rows of ``test``, one row per ``method``."""
    train, calibration = split_for_calibration(dev, group, frac, seed)
    fitted = SeverityModel(model.columns, model.alpha, model.trees, model.seed, model.levels).fit(train, calibration, y)
    got = fitted.predict(test, row).withColumn("method", F.lit("model"))
    margin = mean_baseline(train, calibration, y, model.alpha).select("margin")
    half = F.coalesce("margin", F.lit(0.0))
    # one row, also where nothing was left to calibrate with
    mean = train.agg(F.avg(y).alias("sev_pred")).join(margin, F.lit(True), "left").select("sev_pred", (F.col("sev_pred") - half).alias("sev_lo"), (F.col("sev_pred") + half).alias("sev_hi"))
    return got.unionByName(test.crossJoin(F.broadcast(mean)).withColumn("method", F.lit("baseline")))


def predict_classes(dev: DataFrame, test: DataFrame, group: str, klass: str, model: ClassModel, frac: float, seed: int) -> DataFrame:
    """Probabilities of the model and of the commonest class for the rows of ``test``, one row per ``method``."""
    train, calibration = split_for_calibration(dev, group, frac, seed, by=[klass])
    fitted = ClassModel(model.columns, model.classes, model.trees, model.seed).fit(train, calibration, klass)
    got = fitted.predict(test).withColumn("method", F.lit("model"))
    major = majority_baseline(train, klass, model.classes).select(
        "probabilities", F.col("major").alias("pred_type"), F.array_max("probabilities").alias("pred_type_conf")
    )
    return got.unionByName(test.crossJoin(F.broadcast(major)).withColumn("method", F.lit("baseline")))


def cross_validated_severity(df: DataFrame, fold: str, folds: int, group: str, y: str, row: str, model: SeverityModel, frac: float = 0.3) -> DataFrame:
    """Out-of-fold severity intervals; calibration groups are taken from the training side and share no object with it."""
    parts = None
    for k in range(folds):
        test, dev = df.filter(F.col(fold) == k), df.filter(F.col(fold) != k)
        if test.isEmpty():
            continue
        split = cut(calibration_split(dev, group, frac, model.seed + k))
        marked = dev.join(split, group)
        fitted = SeverityModel(model.columns, model.alpha, model.trees, model.seed, model.levels).fit(
            marked.filter("not calibration"), marked.filter("calibration"), y)
        got = fitted.predict(test, row)
        parts = got if parts is None else parts.unionByName(got)
    return parts


def cross_validated_classes(df: DataFrame, fold: str, folds: int, group: str, klass: str, model: ClassModel, frac: float = 0.3) -> DataFrame:
    """Out-of-fold classes; calibration groups are drawn inside each class."""
    parts = None
    for k in range(folds):
        test, dev = df.filter(F.col(fold) == k), df.filter(F.col(fold) != k)
        if test.isEmpty():
            continue
        split = cut(calibration_split(dev, group, frac, model.seed + k, by=[klass]))
        marked = dev.join(split, [klass, group])
        fitted = ClassModel(model.columns, model.classes, model.trees, model.seed).fit(marked.filter("not calibration"), marked.filter("calibration"), klass)
        got = fitted.predict(test)
        parts = got if parts is None else parts.unionByName(got)
    return parts


def permutation_importance(df: DataFrame, row: str, columns: Sequence[str], loss, seed: int) -> DataFrame:
    """Rise of a loss when one column is shuffled over the rows, per column.

    ``loss(df)`` returns a one-row frame with ``loss``. The shuffle pairs rows by
    two hash orders, so it is a join of numbered rows and no row is collected.
    """
    base = df.withColumn("__one", F.lit(1))
    whole, out = loss(df), None
    for c in columns:
        here = order_rows(base, ["__one"], [F.xxhash64(F.lit(seed), F.col(row)), F.col(row)], idx="__n").df
        there = order_rows(base.select("__one", row, c), ["__one"], [F.xxhash64(F.lit(seed + 1), F.col(row)), F.col(row)], idx="__n").df
        mixed = here.drop(c).join(there.select("__n", c), "__n").select(*df.columns)
        got = loss(mixed).select(F.lit(c).alias("feature"), F.col("loss").alias("__l")).crossJoin(whole).select("feature", (F.col("__l") - F.col("loss")).alias("importance"))
        out = got if out is None else out.unionByName(got)
    return out
