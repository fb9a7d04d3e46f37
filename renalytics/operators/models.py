"""Training, stacking, prediction and persistence.

* Three boosted-tree configurations ("leaf-wise", "symmetric", "level-wise") with the settings of the original: 300
  rounds, step 0.05, depth 6, their L1/L2 penalties, minimum rows or weight per leaf, leaf limit, row and column
  shares.  All fits that training and evaluation need (whole table, folds, folds inside folds) grow together in
  :mod:`.boosting` and become Spark ML models.
* A 300-tree random forest (depth 10, at least 2 rows per leaf), grown over the same blocks (:mod:`.forest`); a table that
  a task cannot hold goes to Spark ML's ``RandomForestClassifier``.
* Stacking: out-of-fold probabilities of the three boosted models feed a ``LogisticRegression`` with the original's
  unit L2 penalty; the whole ensemble is one ``PipelineModel``.

Ordered boosting, categorical statistics and a minimum number of rows per *split* of the forest are not built, so metric
parity with other engines is not claimed.
"""

from __future__ import annotations

import threading
import warnings
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..functions.spec import COHORT_SPEC, ColumnSpec
from ..session import shared_path
from . import boosting as B
from . import forest as FR
from .cells import with_probabilities
from .model_registry import Registry, exists
from .split import kfold_assign

SEED = fixed.RANDOM_STATE

# FIXED VALUES: settings of the boosted models in the order of the model list
BOOSTED = {
    "LightGBM": {"min_rows": 20, "l1": 0.1, "l2": 0.1, "row_share": 0.8, "column_share": 0.8, "max_leaves": 31},
    "CatBoost": {"l2": 3.0, "symmetric": True},
    "XGBoost": {"min_weight": 5.0, "l1": 0.1, "l2": 1.0, "row_share": 0.8, "column_share": 0.8},
}
ROUNDS, STEP, DEPTH, N_TREES = 300, 0.05, 6, 300
META_PENALTY = 1.0  # sum of losses plus half the squared weights

FOREST = "RandomForest"
TAGS = {"LightGBM": "lgbm", "CatBoost": "cat", "XGBoost": "xgb"}


def assembler(features: list[str], out: str = "features") -> VectorAssembler:
    """Feature vector in the training feature order."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def forest(n_trees: int = N_TREES, label: str = "label") -> RandomForestClassifier:
    """The random forest (M4).  Rows remember their node in each tree, so a pass over the rows does not walk every tree again."""
    return RandomForestClassifier(numTrees=n_trees, maxDepth=10, minInstancesPerNode=2, labelCol=label, seed=SEED, cacheNodeIds=True)


def fit_pipeline(train: DataFrame, feature_order: list[str], estimator) -> PipelineModel:
    return Pipeline(stages=[assembler(feature_order), estimator]).fit(train)


def plain(model: PipelineModel) -> PipelineModel:
    """The model without its training summary, by way of shared storage.

    A summary holds the session, which cannot be sent to tasks once it has observed metrics (:mod:`.observed`).
    """
    path = shared_path(SparkSession.active(), "fitted")
    model.write().save(path)
    return PipelineModel.load(path)


def with_folds(df: DataFrame, spec: ColumnSpec = COHORT_SPEC, k: int = fixed.CV_FOLDS) -> DataFrame:
    """``fold`` and, for the rows outside outer fold f, ``inner_<f>``: stratified folds of what is left of it.

    Both come from one rank within the class, so no second ranking is needed: without outer fold f the rank falls by the
    number of that fold's rows before it.
    """
    ranked = kfold_assign(df, k, spec, rank_col="fold_rank")

    def inner(f: int) -> Column:
        left = F.col("fold_rank") - F.floor((F.col("fold_rank") - f + k - 1) / k)
        return F.when(F.col("fold") == f, -1).otherwise(left % k).cast("int").alias(f"inner_{f}")

    return ranked.select("*", *[inner(f) for f in range(k)]).drop("fold_rank")


class Training:
    """One training run over a table of rows with label and folds; members are fitted once and kept in a registry.

    ``train`` has ``row_id``, the features, ``label`` (0/1) and the columns of :func:`with_folds`.
    """

    def __init__(self, train: DataFrame, features: list[str], registry: Registry, rounds: int = ROUNDS, n_trees: int = N_TREES,
                 label: str = "label", row_id: str = "row_id", k: int = fixed.CV_FOLDS):
        self.train, self.features, self.registry = train, list(features), registry
        self.rounds, self.n_trees, self.label, self.row_id, self.k = rounds, n_trees, label, row_id, k
        self._blocks_lock = threading.Lock()  # the forest and the boosted models grow at once

    def fits(self, inner: bool = False) -> list[B.Fit]:
        """Whole-table and fold fits, or the folds inside folds; fold columns are fold, inner_0, inner_1, ..."""
        out = []
        for name, settings in BOOSTED.items():
            common = {"rounds": self.rounds, "step": STEP, "depth": DEPTH, "seed": SEED} | settings
            if inner:
                out += [B.Fit(f"{name}-{f}-{j}", ((0, f), (1 + f, j)), **common) for f in range(self.k) for j in range(self.k)]
            else:
                out += [B.Fit(name, (), **common)] + [B.Fit(f"{name}-{f}", ((0, f),), **common) for f in range(self.k)]
        return out

    def thresholds(self) -> list[list[float]]:
        def make() -> DataFrame:
            found = B.fit_bins(self.train, self.features)
            return self.train.sparkSession.createDataFrame(list(enumerate(found)), "feature int, thresholds array<double>")
        return [list(r["thresholds"]) for r in self.registry.table("bins", make).orderBy("feature").collect()]

    def fold_columns(self) -> list[str]:
        return ["fold", *(f"inner_{f}" for f in range(self.k))]

    def blocks(self) -> DataFrame:
        """The training table as blocks, written once for all fits."""
        with self._blocks_lock:
            return self.registry.table("blocks", lambda: B.blocks(self.train, self.features, self.thresholds(), self.label, self.fold_columns(),
                                                                  self.row_id))

    def grown(self, inner: bool = False) -> DataFrame:
        """Trees and held-out margins of :meth:`fits`."""
        def make() -> DataFrame:
            return B.grow(self.blocks(), self.fits(inner), self.thresholds(), by_vector=True)
        return self.registry.table("boosted-inner" if inner else "boosted", make)

    def _held_out(self, line: str, keys: list[str], inner: bool) -> DataFrame:
        """(line, row_id, fold, label, p_<tag> ...) of the rows that the fits hold out; fits of one line hold out the same rows."""
        by_exclusion: dict[tuple, dict[str, B.Fit]] = {}
        for fit in self.fits(inner):
            if fit.exclude:
                name, number = fit.name.split("-")[:2]
                by_exclusion.setdefault((int(number), fit.exclude), {})[f"p_{TAGS[name]}"] = fit
        rows = B.held_out_rows(self.blocks(), self.grown(inner).where("tree = -1"), [(n, fits) for (n, _), fits in by_exclusion.items()])
        scores = [f"p_{t}" for t in TAGS.values()]
        rows = rows.where("row_id IS NOT NULL").select(F.col("line").alias(line), "row_id", "fold", "label", *[B.probability(c).alias(c) for c in scores])
        ids = F.col(self.row_id).alias("row_id")
        if self.train.where(F.col(self.row_id).isNotNull()).groupBy(ids).count().where("count > 1").isEmpty():
            return rows
        # Rows that share an id share the greatest of their scores.
        wide = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in scores])
        return self.train.select(ids, "fold", F.col(self.label).alias("label")).join(wide, "row_id")

    def held_out(self) -> DataFrame:
        """(row_id, fold, label, p_<tag> ...): out-of-fold probabilities of the boosted models."""
        return self.registry.table("held-out", lambda: self._held_out("line", ["row_id"], False).select(
            "row_id", "fold", "label", *[f"p_{t}" for t in TAGS.values()]))

    def held_out_inner(self) -> DataFrame:
        """(outer, row_id, label, p_<tag> ...): the same inside what is left of each outer fold."""
        return self.registry.table("held-out-inner", lambda: self._held_out("outer", ["outer", "row_id"], True).select(
            "outer", "row_id", *[f"p_{t}" for t in TAGS.values()], "label"))

    def _meta(self, rows: DataFrame):
        """[assembler, logistic regression] over base probabilities."""
        n = max(1, rows.count())
        stages = [VectorAssembler(inputCols=[f"p_{t}" for t in TAGS.values()], outputCol="meta_features"),
                  LogisticRegression(maxIter=1000, labelCol="label", featuresCol="meta_features", regParam=META_PENALTY / n, standardization=False)]
        return Pipeline(stages=stages).fit(rows)

    def _stacked(self) -> PipelineModel:
        bases = [self.model(n).stages[-1].copy() for n in BOOSTED]
        for m, tag in zip(bases, TAGS.values(), strict=True):
            m.setProbabilityCol(f"prob_{tag}").setRawPredictionCol(f"raw_{tag}").setPredictionCol(f"pred_{tag}")
        slices = [VectorSlicer(inputCol=f"prob_{t}", outputCol=f"p_{t}", indices=[1]) for t in TAGS.values()]
        return PipelineModel(stages=[assembler(self.features), *bases, *slices, *self._meta(self.held_out()).stages])

    def _boosted(self, name: str) -> PipelineModel:
        fit = next(f for f in self.fits() if f.name == name)
        trees = self.grown().where((F.col("fit") == name) & (F.col("tree") >= 0)).collect()  # bounded by the model
        model = B.as_spark_model(self.train.sparkSession, trees, self.thresholds(), fit, self.label)
        return PipelineModel(stages=[assembler(self.features), model])

    def _in_task(self) -> bool:
        """Whether the forest can grow over the blocks of the table; rows with gaps are refused as by the assembler."""
        gaps = self.train.where(" OR ".join(f"`{c}` IS NULL OR isnan(`{c}`)" for c in self.features)).count()
        if gaps:
            raise ValueError(f"{gaps} training rows have a NULL or NaN feature; impute them before the forest is fitted")
        return B.in_task(self.blocks())

    def _forest(self) -> PipelineModel:
        if not self._in_task():
            return fit_pipeline(self.train, self.features, forest(self.n_trees, self.label))
        fit = FR.Forest(FOREST, trees=self.n_trees, seed=SEED)
        model = FR.as_spark_model(FR.nodes(self.blocks(), fit, self.thresholds()), fit, len(self.features), self.label)
        return PipelineModel(stages=[assembler(self.features), model])

    def model(self, name: str) -> PipelineModel:
        """One of the five models, fitted on the whole table (M1-M5)."""
        make = {fixed.ENSEMBLE_NAME: self._stacked, FOREST: self._forest}
        return self.registry.model(name, make.get(name, lambda: self._boosted(name)))

    def models(self, names=tuple(fixed.MODEL_ORDER)) -> dict[str, PipelineModel]:
        """All models in order (M6); the forest is fitted while the boosted ones grow."""
        names = [n for n in fixed.MODEL_ORDER if n in names]
        with ThreadPoolExecutor(max_workers=2) as pool:
            side = pool.submit(self.model, FOREST) if FOREST in names else None
            done = {n: self.model(n) for n in names if n != FOREST}
            if side:
                done[FOREST] = side.result()
        return {n: done[n] for n in names}

    def fold_predictions(self, names=tuple(fixed.MODEL_ORDER)) -> DataFrame:
        """Held-out ``(model, row_id, fold, label, probability, prediction)`` of models refitted per fold (M8)."""
        parts = []
        if any(n in BOOSTED for n in names):
            wide = self.held_out()
            parts += [wide.select(F.lit(n).alias("model"), "row_id", "fold", "label", F.col(f"p_{TAGS[n]}").alias("probability"))
                      for n in names if n in BOOSTED]
        if FOREST in names:
            parts.append(self.registry.table("folds-forest", self._forest_folds))
        if fixed.ENSEMBLE_NAME in names:
            parts.append(self.registry.table("folds-stacking", self._stacking_folds))
        both = reduce(DataFrame.unionByName, parts)
        return both.withColumn("prediction", (F.col("probability") > fixed.DECISION_THRESHOLD).cast("int"))

    def _outside(self, f: int) -> tuple[tuple, Column]:
        """The rows that teach the fit of fold f: as exclusions of a block and as a condition."""
        return ((0, f),), F.col("fold") != f

    def _forest_folds(self) -> DataFrame:
        if self._in_task():
            fits = [FR.Forest(f"{FOREST}-{f}", self._outside(f)[0], trees=self.n_trees, seed=SEED) for f in range(self.k)]
            return FR.held_out(self.blocks(), fits, self.thresholds()).select(
                F.lit(FOREST).alias("model"), "row_id", F.split_part("fit", F.lit("-"), F.lit(2)).cast("int").alias("fold"), "label", "probability")
        with ThreadPoolExecutor(max_workers=self.k) as pool:
            fitted = list(pool.map(lambda f: fit_pipeline(self.train.where(self._outside(f)[1]), self.features, forest(self.n_trees, self.label)),
                                   range(self.k)))
        rows = [m.transform(self.train.where(F.col("fold") == f)) for f, m in enumerate(map(plain, fitted))]
        return reduce(DataFrame.unionByName, [r.select(
            F.lit(FOREST).alias("model"), F.col(self.row_id).alias("row_id"), "fold", F.col(self.label).alias("label"),
            vector_to_array("probability")[1].alias("probability")) for r in rows])

    def _stacking_folds(self) -> DataFrame:
        """Outer fold f: the meta model learns from inner out-of-fold rows, the bases are those fitted without fold f."""
        inner, outer = self.held_out_inner(), self.held_out()
        with ThreadPoolExecutor(max_workers=self.k) as pool:
            metas = list(pool.map(lambda f: self._meta(inner.where(F.col("outer") == f)), range(self.k)))
        return reduce(DataFrame.unionByName, [m.transform(outer.where(F.col("fold") == f)).select(
            F.lit(fixed.ENSEMBLE_NAME).alias("model"), "row_id", "fold", "label", vector_to_array("probability")[1].alias("probability"))
            for f, m in enumerate(map(plain, metas))])


class InFoldTraining(Training):
    """Cross-validation of the four single models with oversampling inside each fold (M8 option).

    ``train`` has ``row_id``, features, label, ``fold``, ``for_fold`` and ``skip_<f>``, as :func:`in_fold_table` makes
    them: real rows take part in every fit but that of their fold, synthetic ones only in the fit they were made for, and
    only real rows are held out.  The stacked model would need synthetic rows inside inner folds and is refused.
    """

    def fits(self, inner: bool = False) -> list[B.Fit]:
        if inner:
            raise ValueError("oversampling inside folds has no inner folds")
        return [B.Fit(f"{name}-{f}", ((1 + f, 1), (0, f)), **({"rounds": self.rounds, "step": STEP, "depth": DEPTH, "seed": SEED} | settings))
                for name, settings in BOOSTED.items() for f in range(self.k)]

    def fold_columns(self) -> list[str]:
        return ["fold", *(f"skip_{f}" for f in range(self.k))]

    def grown(self, inner: bool = False) -> DataFrame:
        return self.registry.table("boosted-in-fold", lambda: B.grow(self.blocks(), self.fits(inner), self.thresholds(), by_vector=True))

    def _outside(self, f: int) -> tuple[tuple, Column]:
        return ((1 + f, 1), (0, f)), (F.col(f"skip_{f}") == 0) & (F.col("fold") != f)

    def fold_predictions(self, names=(*BOOSTED, FOREST)) -> DataFrame:
        if fixed.ENSEMBLE_NAME in names:
            raise ValueError("the stacked model is not built with oversampling inside folds")
        return super().fold_predictions(names)


def in_fold_table(real: DataFrame, synthetic: DataFrame, features: list[str], k: int = fixed.CV_FOLDS) -> DataFrame:
    """Rows for :class:`InFoldTraining` from real rows (row_id, features, label, fold) and synthetic ones (for_fold, ...).

    Synthetic rows get ids below 0 that no other row has, and fold -1, so that none is ever held out.
    """
    rows = real.select("row_id", *features, "label", "fold", F.lit(-1).alias("for_fold")).unionByName(
        synthetic.select((-(F.col("synthetic_id") * k + F.col("for_fold") + 1)).alias("row_id"), *features, "label",
                         F.lit(-1).alias("fold"), "for_fold"))
    return rows.select("*", *[((F.col("for_fold") >= 0) & (F.col("for_fold") != f)).cast("int").alias(f"skip_{f}") for f in range(k)])


def predict(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Probability of class 1 and class at 0.5 (M9); works on batch and streams."""
    return with_probabilities(df, {"__p": model}).select(*keep, F.col("__p").alias("probability")) \
        .withColumn("prediction", (F.col("probability") > fixed.DECISION_THRESHOLD).cast("int"))


def predictions_long(models: dict[str, PipelineModel], df: DataFrame, keep: list[str]) -> DataFrame:
    """One long table ``(model, keep..., probability, prediction)`` for evaluation.

    The models run one after another over the same rows; each leaves its probability as one column.
    """
    probs = {f"__p{i}": m for i, m in enumerate(models.values())}
    scored = F.array(*[F.struct(F.col(p).alias("probability"),
                                (F.col(p) > fixed.DECISION_THRESHOLD).cast("int").alias("prediction"),
                                F.lit(name).alias("model")) for name, p in zip(models, probs)])
    return with_probabilities(df, probs).select(*keep, F.inline(scored))


def save_models(models: dict[str, PipelineModel], base_path: str) -> None:
    """Persist every model directory (A7); the feature order lives in the assembler."""
    for name, m in models.items():
        m.write().overwrite().save(f"{base_path.rstrip('/')}/{name.lower()}")


def load_models(spark, base_path: str, names=fixed.MODEL_ORDER) -> dict[str, PipelineModel]:
    """Load the saved models that exist; missing ones are skipped with a warning."""
    out = {}
    for name in names:
        path = f"{base_path.rstrip('/')}/{name.lower()}"
        if exists(spark, path):
            out[name] = PipelineModel.load(path)
        else:
            warnings.warn(f"Model not found: {path}")
    return out


def feature_order(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def feature_importance(spark, model: PipelineModel, decimals: int = 6) -> DataFrame | None:
    """Ordered feature importances with display names (X10); None when absent."""
    tree = model.stages[1]
    if not hasattr(tree, "featureImportances"):
        return None
    names = feature_order(model)
    imp = tree.featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(names, imp)), "feature string, importance double")
    return df.select("feature", X.display_name_expr("feature").alias("display_name"),
                     X.round_half_up("importance", decimals).alias("importance"))
