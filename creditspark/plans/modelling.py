"""Training jobs: single fits, out-of-fold scoring, search, ensembles, importances.

What crosses folds is in :mod:`creditspark.plans.folds`; here are the jobs made of it.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml import classification as C
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.functions.columns import weighted_mean
from creditspark.operators.align import append_rows, categorical_columns, numeric_columns, to_long
from creditspark.operators.encode import fit_levels, indicator_columns
from creditspark.operators.profile import CARDINALITY_THRESHOLD
from creditspark.operators.ranks import auc_from_counts, holdout_flag, roc_auc, stratified_folds
from creditspark.operators.stats import cv_stability
from creditspark.plans import boosting
from creditspark.plans.folds import FEATURES, ROWS_PER_TASK, SEED, WEIGHT, FoldRows, fold_means
from creditspark.session import in_threads, materialize
from creditspark.sources.files import class_one

FIT_TASKS = 8
ROWS_PER_FIT_TASK = 100_000
ROWS_IN_FITS = 8_000_000


# ---- inputs --------------------------------------------------------------------------------

def training_facts(df: DataFrame, columns: Sequence[str], label: str) -> tuple[list[str], list[str], dict]:
    """Columns with some NULLs, columns with nothing else, and rows per class, from one aggregate per class."""
    found = df.groupBy(label).agg(F.count("*").alias("n"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(columns)]).collect()
    rows = sum(r["n"] for r in found)
    known = [sum(r[f"k{i}"] for r in found) for i in range(len(columns))]
    return ([c for c, k in zip(columns, known) if 0 < k < rows], [c for c, k in zip(columns, known) if k == 0],
            {r[label]: r["n"] for r in found if r[label] is not None})


def add_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A ``<c>__missing`` column per listed column; trees then see missing as its own fact."""
    return df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in columns}) \
        if columns else df


def as_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns}) if columns else df


def vector_stages(columns: Sequence[str], flagged: Sequence[str]) -> list:
    """Median imputation in place (of every column: later rows may lack what training rows had), then one vector."""
    stages = []
    if columns:
        stages.append(Imputer(strategy="median", inputCols=list(columns), outputCols=list(columns)))
    inputs = [*columns, *[f"{c}__missing" for c in flagged]]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return stages


def with_class_weights(df: DataFrame, label: str, classes: Mapping) -> DataFrame:
    """Balanced row weights from the rows per class."""
    whole, weight = sum(classes.values()), F.lit(None).cast("double")
    for value, n in classes.items():
        weight = F.when(F.col(label) == F.lit(value), F.lit(whole / (len(classes) * n))).otherwise(weight)
    return df.withColumn(WEIGHT, weight)


class _ForestModel(C.RandomForestClassificationModel):
    @property
    def trees(self):
        return super().trees


class _BoostedModel(C.GBTClassificationModel):
    @property
    def trees(self):
        return super().trees


class RandomForestClassifier(C.RandomForestClassifier):
    """Spark's forest. Its models copy their trees to Python when asked for, not whenever their parameters are listed:
    thousands of calls to the JVM, in which fits of other threads wait."""

    def _create_model(self, java_model) -> _ForestModel:
        return _ForestModel(java_model)


class GBTClassifier(C.GBTClassifier):
    """Spark's boosted trees, with models that leave their trees in the JVM as those of the forest do."""

    def _create_model(self, java_model) -> _BoostedModel:
        return _BoostedModel(java_model)


def classifiers(label: str, trees: int = 100, rounds: int = 20, depth: int = 5, steps: int = 100) -> dict:
    """The model set, each weighted by class balance."""
    common = {"labelCol": label, "featuresCol": FEATURES, "weightCol": WEIGHT}
    return {
        "GradientBoosting": GBTClassifier(**common, maxIter=rounds, maxDepth=depth, seed=SEED),
        "RandomForest": RandomForestClassifier(**common, numTrees=trees, maxDepth=depth, seed=SEED),
        "Logistic": LogisticRegression(**common, maxIter=steps, regParam=0.01),
    }


def fit_tasks(rows: int) -> int:
    """Tasks that the stored rows of a tree fit are read by.

    A fit is a hundred jobs and more, each with a task per stored part: beyond ``FIT_TASKS`` parts their number grows by
    parts of ``ROWS_PER_FIT_TASK`` rows, so that a task's start and its statistics weigh little against its rows.
    """
    few = max(1, -(-rows // ROWS_PER_TASK))
    return few if few <= FIT_TASKS else max(FIT_TASKS, -(-rows // ROWS_PER_FIT_TASK))


def fits_at_once(rows: int, most: int = 8) -> int:
    """Fits run side by side: each keeps its rows in memory, about ``ROWS_IN_FITS`` in all, and two fill each other's gaps."""
    return max(2, min(most, ROWS_IN_FITS // max(1, rows)))


class Trainer:
    """Fits one classifier on prepared columns; what it learns about gaps comes from the rows it is given.

    ``encoded`` text columns become label means in cross-validation, learnt anew for each training set.
    """

    def __init__(self, classifier, columns: Sequence[str], label: str, encoded: Sequence[str] = ()):
        self.classifier, self.columns, self.label, self.encoded = classifier, list(columns), label, list(encoded)

    def fold_rows(self, df: DataFrame, key: str, folds: int = 5, repeats: int = 3, seed: int = SEED) -> FoldRows:
        return FoldRows.build(df, key, self.label, self.columns, self.encoded, folds, repeats, seed)

    def fit(self, df: DataFrame) -> FittedModel:
        columns = list(self.columns)
        typed = as_doubles(df.filter(F.col(self.label).isNotNull()), columns)
        flagged, empty, classes = training_facts(typed, columns, self.label)
        columns = [c for c in columns if c not in empty]
        rows = with_class_weights(add_flags(typed, flagged), self.label, classes)
        rows = rows.withColumn(self.label, F.col(self.label).cast("double"))
        vectors = Pipeline(stages=vector_stages(columns, flagged)).fit(rows)
        # stored once: a fit reads its rows several times, and would fill and gather all columns anew each time
        ready = vectors.transform(rows).select(self.label, WEIGHT, FEATURES)
        labelled = sum(classes.values())
        ready = materialize(ready.coalesce(fit_tasks(labelled)) if labelled > FIT_TASKS * ROWS_PER_TASK else ready)
        model = PipelineModel([*vectors.stages, self.classifier.fit(ready)])
        return FittedModel(model, columns, flagged)


class FittedModel:
    """A fitted pipeline with the columns it reads."""

    def __init__(self, model: PipelineModel, columns: list[str], flagged: list[str]):
        self.model, self.columns, self.flagged = model, columns, flagged

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(add_flags(as_doubles(df, self.columns), self.flagged))

    def probability(self, df: DataFrame, keep: Sequence[str], name: str = "p") -> DataFrame:
        return self.transform(df).select(*keep, class_one().alias(name))

    def importances(self) -> DataFrame:
        return model_importance([self.model.stages[-1]], self.feature_names(), SparkSession.active())

    def feature_names(self) -> list[str]:
        return [*self.columns, *[f"{c}__missing" for c in self.flagged]]


# ---- splits and out-of-fold scores ---------------------------------------------------------

def train_validation(df: DataFrame, key: str, seed: int = SEED, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    flag = holdout_flag(key, seed, percent)
    return df.filter(flag == 1), df.filter(flag == 0)


def out_of_fold(trainer: Trainer, df: DataFrame, key: str, folds: int = 5, repeats: int = 3,
                seed: int = SEED, parallelism: int = 8) -> DataFrame:
    """Held-out probability of every row in every repeat: key, label, repeat, fold, p."""
    return trainer.fold_rows(df, key, folds, repeats, seed).out_of_fold(trainer.classifier, parallelism)


def mean_out_of_fold(scores: DataFrame, key: str, label: str) -> DataFrame:
    """Probability averaged over repeats, with the 0.5 decision."""
    return scores.groupBy(key).agg(F.max(label).alias(label), F.avg("p").alias("p")) \
        .withColumn("predicted", (F.col("p") > 0.5).cast("int"))


def fold_scores(scores: DataFrame, label: str) -> DataFrame:
    """AUC of every (repeat, fold), all in one job."""
    return roc_auc(scores, "p", label, ["repeat", "fold"]).select("repeat", "fold", "auc")


def cross_validate(trainer: Trainer, df: DataFrame, key: str, folds: int = 5, repeats: int = 3,
                   seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold rows, and one summary row: overall AUC with fold mean, spread, interval and stability."""
    return summarize_scores(out_of_fold(trainer, df, key, folds, repeats, seed), key, trainer.label)


def summarize_scores(scores: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    mean = mean_out_of_fold(scores, key, label)
    overall = roc_auc(mean, "p", label).first()["auc"]
    stability = cv_stability(fold_scores(scores, label))
    return mean, stability.select(F.lit(overall).cast("double").alias("overall_auc"), "*")


def split_by_levels(df: DataFrame, keep: Sequence[str], threshold: float = CARDINALITY_THRESHOLD) -> tuple[list[str], list[str]]:
    """Text columns with at most ``threshold`` values, and the others; ``keep`` is left out."""
    texts = [c for c in categorical_columns(df) if c not in keep]
    if not texts:
        return [], []
    found = to_long(df, texts, kind="string").filter(F.col("value").isNotNull()).distinct().groupBy("column").count().collect()
    many = {r["column"] for r in found if r["count"] > threshold}
    return [c for c in texts if c not in many], [c for c in texts if c in many]


def spread(df: DataFrame, least: int = 1) -> DataFrame:
    """``df`` in tasks of at most about ``ROWS_PER_TASK`` rows: a small file of many rows is read as one partition, and
    what is stored from it would be read back by one task. Tables of one task's size stay as they are, or go into
    ``least`` tasks."""
    tasks = max(least, math.ceil(df.count() / ROWS_PER_TASK))
    return df.repartition(tasks) if tasks > 1 else df


def with_indicators(df: DataFrame, key: str, label: str, drop_first: bool, threshold: float = CARDINALITY_THRESHOLD,
                    carried: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """Key, label, numeric columns and dummies of text columns with few values, stored with the other text columns (and
    those ``carried``) as they are; and the names of both kinds."""
    low, high = split_by_levels(df, [key, label], threshold)
    numbers = [c for c in numeric_columns(df) if c not in (key, label)]
    made = indicator_columns(fit_levels(df, low), drop_first, [key, label, *numbers, *high])
    as_is = list(dict.fromkeys([*high, *[c for c in carried if c not in numbers]]))
    out = materialize(spread(df).select(key, label, *numbers, *made, *as_is))
    return out, [c for c in out.columns if c not in (key, label, *as_is)], high


def baseline(df: DataFrame, key: str, label: str, rounds: int = 20, folds: int = 5, repeats: int = 3,
             threshold: float = CARDINALITY_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Gradient boosting on raw numeric columns and first-dropped dummies.

    A text column of more than ``threshold`` values is one column of label means, learnt outside each held-out fold.
    """
    rows, columns, high = with_indicators(df, key, label, True, threshold)
    trainer = Trainer(classifiers(label, rounds=rounds)["GradientBoosting"], columns, label, high)
    return cross_validate(trainer, rows, key, folds, repeats)


def cross_fitted(df: DataFrame, columns: Sequence[str], key: str, label: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """Text ``columns`` as smoothed label means of the rows outside a row's own fold, for a single fit."""
    if not columns:
        return df
    placed = materialize(stratified_folds(df, key, label, folds, 1, seed).withColumn("folds", F.array("fold_0")))
    means = fold_means(placed, columns, label, folds, 1)
    own = {c: F.get(F.col(f"_means_{c}"), F.col("fold_0")).alias(c) for c in columns}
    return means.select(*[own.get(c, F.col(c)) for c in df.columns])


def score_table(rows: Sequence[tuple[str, str, float]], spark: SparkSession,
                stages: Sequence[str] = ("post_fe", "post_tuning")) -> DataFrame:
    """(model, stage, auc) results as one row per model and one column per stage."""
    long = spark.createDataFrame(list(rows), "model string, stage string, auc double")
    return long.groupBy("model").pivot("stage", list(stages)).agg(F.first("auc"))


# ---- search --------------------------------------------------------------------------------

def sample_params(classifier, space: Mapping[str, tuple], trials: int, seed: int = SEED) -> list[dict]:
    """Random parameter maps. A range is ("int", a, b), ("uniform", a, b), ("log", a, b) or ("choice", ...)."""
    draw = random.Random(seed)

    def one(spec: tuple):
        kind, *rest = spec
        if kind == "int":
            return draw.randint(*rest)
        if kind == "uniform":
            return draw.uniform(*rest)
        if kind == "log":
            return math.exp(draw.uniform(math.log(rest[0]), math.log(rest[1])))
        if kind == "choice":
            return draw.choice(rest)
        raise ValueError(f"unknown range {kind}")

    return [{classifier.getParam(name): one(spec) for name, spec in space.items()} for _ in range(trials)]


def shown(params: Mapping) -> str:
    return ", ".join(f"{p.name}={v:.6g}" if isinstance(v, float) else f"{p.name}={v}" for p, v in params.items())


def _trial_aucs(scores: DataFrame, label: str) -> dict[int, float]:
    """Mean AUC over folds of every trial."""
    per_fold = roc_auc(scores, "p", label, ["trial", "repeat", "fold"])
    return {r["trial"]: r["auc"] for r in per_fold.groupBy("trial").agg(F.avg("auc").alias("auc")).collect() if r["auc"] is not None}


def halving_search(rows: FoldRows, classifier, maps: Sequence[Mapping], budgets: Sequence[int] = (100,),
                   parallelism: int = 8, seed: int = SEED) -> dict[int, tuple[int, float]]:
    """Per trial, the largest budget (percent of the training rows) it was fitted on, and its AUC there.

    With one budget of 100, as in all registered queries, every trial is fitted on all training rows of every fold. Several
    budgets halve the trials: all start on the first one and one fold; the better half of them goes on to the next budget
    and all folds, and the last budget is all rows. Smaller budgets are parts of larger ones. Held-out folds are scored
    whole, and every fold's facts come from its own training rows. Logistic trials that differ in their penalty alone are
    fitted together on all rows at once.
    """
    reached: dict[int, tuple[int, float]] = {}
    alive = list(range(len(maps)))
    if isinstance(classifier, LogisticRegression) and {p.name for m in maps for p in m} <= {"regParam"}:
        penalties = [next(iter(m.values()), classifier.getRegParam()) for m in maps]
        found = rows.logistic_scores(list(rows.logistic(penalties, classifier.getMaxIter())))
        long = found.select(rows.label, "repeat", "fold", F.posexplode("p").alias("trial", "p"))
        return {t: (100, auc) for t, auc in _trial_aucs(long, rows.label).items()}
    for rung, percent in enumerate(budgets):
        sets = range(rows.sets) if rung or len(budgets) == 1 else range(1)
        part = None if percent >= 100 else holdout_flag(rows.key, seed, percent) == 1
        trials = [classifier.copy(maps[t]) for t in alive]
        if part is None and len(sets) == rows.sets and boosting.grow_together(trials):
            found = rows.boosted_scores(trials).select(rows.label, "repeat", "fold", F.posexplode("p").alias("place", "p"))
            scored = found.withColumn("trial", F.get(F.array(*map(F.lit, alive)), F.col("place")))
        else:
            def one(job: tuple[int, int]) -> DataFrame:
                trial, s = job
                model = classifier.copy(maps[trial]).fit(rows.training(s, part))
                return rows.held_out(s, model).withColumn("trial", F.lit(trial))

            scored = append_rows(*in_threads(rows.rows.sparkSession, one, [(t, s) for t in alive for s in sets], parallelism))
        aucs = _trial_aucs(materialize(scored), rows.label)
        reached.update({t: (percent, aucs[t]) for t in alive if t in aucs})
        alive = sorted((t for t in alive if t in aucs), key=lambda t: -aucs[t])
        alive = alive[:max(1, -(-len(alive) // 2))]
    return reached


def search_params(classifier, rows: FoldRows, space: Mapping[str, tuple], trials: int = 20,
                  budgets: Sequence[int] = (100,), parallelism: int = 8, seed: int = SEED) -> tuple[dict, DataFrame]:
    """Best parameters by mean cross-validated AUC over all trials, and one row per trial with the budget it reached."""
    maps = sample_params(classifier, space, trials, seed)
    found = halving_search(rows, classifier, maps, budgets, parallelism, seed)
    table = [(i, shown(m), *found.get(i, (None, None))) for i, m in enumerate(maps)]
    best = max(found, key=lambda t: (found[t][0], found[t][1], -t)) if found else 0
    return maps[best], rows.rows.sparkSession.createDataFrame(table, "trial int, params string, percent int, auc double")


def random_search(trainer: Trainer, df: DataFrame, key: str, space: Mapping[str, tuple], trials: int = 20,
                  folds: int = 3, parallelism: int = 8, seed: int = SEED,
                  budgets: Sequence[int] = (25, 50, 100)) -> tuple[FittedModel, DataFrame]:
    """The best trial fitted on all rows, and one row per trial; other than ``search_params``, it halves its trials unless
    ``budgets`` is one of 100."""
    params, table = search_params(trainer.classifier, trainer.fold_rows(df, key, folds, 1, seed), space, trials, budgets, parallelism, seed)
    return Trainer(trainer.classifier.copy(params), trainer.columns, trainer.label).fit(df), table


#: Ranges of the search, per model.
SPACES = {
    "GradientBoosting": {"maxIter": ("int", 10, 30), "maxDepth": ("int", 2, 5), "stepSize": ("log", 0.03, 0.3),
                         "subsamplingRate": ("uniform", 0.6, 1.0), "minInstancesPerNode": ("int", 1, 30)},
    "RandomForest": {"numTrees": ("int", 50, 150), "maxDepth": ("int", 3, 6), "subsamplingRate": ("uniform", 0.6, 1.0),
                     "featureSubsetStrategy": ("choice", "sqrt", "log2")},
    "Logistic": {"regParam": ("log", 1e-4, 10.0)},
}


def compare_models(rows: FoldRows, searching: FoldRows, models: Mapping[str, object], trials: int = 20,
                   spaces: Mapping[str, Mapping] = SPACES) -> tuple[DataFrame, dict[tuple[str, str], DataFrame]]:
    """Every model cross-validated on ``rows`` as first set up and after its search on ``searching``.

    Returns a table of overall AUCs (one row per model, one column per stage), and per (model, stage) the mean held-out
    probability of every row.
    """
    table, scores = [], {}
    for name, classifier in models.items():
        params, _ = search_params(classifier, searching, spaces[name], trials)
        for stage, chosen in (("post_fe", classifier), ("post_tuning", classifier.copy(params))):
            mean, summary = summarize_scores(rows.out_of_fold(chosen), rows.key, rows.label)
            scores[name, stage] = mean
            table.append((name, stage, summary.first()["overall_auc"]))
    return score_table(table, rows.rows.sparkSession), scores


# ---- ensembles -----------------------------------------------------------------------------

def soft_vote(cols: Sequence[str]) -> Column:
    return weighted_mean([1.0] * len(cols), cols)


def out_of_fold_models(rows: FoldRows, models: Mapping[str, object]) -> DataFrame:
    """Held-out probability of every model in one row per (row, repeat): key, label, repeat, fold, p_<model>."""
    out = None
    for name, classifier in models.items():
        scored = rows.out_of_fold(classifier).withColumnRenamed("p", f"p_{name}")
        out = scored if out is None else out.join(scored.select(rows.key, "repeat", f"p_{name}"), [rows.key, "repeat"])
    return materialize(out)


def voted(scores: DataFrame, key: str, label: str, columns: Sequence[str], steps: int = 10) -> tuple[DataFrame, list[float]]:
    """Mean held-out probabilities per row with the equal and the weighted vote, and the weights.

    The weights are the best on the simplex grid for the held-out means, so that no model is weighed on rows it has seen.
    """
    mean = materialize(scores.groupBy(key).agg(F.max(label).alias(label), *[F.avg(c).alias(c) for c in columns]))
    weights, _ = best_weights(mean, columns, label, steps)
    return mean.withColumns({"soft": soft_vote(columns), "weighted": weighted_mean(weights, columns)}), weights


def vote_stability(scores: DataFrame, label: str, columns: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Fold AUCs with spread, interval and tier, one row per model and vote."""
    every = scores.withColumns({"soft": soft_vote(columns), "weighted": weighted_mean(weights, columns)})
    long = to_long(every, [*columns, "soft", "weighted"], [label, "repeat", "fold"], name="model", value="p")
    return cv_stability(roc_auc(long, "p", label, ["model", "repeat", "fold"]), keys=["model"])


def weight_grid(models: int, steps: int) -> list[list[float]]:
    """All weight vectors in multiples of 1/steps that sum to 1."""
    out = []
    for bars in combinations(range(steps + models - 1), models - 1):
        edges = [-1, *bars, steps + models - 1]
        out.append([(b - a - 1) / steps for a, b in zip(edges, edges[1:])])
    return out


def weight_search(df: DataFrame, cols: Sequence[str], label: str, steps: int = 10) -> DataFrame:
    """AUC of every weight vector on the simplex grid, best first (equal weights win ties if listed)."""
    grid = weight_grid(len(cols), steps)
    # equal probability tuples collapse before the grid multiplies rows
    counts = df.filter(F.col(label).isin(0, 1)).groupBy(*cols).agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("n0"), F.count(F.when(F.col(label) == 1, 1)).alias("n1"))
    options = F.array(*[
        F.struct(F.lit(i).alias("candidate"), weighted_mean(w, cols).alias("value")) for i, w in enumerate(grid)])
    spread = (counts.select("n0", "n1", F.explode(options).alias("o"))
              .groupBy("o.candidate", "o.value").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
              .filter(F.col("value").isNotNull()))
    scores = auc_from_counts(spread, ["candidate"]).select("candidate", "auc")
    schema = ", ".join(["candidate int", "evenness double", *[f"w_{c} double" for c in cols]])
    table = df.sparkSession.createDataFrame(
        [(i, -sum((x - 1 / len(w)) ** 2 for x in w), *w) for i, w in enumerate(grid)], schema)
    return (scores.join(table, "candidate")
            .orderBy(F.desc_nulls_last("auc"), F.desc("evenness"), "candidate").drop("evenness"))


def best_weights(df: DataFrame, cols: Sequence[str], label: str, steps: int = 10) -> tuple[list[float], float]:
    top = weight_search(df, cols, label, steps).first()
    return [top[f"w_{c}"] for c in cols], top["auc"]


# ---- importances ---------------------------------------------------------------------------

def model_importance(models: Sequence[Transformer], names: Sequence[str], spark: SparkSession) -> DataFrame:
    """Mean importance per feature, highest first. Models without importances still count in the mean."""
    total = dict.fromkeys(names, 0.0)
    for model in models:
        if hasattr(model, "featureImportances"):
            values = model.featureImportances.toArray()
        elif hasattr(model, "coefficients"):
            values = abs(model.coefficients.toArray())
        else:
            continue
        for name, value in zip(names, values, strict=True):
            total[name] += float(value)
    rows = [(name, value / len(models)) for name, value in total.items()]
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature")


def forest_importance(df: DataFrame, key: str, label: str, trees: int = 100,
                      threshold: float = CARDINALITY_THRESHOLD) -> DataFrame:
    """Random-forest importance of numeric columns and all-level dummies after median imputation.

    A text column of more than ``threshold`` values is one column of label means outside each row's own fold, so that a
    value per row gains no importance by holding its own label.
    """
    rows, _, high = with_indicators(df, key, label, False, threshold)
    rows = cross_fitted(rows, high, key, label)
    columns = [c for c in rows.columns if c not in (key, label)]
    rows = as_doubles(rows, [*columns, label])
    _, empty, _ = training_facts(rows, columns, label)
    columns = [c for c in columns if c not in empty]
    stages = [*vector_stages(columns, []), RandomForestClassifier(labelCol=label, featuresCol=FEATURES, numTrees=trees, seed=SEED)]
    model = Pipeline(stages=stages).fit(rows)
    return model_importance([model.stages[-1]], columns, df.sparkSession)


def ensemble_importance(df: DataFrame, key: str, label: str, iterations: int = 5, trees: int = 100,
                        rounds: int = 20) -> DataFrame:
    """Importance averaged over two weighted tree models and several 80 % samples."""
    columns = [c for c in numeric_columns(df) if c not in (key, label)]
    typed = as_doubles(df, [*columns, label])
    _, empty, classes = training_facts(typed, columns, label)
    columns = [c for c in columns if c not in empty]
    rows = with_class_weights(typed, label, classes)
    vectors = Pipeline(stages=vector_stages(columns, [])).fit(rows).transform(rows)
    # every sample is read by two fits, several times each: which rows it holds is stored with them
    samples = [(holdout_flag(key, SEED + i) == 1).alias(f"_sample_{i}") for i in range(iterations)]
    labelled = sum(classes.values())
    ready = materialize(vectors.select(label, WEIGHT, FEATURES, *samples).coalesce(fit_tasks(labelled)))
    common = {"labelCol": label, "featuresCol": FEATURES, "weightCol": WEIGHT}

    def one(job: tuple[int, type, dict]) -> Transformer:
        i, kind, size = job
        return kind(**common, **size, seed=SEED + i).fit(ready.filter(F.col(f"_sample_{i}")))

    jobs = [(i, kind, size) for i in range(iterations) for kind, size in (
        (GBTClassifier, {"maxIter": rounds}), (RandomForestClassifier, {"numTrees": trees, "cacheNodeIds": True}))]
    models = in_threads(df.sparkSession, one, jobs, fits_at_once(labelled))
    return model_importance(models, columns, df.sparkSession)


