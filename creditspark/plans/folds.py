"""Cross-validation in which everything learnt comes from training rows, for all training sets at once.

With ``repeats`` x ``folds`` there are as many training sets, each the rows outside one fold. Counts, sums and
histograms are kept per fold; those of a training set are the total minus its fold, so one pass serves all sets:

* label means of text columns: a table (column, value, repeat, fold) of rows and label sums. A held-out row is encoded
  from all folds but its own; a training row from all folds but its own and the held-out one, so that no row's own label
  and no held-out label is in any encoding, whatever the number of values;
* gaps, medians, class weights and scales from one pass over the rows;
* logistic regression: one pass an iteration gives loss, gradient and curvature of every set. What a task holds grows with
  sets x columns squared and not with rows.

Boosted trees of all sets grow side by side in :mod:`creditspark.plans.boosting`. Other tree models are fitted one set at a
time by Spark ML, on the same stored rows and facts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.operators.align import append_rows, to_long
from creditspark.operators.joins import lookup_join, measured_bytes
from creditspark.operators.ranks import stratified_folds
from creditspark.plans import boosting
from creditspark.session import in_threads, materialize
from creditspark.sources.files import class_one

SEED = 98
CUTS = 1000
ROWS_PER_TASK = 20_000
WEIGHT = "_weight"
FEATURES = "_features"
CLASSES = (0.0, 1.0)


# ---- label means per fold ------------------------------------------------------------------

def fold_sums(df: DataFrame, columns: Sequence[str], label: str, folds: str = "folds") -> DataFrame:
    """Labelled rows ``n`` and ``label_sum`` per (column, value, repeat, fold); ``folds`` holds a row's fold per repeat."""
    long = to_long(df, columns, [label, folds], "string")
    placed = long.select("column", "value", label, F.posexplode(folds).alias("repeat", "fold"))
    return placed.groupBy("column", "value", "repeat", "fold").agg(
        F.count(label).alias("n"), F.sum(F.col(label).cast("double")).alias("label_sum"))


def _dense(sums: DataFrame, sets: int, folds: int) -> DataFrame:
    """One row per (column, value): totals, and lists of rows and label sums by ``repeat * folds + fold``."""
    slot = F.col("repeat") * folds + F.col("fold")
    known = sums.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.map_from_entries(F.collect_list(F.struct(slot, F.struct("n", "label_sum")))).alias("by"),
        F.sum(F.when(F.col("repeat") == 0, F.col("n"))).alias("n_all"),
        F.sum(F.when(F.col("repeat") == 0, F.col("label_sum"))).alias("y_all"))
    slots = F.array(*[F.lit(s) for s in range(sets)])
    get = lambda name: F.transform(slots, lambda s: F.coalesce(F.try_element_at("by", s)[name].cast("double"), F.lit(0.0)))
    return known.select("column", "value", F.col("n_all").cast("double"), "y_all", get("n").alias("n_by"), get("label_sum").alias("y_by"))


def _means(folds: int, priors: Sequence[float], m: float, row_folds: str, entry: Mapping[str, Column]) -> Column:
    """Encoding of a row for every training set, as an array; unknown values get the set's overall mean."""
    slots = F.array(*[F.lit(s) for s in range(len(priors))])
    known_priors = F.array(*[F.lit(float(p)) for p in priors])

    def one(s: Column) -> Column:
        repeat = F.floor(s / folds).cast("int")
        own = repeat * folds + F.get(F.col(row_folds), repeat)
        prior = F.get(known_priors, s)

        def left(whole: Column, by: Column) -> Column:
            return whole - F.get(by, s) - F.when(own == s, 0.0).otherwise(F.get(by, own))

        n, y = left(entry["n_all"], entry["n_by"]), left(entry["y_all"], entry["y_by"])
        return F.coalesce(F.try_divide(y + m * prior, n + m), prior)

    return F.transform(slots, one)


def fold_priors(sums: DataFrame, sets: int, folds: int) -> list[float]:
    """Label mean of every training set; any column covers all rows."""
    first = sums.select(F.min("column")).first()[0]
    found = sums.filter(F.col("column") == first).groupBy("repeat", "fold").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum("label_sum"), F.lit(0.0)).alias("y")).collect()
    by = {r["repeat"] * folds + r["fold"]: (r["n"], r["y"]) for r in found}
    out = []
    for s in range(sets):
        others = [by.get(o, (0, 0.0)) for o in range(s - s % folds, s - s % folds + folds) if o != s]
        n, y = sum(o[0] for o in others), sum(o[1] for o in others)
        out.append(y / n if n else 0.0)
    return out


def fold_means(df: DataFrame, columns: Sequence[str], label: str, folds: int, repeats: int, m: float = 1.0,
               row_folds: str = "folds", prefix: str = "_means_") -> DataFrame:
    """Add ``<prefix><c>`` per column: the row's label mean for each training set, repeat by repeat and fold by fold.

    Means are smoothed by ``m`` rows of the set's overall mean, which also stands for unknown values.
    """
    if not columns:
        return df
    sets = folds * repeats
    sums = materialize(fold_sums(df, columns, label, row_folds))
    priors = fold_priors(sums, sets, folds)
    table = materialize(_dense(sums, sets, folds))
    out = df
    for c in columns:
        names = {x: f"_{x}_{c}" for x in ("n_all", "y_all", "n_by", "y_by")}
        own = table.filter(F.col("column") == c).select(
            F.col("value").alias(f"_value_{c}"), *[F.col(x).alias(name) for x, name in names.items()])
        size = measured_bytes(own) + own.count() * 16 * sets
        out = lookup_join(out.withColumn(f"_value_{c}", F.col(c).cast("string")), own, f"_value_{c}", size=size)
        mean = _means(folds, priors, m, row_folds, {x: F.col(name) for x, name in names.items()})
        out = out.withColumn(f"{prefix}{c}", mean).drop(f"_value_{c}", *names.values())
    return out


# ---- rows ready for all sets ---------------------------------------------------------------

@dataclass
class Facts:
    """What every training set knows: counts, medians, weights, and mean and deviation of every prepared column."""

    medians: np.ndarray
    gaps: list[int]
    flagged: np.ndarray
    empty: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


class FoldRows:
    """Stored rows: key, label, ``folds``, fixed columns ``x`` (NaN for NULL) and, per training set, varying columns ``v``."""

    def __init__(self, rows: DataFrame, key: str, label: str, fixed: list[str], varying: list[str], folds: int, repeats: int):
        self.rows, self.key, self.label, self.fixed, self.varying = rows, key, label, fixed, varying
        self.folds, self.repeats, self.sets = folds, repeats, folds * repeats
        self._facts: Facts | None = None
        self._cuts_of_sets: dict[tuple[int, int], list[list[np.ndarray]]] = {}

    @classmethod
    def build(cls, df: DataFrame, key: str, label: str, columns: Sequence[str], encoded: Sequence[str] = (),
              folds: int = 5, repeats: int = 3, seed: int = SEED, m: float = 1.0,
              risks: Sequence[str] = (), varying: Mapping[str, Column] | None = None) -> FoldRows:
        """``encoded`` text columns become label means per training set; ``varying`` adds expressions over ``risks``.

        An expression sees each column ``c`` of ``risks`` as the array ``_risk_c`` of plain label means per training set,
        and gives an array of the same length. It takes the place of a fixed column of its name; its nulls count 0.
        """
        varying = dict(varying or {})
        columns = [c for c in columns if c not in varying]
        placed = stratified_folds(df, key, label, folds, repeats, seed)
        placed = placed.withColumn("folds", F.array(*[F.col(f"fold_{r}") for r in range(repeats)]))
        if encoded or risks:
            placed = materialize(placed)
        placed = fold_means(placed, encoded, label, folds, repeats, m)
        placed = fold_means(placed, risks, label, folds, repeats, 0.0, prefix="_risk_")
        number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
        filled = {c: F.transform(a, lambda x: F.coalesce(x, F.lit(0.0))) for c, a in varying.items()}
        arrays = {**{c: F.col(f"_means_{c}") for c in encoded}, **filled}
        empty = F.array().cast("array<double>")
        rows = placed.select(
            key, F.col(label).cast("double").alias(label), "folds",
            (F.array(*[number(c) for c in columns]) if columns else empty).alias("x"),
            (F.concat(*arrays.values()) if arrays else empty).alias("v"))
        return cls(materialize(rows), key, label, columns, list(arrays), folds, repeats)

    # ---- facts

    def facts(self) -> Facts:
        """Medians, gaps, weights and scales of every training set, from two passes over the rows."""
        if self._facts is None:
            cuts, shift = self._cuts()
            total = _total(self.rows.mapInArrow(self._counter(cuts, shift), "part binary"))
            self._facts = self._read_facts(total, cuts, shift)
        return self._facts

    def _cuts(self) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """Places to count at, per column with gaps, and a middle of every column, from one pass."""
        d = len(self.fixed)
        if not d:
            return {}, np.zeros(0)
        value = lambda i: F.nanvl(F.col("x")[i], F.lit(None).cast("double"))
        gaps = [F.count(F.when(F.isnan(F.col("x")[i]), 1)).alias(f"g{i}") for i in range(d)]
        middle = [F.avg(value(i)).alias(f"m{i}") for i in range(d)]
        found = self.rows.agg(*gaps, *middle).first()
        holed = [i for i in range(d) if found[f"g{i}"]]
        names = [f"c{i}" for i in holed]
        probs = [i / CUTS for i in range(CUTS + 1)]
        cuts = self.rows.select(*[value(i).alias(n) for i, n in zip(holed, names)]).approxQuantile(names, probs, 0.5 / CUTS) if holed else []
        return ({i: np.unique(c) for i, c in zip(holed, cuts)},
                np.array([found[f"m{i}"] if found[f"m{i}"] is not None else 0.0 for i in range(d)]))

    def _counter(self, cuts: dict[int, np.ndarray], shift: np.ndarray):
        sets, folds, repeats, d, h = self.sets, self.folds, self.repeats, len(self.fixed), len(self.varying)
        label, steps = self.label, sum(len(c) for c in cuts.values())

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, moments = np.zeros((sets, 2)), np.zeros((3, sets, 2, d))
            counts, varying = np.zeros((sets, steps)), np.zeros((2, sets, 2, h))
            for batch in batches:
                y, f, x, v = _arrays(batch, label, d, h, sets)
                known = ~np.isnan(x)
                centred = np.where(known, x - shift, 0.0)
                powers = [known.astype(float), centred, centred * centred]
                at = [(np.searchsorted(c, x[:, i], "left"), known[:, i]) for i, c in cuts.items()]
                for r in range(repeats):
                    for k in range(folds):
                        s, fold = r * folds + k, f[:, r] == k
                        start = 0
                        for (place, there), c in zip(at, cuts.values()):
                            counts[s, start:start + len(c)] += np.bincount(
                                np.minimum(place[fold & there], len(c) - 1), minlength=len(c))
                            start += len(c)
                        for o, value in enumerate(CLASSES):
                            held = (fold & (y == value)).astype(float)
                            rows[s, o] += held.sum()
                            for p, power in enumerate(powers):
                                moments[p, s, o] += held @ power
                            # varying columns differ from set to set, so their sums are over the training rows
                            if h:
                                train = (~fold & (y == value)).astype(float)
                                varying[0, s, o] += train @ v[:, :, s]
                                varying[1, s, o] += train @ (v[:, :, s] ** 2)
            yield _part(rows, moments, counts, varying)

        return count

    def _read_facts(self, total: np.ndarray, cuts: dict[int, np.ndarray], shift: np.ndarray) -> Facts:
        sets, folds, d, h = self.sets, self.folds, len(self.fixed), len(self.varying)
        steps = sum(len(c) for c in cuts.values())
        shapes = [(sets, 2), (3, sets, 2, d), (sets, steps), (2, sets, 2, h)]
        edges = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
        rows, moments, counts, varying = (total[a:b].reshape(s) for a, b, s in zip(edges, edges[1:], shapes))

        def outside(by_fold: np.ndarray, axis: int) -> np.ndarray:
            """Per training set, the sum over the other folds of its repeat."""
            moved = np.moveaxis(by_fold, axis, 0).reshape(self.repeats, folds, -1)
            left = moved.sum(1, keepdims=True) - moved
            return np.moveaxis(left.reshape(sets, *np.moveaxis(by_fold, axis, 0).shape[1:]), 0, axis)

        rows, moments, counts = outside(rows, 0), outside(moments, 1), outside(counts, 0)
        whole = rows.sum(1)
        present = (rows > 0).sum(1)
        weights = np.divide(whole[:, None], present[:, None] * rows, out=np.zeros_like(rows), where=rows > 0)
        known = moments[0].sum(1)
        medians, start = np.full((sets, d), np.nan), 0
        for i, c in cuts.items():
            below = counts[:, start:start + len(c)].cumsum(1)
            place = (below >= np.ceil(below[:, -1:] / 2)).argmax(1) if len(c) else np.zeros(sets, int)
            if len(c):
                medians[:, i] = np.where(below[:, -1] > 0, c[place], np.nan)
            start += len(c)
        empty = known == 0
        gaps = list(cuts)
        flagged = (known < whole[:, None])[:, gaps] & ~empty[:, gaps]

        # weighted moments of filled columns, flags and varying columns
        filled = np.nan_to_num(medians - shift)[:, None, :]
        missing = rows[:, :, None] - moments[0]
        first = moments[1] + missing * filled
        second = moments[2] + missing * filled * filled
        flags = missing[:, :, gaps]
        first = np.concatenate([first, flags, varying[0]], 2)
        second = np.concatenate([second, flags, varying[1]], 2)
        total_weight = (weights * rows).sum(1)[:, None]
        mean = np.divide((weights[:, :, None] * first).sum(1), total_weight, out=np.zeros((sets, first.shape[2])), where=total_weight > 0)
        spread = (weights[:, :, None] * second).sum(1) - total_weight * mean * mean
        squares = (weights ** 2 * rows).sum(1)[:, None]
        freedom = total_weight - np.divide(squares, total_weight, out=np.zeros_like(squares), where=total_weight > 0)
        variance = np.divide(spread, freedom, out=np.zeros_like(spread), where=freedom > 0)
        deviation = np.sqrt(np.where(variance > 1e-13 * (mean * mean + 1e-300), variance, 0.0))
        off = np.concatenate([empty, ~flagged, np.zeros((sets, h), bool)], 1)
        deviation[off] = 0.0
        mean[:, :d] += shift
        return Facts(medians, gaps, flagged, empty, rows, weights, mean, deviation)

    # ---- logistic regression, all sets at once

    def logistic(self, penalties: Sequence[float] = (0.01,), iterations: int = 100, tolerance: float = 1e-9) -> np.ndarray:
        """Coefficients (penalty, set, intercept and scaled columns) of weighted, penalised logistic models.

        Newton steps, halved where the loss would rise; every iteration reads the rows once for all models. The penalty is
        on scaled columns and not on the intercept, as in Spark's own estimator.
        """
        facts, wide = self.facts(), len(self.fixed) + len(self.facts().gaps) + len(self.varying)
        models, q = len(penalties) * self.sets, wide + 1
        penalty = np.repeat(np.array(penalties, float), self.sets)[:, None] * np.array([0.0, *[1.0] * wide])
        best, step, scale = np.zeros((models, q)), np.zeros((models, q)), np.ones(models)
        loss, open_models = np.full(models, np.inf), np.ones(models, bool)
        for _ in range(iterations):
            trial = best + scale[:, None] * step
            told = _total(self.rows.mapInArrow(self._curvature(facts, trial, open_models), "part binary"))
            told = told.reshape(int(open_models.sum()), 1 + q + q * q)
            for at, j in enumerate(np.flatnonzero(open_models)):
                now = told[at, 0] + 0.5 * penalty[j] @ (trial[j] ** 2)
                if now > loss[j] + 1e-12 * abs(loss[j]) and scale[j] > 1e-8:
                    scale[j] /= 2
                    continue
                gain, loss[j], best[j], scale[j] = loss[j] - now, now, trial[j], 1.0
                slope = told[at, 1:1 + q] + penalty[j] * trial[j]
                bend = told[at, 1 + q:].reshape(q, q) + np.diag(penalty[j] + 1e-12)
                step[j] = -np.linalg.lstsq(bend, slope, rcond=None)[0]
                if gain <= tolerance * max(1.0, abs(now)) * 1e-3 or np.abs(slope).max() < tolerance:
                    open_models[j] = False
            if not open_models.any():
                break
        return best.reshape(len(penalties), self.sets, q)

    def _curvature(self, facts: Facts, trial: np.ndarray, open_models: np.ndarray):
        sets, folds, label, d, h = self.sets, self.folds, self.label, len(self.fixed), len(self.varying)
        totals = (facts.weights * facts.rows).sum(1)

        def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = trial.shape[1]
            chosen = np.flatnonzero(open_models)
            out = np.zeros((len(chosen), 1 + q + q * q))
            for batch in batches:
                y, f, x, v = _arrays(batch, label, d, h, sets)
                for s in np.unique(chosen % sets):
                    train = f[:, s // folds] != s % folds
                    z = _scaled(facts, s, x[train], v[train][:, :, s])
                    truth = y[train]
                    w = np.where(truth == 1, facts.weights[s, 1], facts.weights[s, 0]) / totals[s]
                    for at in np.flatnonzero(chosen % sets == s):
                        margin = z @ trial[chosen[at]]
                        p = _sigmoid(margin)
                        out[at, 0] += w @ (np.logaddexp(0, margin) - truth * margin)
                        out[at, 1:1 + q] += z.T @ (w * (p - truth))
                        out[at, 1 + q:] += (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()
            yield _part(out)

        return curve

    def logistic_scores(self, coefficients: Sequence[np.ndarray]) -> DataFrame:
        """Held-out rows with a probability per model in array ``p``; ``coefficients`` has (set, column) for each model."""
        facts = self.facts()

        def score(s: int, x: np.ndarray, v: np.ndarray) -> np.ndarray:
            z = _scaled(facts, s, x, v)
            return np.stack([_sigmoid(z @ c[s]) for c in coefficients], 1)

        return self._scores(score, len(coefficients))

    def _scores(self, probabilities: Callable[[int, np.ndarray, np.ndarray], np.ndarray], models: int) -> DataFrame:
        """Held-out rows with array ``p``: ``probabilities`` of a set's fixed and varying columns, one column per model."""
        sets, folds, repeats = self.sets, self.folds, self.repeats
        label, key, d, h = self.label, self.key, len(self.fixed), len(self.varying)
        kind = self.rows.schema[key].dataType.simpleString()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, f, x, v = _arrays(batch, label, d, h, sets)
                for r in range(repeats):
                    p = np.zeros((len(y), models))
                    for k in range(folds):
                        held, s = f[:, r] == k, r * folds + k
                        if held.any():
                            p[held] = probabilities(s, x[held], v[held][:, :, s])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(key), pa.array(y), pa.array(np.full(len(y), r, np.int32)), pa.array(f[:, r].astype(np.int32)),
                         pa.array(list(p), pa.list_(pa.float64()))], ["key", "label", "repeat", "fold", "p"])

        scored = self.rows.mapInArrow(score, f"key {kind}, label double, repeat int, fold int, p array<double>")
        return scored.withColumnsRenamed({"key": key, "label": label})

    # ---- boosted trees, all sets at once

    def boosted_scores(self, classifiers: Sequence[GBTClassifier]) -> DataFrame:
        """Held-out rows with a probability per boosted model in array ``p``; all models find their cuts with one seed."""
        facts, sets, folds = self.facts(), self.sets, self.folds
        label, d, h = self.label, len(self.fixed), len(self.varying)
        first = classifiers[0]
        kind = first.getMaxBins(), first.getSeed()
        if kind not in self._cuts_of_sets:
            self._cuts_of_sets[kind] = in_threads(
                self.rows.sparkSession, lambda s: boosting.spark_cuts(first.copy(), self.training(s)), range(sets))
        cuts = dict(enumerate(self._cuts_of_sets[kind]))
        models = [[boosting.booster(c, s) for s in range(sets)] for c in classifiers]

        def prepared(batch: pa.RecordBatch, s: int) -> tuple[np.ndarray, np.ndarray]:
            y, f, x, v = _arrays(batch, label, d, h, sets)
            train = f[:, s // folds] != s % folds
            return _filled(facts, s, x[train], v[train][:, :, s]), (y[train] == 1).astype(np.int64)

        rows = self._packed(self.rows)
        boosting.fit(rows, prepared, [m for own in models for m in own], cuts, facts.weights, facts.rows.sum(1), ROWS_PER_TASK)

        def score(s: int, x: np.ndarray, v: np.ndarray) -> np.ndarray:
            values = _filled(facts, s, x, v)
            return np.stack([boosting.probability(boosting.margin(own[s], cuts[s], values)) for own in models], 1)

        return self._scores(score, len(models))

    # ---- models of Spark ML, one set at a time

    def feature_names(self) -> list[str]:
        facts = self.facts()
        return [*self.fixed, *[f"{self.fixed[i]}__missing" for i in facts.gaps], *self.varying]

    def features(self, s: int) -> Column:
        """Vector of a row as training set ``s`` sees it: columns it cannot use are 0 throughout."""
        facts, d, gaps = self.facts(), len(self.fixed), set(self.facts().gaps)
        fixed = ["0D" if facts.empty[s, i] else f"nanvl(x[{i}], {_double(facts.medians[s, i])})" if i in gaps else f"x[{i}]"
                 for i in range(d)]
        flags = [f"double(isnan(x[{i}]))" if facts.flagged[s, j] else "0D" for j, i in enumerate(facts.gaps)]
        varying = [f"v[{j * self.sets + s}]" for j in range(len(self.varying))]
        # one text instead of hundreds of calls to the JVM: threads that fit other sets would wait for each of them
        return array_to_vector(F.expr(f"array({', '.join([*fixed, *flags, *varying])})").cast("array<double>"))

    def _packed(self, rows: DataFrame) -> DataFrame:
        """``rows`` in no more partitions than their number is worth: a boosted tree runs hundreds of short jobs."""
        return rows.coalesce(max(1, math.ceil(self.facts().rows[0].sum() / ROWS_PER_TASK)))

    def training(self, s: int, part: Column | None = None) -> DataFrame:
        """Weighted rows of training set ``s`` (or those of them in ``part``)."""
        weights = self.facts().weights[s]
        weight = F.when(F.col(self.label) == 1, float(weights[1])).otherwise(float(weights[0]))
        rows = self.rows.filter(F.col("folds")[s // self.folds] != s % self.folds)
        rows = rows if part is None else rows.filter(part)
        return self._packed(rows).select(self.label, weight.alias(WEIGHT), self.features(s).alias(FEATURES))

    def held_out(self, s: int, model: Model, name: str = "p") -> DataFrame:
        rows = self.rows.filter(F.col("folds")[s // self.folds] == s % self.folds)
        ready = self._packed(rows).select(self.key, self.label, self.features(s).alias(FEATURES))
        return model.transform(ready).select(
            self.key, self.label, F.lit(s // self.folds).alias("repeat"), F.lit(s % self.folds).alias("fold"), class_one().alias(name))

    def out_of_fold(self, classifier, parallelism: int = 8) -> DataFrame:
        """Held-out probability of every row in every repeat: key, label, repeat, fold, p."""
        if isinstance(classifier, LogisticRegression) and not classifier.getElasticNetParam() and classifier.getFitIntercept():
            found = self.logistic([classifier.getRegParam()], classifier.getMaxIter())
            return materialize(self.logistic_scores([found[0]]).withColumn("p", F.col("p")[0]))
        if boosting.supports(classifier):
            return materialize(self.boosted_scores([classifier]).withColumn("p", F.col("p")[0]))
        parts = in_threads(self.rows.sparkSession, lambda s: self.held_out(s, classifier.fit(self.training(s))),
                           range(self.sets), parallelism)
        return materialize(append_rows(*parts))


# ---- helpers in tasks ----------------------------------------------------------------------

def _list_matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width) if width else np.zeros((len(column), 0))


def _arrays(batch: pa.RecordBatch, label: str, d: int, h: int, sets: int) -> tuple[np.ndarray, ...]:
    """Labels, folds, fixed columns, and varying columns by set."""
    folds = batch.column("folds")
    f = folds.flatten().to_numpy().reshape(len(folds), -1) if len(folds) else np.zeros((0, 1), int)
    return (batch.column(label).to_numpy(), f, _list_matrix(batch.column("x"), d),
            _list_matrix(batch.column("v"), h * sets).reshape(len(folds), h, sets))


def _scaled(facts: Facts, s: int, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Prepared and scaled rows of set ``s``, with a first column of ones; columns without spread are 0."""
    filled = np.where(np.isnan(x), np.nan_to_num(facts.medians[s]), x)
    flags = np.isnan(x[:, facts.gaps]).astype(float)
    z = np.hstack([filled, flags, v]) - facts.mean[s]
    live = facts.deviation[s] > 0
    z = np.divide(z, facts.deviation[s], out=np.zeros_like(z), where=live)
    return np.hstack([np.ones((len(z), 1)), z])


def _filled(facts: Facts, s: int, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows as ``FoldRows.features`` has them for set ``s``."""
    filled = x.copy()
    filled[:, facts.gaps] = np.where(np.isnan(x[:, facts.gaps]), facts.medians[s, facts.gaps], x[:, facts.gaps])
    filled[:, facts.empty[s]] = 0.0
    flags = np.isnan(x[:, facts.gaps]) & facts.flagged[s]
    return np.hstack([filled, flags, v])


def _double(value: float) -> str:
    """``value`` as an SQL literal that reads back as the same double."""
    return f"{float(value)!r}D" if math.isfinite(value) else f"double('{float(value)}')"


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))


def _part(*arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel() for a in arrays]).tobytes()], pa.binary())], ["part"])


def _total(parts: DataFrame) -> np.ndarray:
    """Sum of one array per task, added up in the executors."""
    return parts.rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add)
