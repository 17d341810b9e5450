"""Model-based scoring and selection: M01, M05, M06 (Spark ML boosted trees / forests).

Same role as the reference's boosted-tree scorer, not bit-equal: Spark's
GBTClassifier has no ordered boosting, no native string categories and no leaf
L2 term.  Strings are label-encoded before assembly; NULLs take -999.
Training runs distributed in Spark ML; AUCs use the exact rank formula (M02).

Boosted trees tell at most ``MAX_BINS`` values of a feature apart, so rows that
share the bin of every feature and the class are one weighted row (a cell) to
them.  The hundreds of passes of a boosted fit read the cells; the rows are read
a few times, whatever the number of iterations.  A forest draws its samples row
by row and keeps the rows.
"""

from __future__ import annotations

import math
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import col
from ..session import materialize
from . import quality as Q

# The reference scorer's settings (iterations, learning rate, depth, seed, folds).
GBT_ITERATIONS = 300
GBT_STEP = 0.05
GBT_DEPTH = 6
SEED = 42
N_FOLDS = 5

#: values of a feature that the trees tell apart (Spark ML's default)
MAX_BINS = 32
#: a table up to this size is split at its own values (Spark ML samples the rows of larger ones for its splits)
EXACT_ROWS = 10_000
#: rows and cells that a task of a fit takes at a time
ROWS_PER_TASK = 100_000
CELLS_PER_TASK = 50_000


def numeric_matrix(df: DataFrame, features: list[str], target: str, keep: list[str] = ()) -> DataFrame:
    """All-numeric design: label-encoded strings (P12) and -999 for NULLs."""
    return Q.encoded(df, features, [target, *keep])


def with_balanced_weight(df: DataFrame, target: str, out: str = "_w", size: str | None = None) -> DataFrame:
    """weight = largest class count / own class count (two-row aggregate joined back); ``size``: rows a row stands for."""
    counts = df.groupBy(col(target).alias("_cls")).agg((F.sum(size) if size else F.count(F.lit(1))).alias("_n"))
    mx = counts.agg(F.max("_n").alias("_mx"))
    from .features import with_scalars
    w = with_scalars(counts, mx).select("_cls", (F.col("_mx") / F.col("_n")).alias(out))
    return df.join(F.broadcast(w), col(target) == F.col("_cls")).drop("_cls")  # one row per class


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(df)


def spread(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df`` in tasks of about ``per_task`` rows: a fit passes over it hundreds of times, and the plan before leaves
    many near-empty tasks (a shuffle) or a few huge ones (a scan of compact files)."""
    return df.repartition(max(1, math.ceil(rows / per_task)))


def bin_edges(df: DataFrame, features: list[str]) -> list[list[float]]:
    """Ascending inner edges of at most ``MAX_BINS`` bins per feature, from all rows: between all its values when they
    are few, else its quantiles (a value that fills more than one of them has a bin of its own)."""
    probs = [i / MAX_BINS for i in range(1, MAX_BINS)]
    row = df.agg(*[F.approx_count_distinct(col(f)).alias(f"n{i}") for i, f in enumerate(features)],
                 *[F.percentile_approx(col(f), probs, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    few = [i for i in range(len(features)) if row[f"n{i}"] <= 2 * MAX_BINS]
    sets = df.agg(*[F.collect_set(col(features[i])).alias(f"s{i}") for i in few]).first() if few else None
    out = []
    for i in range(len(features)):
        values = sorted(v for v in sets[f"s{i}"] if math.isfinite(v)) if i in few else None
        if values is not None and len(values) <= MAX_BINS:
            edges = {a + (b - a) / 2 for a, b in zip(values, values[1:])}
        else:
            times = Counter(v for v in row[f"q{i}"] or [] if math.isfinite(v))
            edges = set(times) | {math.nextafter(v, math.inf) for v, n in times.items() if n > 1}
        out.append(sorted(edges))
    return out


def binner(df: DataFrame, inputs: list[str], outputs: list[str]) -> Bucketizer:
    """Number of the bin of every input column."""
    # a column of one value has one bin; the bucketizer wants an edge
    splits = [[-math.inf, *(e or [0.0]), math.inf] for e in bin_edges(df, inputs)]
    return Bucketizer(splitsArray=splits, inputCols=inputs, outputCols=outputs, handleInvalid="keep")


def cells(design: DataFrame, features: list[str], target: str, fold: str | None = None, n_folds: int = 0) -> DataFrame:
    """The rows of ``design`` by class and value of every feature: _n rows, of them _h<k> in fold k and _t<k> in the
    others; _c is the class weight, _w the weight of the cell, _features the vector."""
    folds = [x for k in range(n_folds) for x in (F.count_if(col(fold) == k).alias(f"_h{k}"), F.count_if(col(fold) != k).alias(f"_t{k}"))]
    found = (design.where(col(target).isNotNull()).groupBy(col(target).cast("double").alias(target), *[col(f) for f in features])
             .agg(F.count(F.lit(1)).alias("_n"), *folds))
    found = materialize(found, "cells")
    weighted = with_balanced_weight(spread(found, found.count(), CELLS_PER_TASK), target, "_c", "_n")
    return _assemble(weighted.withColumn("_w", F.col("_c") * F.col("_n")), features)


def binned_cells(train: DataFrame, features: list[str], target: str, fold: str | None = None, n_folds: int = 0) -> DataFrame:
    """Cells of the all-numeric design of ``train``, its features as bins unless the table is small."""
    design = materialize(numeric_matrix(train, features, target, [fold] if fold else []), "design")
    if design.count() > EXACT_ROWS:
        bins = [f"_b{i}" for i in range(len(features))]
        # (the sum drops the bucketizer's note that bins are categories: they are ordered)
        design = binner(design, features, bins).transform(design).select(
            *([col(fold)] if fold else []), col(target), *[(F.col(b) + F.lit(0.0)).alias(f) for b, f in zip(bins, features)])
    return cells(design, features, target, fold, n_folds)


def gbt(max_iter: int = GBT_ITERATIONS, target: str = "label", weight: str | None = "_w") -> GBTClassifier:
    g = GBTClassifier(featuresCol="_features", labelCol=target, maxIter=max_iter, stepSize=GBT_STEP,
                      maxDepth=GBT_DEPTH, seed=SEED)
    if weight:
        g = g.setWeightCol(weight)
    return g


def auc(scored: DataFrame, target: str, size: str, score: str = "_p1") -> float | None:
    """Exact AUC of scored cells of ``size`` rows each."""
    counts = scored.groupBy(F.lit(score).alias("column"), F.col(score).alias("value")).agg(
        F.sum(size).alias("n"), F.sum(F.col(size) * col(target)).alias("sum_y"))
    t = Q.spearman_auc_of(Q.ranks_of(counts)).first()
    return None if t is None else t["auc"]


def score_set(train: DataFrame, features: list[str], target: str, fold: str, max_iter: int = GBT_ITERATIONS,
              n_folds: int = N_FOLDS) -> tuple[DataFrame, DataFrame]:
    """K-fold CV AUC (mean, std ddof 0, per fold) + importances of a fit on all train rows.

    ``fold`` is a stratified fold column (W06) on the training rows.
    """
    spark = train.sparkSession
    design = binned_cells(train, features, target, fold, n_folds).persist()

    def fold_auc(k):
        hold = design.where(F.col(f"_h{k}") > 0)
        if hold.isEmpty():
            return None
        others = design.where(F.col(f"_t{k}") > 0).withColumn("_w", F.col("_c") * F.col(f"_t{k}"))
        model = gbt(max_iter, target).fit(others)
        scored = model.transform(hold).withColumn("_p1", vector_to_array("probability")[1])
        return auc(scored, target, f"_h{k}")

    # the fits are independent: their many small jobs share the cluster
    with ThreadPoolExecutor(max_workers=n_folds + 1) as pool:
        full = pool.submit(lambda: gbt(max_iter, target).fit(design))
        aucs = list(pool.map(fold_auc, range(n_folds)))
        imp = full.result().featureImportances.toArray().tolist()
    design.unpersist()
    valid = [a for a in aucs if a is not None]
    mean = sum(valid) / len(valid) if valid else None
    std = (sum((a - mean) ** 2 for a in valid) / len(valid)) ** 0.5 if valid else None
    summary = spark.createDataFrame(
        [(mean, std, [float(a) for a in valid], None if mean is None else 2 * mean - 1)],
        "cv_auc_mean double, cv_auc_std double, cv_auc_folds array<double>, cv_gini double")
    importances = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)],
                                        "feature string, importance double")
    return summary, importances


def fit_scorer(train: DataFrame, features: list[str], target: str, path: str, max_iter: int = GBT_ITERATIONS):
    """Fit on all training rows and save what scoring needs under ``path``: the label dictionaries of the text
    columns, the bins of the numbers, the assembler and the trees, as one pipeline."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import StringIndexer
    text = [f for f in features if dict(train.dtypes)[f] in ("string", "boolean")]
    names = {f: f"_x{i}" for i, f in enumerate(features)}
    rows = materialize(_scorer_input(train, features).select(
        col(target), *[F.col(f"_t{i}" if f in text else f"_x{i}") for i, f in enumerate(features)]), "scorer-rows")
    # unseen and missing labels are numbered last, like a label of their own
    steps = [StringIndexer(inputCol=f"_t{features.index(f)}", outputCol=names[f], stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
             for f in text]
    numbers = [names[f] for f in features if f not in text]
    if numbers and rows.count() > EXACT_ROWS:
        bins = {x: f"_b{x[2:]}" for x in numbers}
        steps.append(binner(rows, numbers, list(bins.values())))
        names = {f: bins.get(x, x) for f, x in names.items()}
    for step in steps:
        rows = step.transform(rows)
    inputs = [names[f] for f in features]
    # text keeps its note that the codes are categories, bins lose it: they are ordered
    design = rows.select(col(target), *[F.col(x) if x.startswith("_x") else (F.col(x) + F.lit(0.0)).alias(x) for x in inputs])
    design = cells(design, inputs, target).persist()
    steps += [VectorAssembler(inputCols=inputs, outputCol="_features"), gbt(max_iter, target).fit(design)]
    design.unpersist()
    PipelineModel(steps).write().overwrite().save(path)
    return path


def _scorer_input(df: DataFrame, features: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    out = {}
    for i, f in enumerate(features):
        if kinds[f] in ("string", "boolean"):
            out[f"_t{i}"] = col(f).cast("string")
        else:
            x = col(f).cast("double")
            out[f"_x{i}"] = F.coalesce(F.when(~F.isnan(x), x), F.lit(Q.SENTINEL))
    return df.withColumns(out)


def score_hidden(test: DataFrame, hidden: DataFrame, features: list[str], id_col: str, target: str, path: str
                 ) -> tuple[DataFrame, DataFrame]:
    """M01, test side: (scored rows, summary) of the scorer saved under ``path``.

    The hidden labels are joined by id (J12); rows without one are scored but not judged.  Summary: test_rows,
    labelled_rows, test_auc, test_gini (NULL when only one class is labelled)."""
    from pyspark.ml import PipelineModel
    model = PipelineModel.load(path)
    scored = model.transform(_scorer_input(test, features).withColumn("_w", F.lit(1.0))).select(
        col(id_col), vector_to_array("probability")[1].alias("score"))
    rows = scored.join(hidden.select(col(id_col), col(target).cast("double").alias("label")), id_col, "left")
    rows = materialize(rows, "scored")
    judged = rows.where("label is not null")
    table = Q.spearman_auc_table(judged.select("score", "label"), ["score"], "label")
    n = rows.agg(F.count(F.lit(1)).alias("test_rows"), F.count("label").alias("labelled_rows"))
    from .joins import one_row_join
    auc_row = table.agg(F.max("auc").alias("test_auc"))
    return rows, one_row_join(n, auc_row).withColumn("test_gini", 2 * F.col("test_auc") - 1)


def importance_ranking(train: DataFrame, features: list[str], target: str, max_iter: int = 100) -> DataFrame:
    """Boosted-tree importances, ranked descending (feature, importance, rank)."""
    design = binned_cells(train, features, target).persist()
    imp = gbt(max_iter, target).fit(design).featureImportances.toArray().tolist()
    design.unpersist()
    rows = sorted(zip(features, imp), key=lambda t: (-t[1], t[0]))
    return train.sparkSession.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                                              "feature string, importance double, rank int")


def recursive_elimination(train: DataFrame, features: list[str], target: str, keep: int = 5,
                          num_trees: int = 100) -> DataFrame:
    """Random forest, drop the weakest feature per round until ``keep`` remain.

    The design matrix is written once and cached in tasks of bounded size (a
    forest holds a sample count per row and tree); each round refits on a
    narrower vector (slicing the cached columns).  ranking 1 = kept; others
    get ranks in reverse elimination order.
    """
    design = materialize(numeric_matrix(train, features, target).withColumn(target, col(target).cast("double")), "design")
    design = spread(design, design.count(), ROWS_PER_TASK).persist()
    remaining = list(features)
    ranking = {}
    while len(remaining) > keep:
        rf = RandomForestClassifier(featuresCol="_features", labelCol=target, numTrees=num_trees, seed=SEED)
        model = rf.fit(_assemble(design, remaining))
        imp = model.featureImportances.toArray().tolist()
        weakest = min(zip(remaining, imp), key=lambda t: (t[1], t[0]))[0]
        ranking[weakest] = len(remaining) - keep + 1
        remaining.remove(weakest)
    design.unpersist()
    for f in remaining:
        ranking[f] = 1
    return train.sparkSession.createDataFrame([(f, int(r), r == 1) for f, r in ranking.items()],
                                              "feature string, ranking int, selected boolean")
