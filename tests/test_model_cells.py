"""Boosted fits read weighted cells (bins of every feature and class), forests rows in tasks of bounded size."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import model as MD


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 12_000
    y = (rng.random(n) < 0.3).astype("int32")
    pdf = pd.DataFrame({"id": np.arange(n), "y": y, "fold": np.arange(n) % 3, "a": y + rng.normal(size=n),
                        "b": np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n)), "t": np.where(rng.random(n) < 0.4, "p", "q"), "one": 1.0})
    return spark.createDataFrame(pdf).repartition(40)


def test_fits_read_cells(spark, rows, monkeypatch):
    seen, made = [], MD.gbt

    def spy(*a, **k):
        g = made(*a, **k)
        fit = g.fit
        monkeypatch.setattr(g, "fit", lambda df: (seen.append((df.count(), df.rdd.getNumPartitions(), df.agg(F.sum("_w")).first()[0])), fit(df))[1],
                            raising=False)
        return g
    monkeypatch.setattr(MD, "gbt", spy)
    feats = ["a", "b", "t", "one"]
    summary, imp = MD.score_set(rows, feats, "y", "fold", max_iter=5, n_folds=3)
    s = summary.first()
    assert len(s["cv_auc_folds"]) == 3 and 0.7 < s["cv_auc_mean"] < 0.8  # normals one standard deviation apart: 0.76
    best = {r["feature"]: r["importance"] for r in imp.collect()}
    assert best["a"] > 0.8 and best["one"] == 0.0
    # each class weighs as much as the larger one; no fit reads row by row or in many near-empty tasks
    big = rows.where("y = 0").count()
    assert max(w for _, _, w in seen) == pytest.approx(2 * big)
    assert all(n <= 32 * 32 * 2 * 2 for n, _, _ in seen) and all(p == 1 for _, p, _ in seen)
    assert MD.importance_ranking(rows, feats, "y", max_iter=5).first()["feature"] == "a"


def test_cells_count_every_row(rows):
    c = MD.binned_cells(rows, ["a", "b", "t"], "y", "fold", 3)
    got = c.agg(*[F.sum(x) for x in ("_n", "_h0", "_h1", "_h2", "_t0")]).first()
    assert tuple(got) == (12_000, 4_000, 4_000, 4_000, 8_000)
    # the value that fills most quantiles has a bin of its own
    edges = MD.bin_edges(rows, ["a", "b"])
    assert 0.0 in edges[1] and np.nextafter(0.0, 1.0) in edges[1] and all(len(e) < MD.MAX_BINS for e in edges)


def test_scorer_keeps_its_bins(spark, rows, tmpdir_path):
    tr, hold = rows.where("fold <> 0"), rows.where("fold = 0")
    test = hold.drop("y").withColumn("a", F.when(F.col("id") % 50 != 0, F.col("a")))
    path = MD.fit_scorer(tr, ["a", "t", "b"], "y", f"{tmpdir_path}/scorer", max_iter=5)
    _, summary = MD.score_hidden(test, hold.select("id", "y"), ["a", "t", "b"], "id", "y", path)
    s = summary.first()
    assert (s["test_rows"], s["labelled_rows"]) == (4_000, 4_000) and 0.7 < s["test_auc"] < 0.8


def test_forest_rows_lie_in_bounded_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(MD, "ROWS_PER_TASK", 1_000)
    most = []
    fit = MD.RandomForestClassifier.fit

    def spy(self, df):
        most.append(max(df.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()))
        return fit(self, df)
    monkeypatch.setattr(MD.RandomForestClassifier, "fit", spy)
    got = {r["feature"]: r["ranking"] for r in MD.recursive_elimination(rows.coalesce(1), ["a", "b", "one"], "y", keep=2, num_trees=5).collect()}
    assert got == {"a": 1, "b": 1, "one": 2} and max(most) <= 1_010
