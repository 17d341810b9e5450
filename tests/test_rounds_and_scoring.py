"""Top-up on save, a controller that goes on after a lost driver, and scoring of held-back labels."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import features as FE
from tabloom.operators import model as MD
from tabloom.operators import quality as Q
from tabloom.plans.controller import Ledger, top_up, two_round


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(8)
    n = 600
    y = rng.integers(0, 2, n)
    pdf = pd.DataFrame({"id": range(n), "target": y, "fold": np.arange(n) % 5, "a": y + rng.normal(size=n), "b": rng.normal(size=n),
                        "c": 0.5 * y + rng.normal(size=n), "t": np.where(rng.random(n) < 0.5 + 0.2 * y, "x", "y")})
    return spark.createDataFrame(pdf)


def test_top_up_fills_free_places(spark, train):
    aux = spark.createDataFrame([(i, "p" if i % 3 else "q", float(i % 11), 1.0) for i in range(600)], "id long, kind string, num double, const double")
    tr = train.withColumn("fb_freq_kind", F.lit(9.0)).withColumn("only", F.col("a"))
    te = train.drop("target").withColumn("fb_freq_kind", F.lit(9.0))
    a, b, feats = top_up(tr, te, ["only", "gone", "b"], {"aux": aux}, {"aux": ("id", "id")})
    # the frequency encoding's name is taken, the constant column tells nothing
    assert feats == ["only", "b", "fb_map_num"]
    assert a.columns[-3:] == b.columns[-3:] == feats and a.count() == b.count() == 600
    assert b.select(F.max("only")).first()[0] == 0.0
    five = [f"f{i}" for i in range(7)]
    full = train.select("id", "target", *[F.lit(float(i)).alias(f) for i, f in enumerate(five)])
    assert top_up(full, full.drop("target"), five, {"aux": aux}, {"aux": ("id", "id")})[2] == five[:5]


def rounded(report):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in report.orderBy("rank").collect()]


def test_rounds_go_on_after_a_lost_driver(spark, train, tmpdir_path, monkeypatch):
    def proposals():
        return ([FE.expression("f_b", "b"), FE.expression("f_const", "1.0")],
                [FE.expression("f_a", "a"), FE.expression("f_c", "c"), FE.expression("f_const", "1.0")])
    first, second = proposals()
    want, report = two_round(train, "target", "fold", 0, first, second, 3)
    want_rows = rounded(report)
    assert want == 2
    whole, judged = Q.feature_stats, []

    def dies(m, names, *a):
        judged.append(list(names))
        if "f_a" in names:
            raise RuntimeError("driver lost")
        return whole(m, names, *a)
    monkeypatch.setattr(Q, "feature_stats", dies)
    ledger = Ledger(spark, f"{tmpdir_path}/ledger")
    assert ledger.best() == []
    with pytest.raises(RuntimeError):
        two_round(train, "target", "fold", 0, *proposals(), 3, ledger=ledger)
    assert ledger.round(1) is not None and ledger.round(2) is None
    assert ledger.best() == [r["feature"] for r in ledger.round(1).orderBy(F.desc("score"), F.desc("mutual_info"), F.desc(F.abs("pearson")), "feature").collect()]

    def only_second(m, names, *a):
        assert "f_b" not in names  # the first round is not judged again
        return whole(m, names, *a)
    monkeypatch.setattr(Q, "feature_stats", only_second)
    got, report = two_round(train, "target", "fold", 0, *proposals(), 3, ledger=Ledger(spark, f"{tmpdir_path}/ledger"))
    assert got == want and rounded(report) == want_rows
    assert ledger.best(2)[0] == want_rows[0][report.columns.index("feature")]


def test_hidden_labels_are_scored_by_the_saved_scorer(spark, train, tmpdir_path):
    tr, hold = train.where("fold <> 0"), train.where("fold = 0")
    te = hold.drop("target").withColumn("t", F.when(F.col("id") % 10 == 0, "unseen").when(F.col("id") % 10 != 5, F.col("t")))
    te = te.withColumn("b", F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("b")))
    path = MD.fit_scorer(tr, ["a", "b", "t"], "target", f"{tmpdir_path}/scorer", max_iter=10)
    hidden = hold.select("id", "target").where("id % 20 <> 0")
    rows, summary = MD.score_hidden(te, hidden, ["a", "b", "t"], "id", "target", path)
    s = summary.first()
    assert (s["test_rows"], s["labelled_rows"]) == (120, 90)
    pdf = rows.toPandas().dropna()
    pos, neg = (pdf[pdf.label == v].score.to_numpy() for v in (1, 0))
    auc = (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / (len(pos) * len(neg))
    assert abs(s["test_auc"] - auc) < 1e-9 and abs(s["test_gini"] - (2 * auc - 1)) < 1e-9 and auc > 0.6
    _, none = MD.score_hidden(te, hidden.limit(0), ["a", "b", "t"], "id", "target", path)
    assert none.first()["test_auc"] is None and none.first()["labelled_rows"] == 0


def test_json_keeps_nulls_of_maps_and_structs(spark):
    import json

    from tabloom.operators.clean import to_json_safe
    df = spark.sql("select map('a', double('nan'), 'b', 1.0D) as m, named_struct('x', map('k', array(double('inf'), 2.0D))) as s, "
                   "cast(null as struct<v: double>) as n, cast(null as map<string, double>) as e")
    assert json.loads(to_json_safe(df).first()["json"]) == {"m": {"a": None, "b": 1.0}, "s": {"x": {"k": [None, 2.0]}}, "n": None, "e": None}
