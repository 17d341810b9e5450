"""Edge cases: dates, infinities, missing parts of categories, the fallback ladder and the controller."""
import pytest
from pyspark.sql import functions as F

from tabloom.operators import clean as CL
from tabloom.operators import features as FE
from tabloom.plans.controller import fallback_ladder, two_round


def test_date_text_forms(spark):
    rows = [("2024-1-5T7:08:09.25",), ("2024-01-15 17:08:09",), (" 2024-12-31T00:00:00 ",)]
    df = spark.createDataFrame(rows, "d string")
    out = CL.fix_dtypes(df)
    assert dict(out.dtypes)["d"] == "timestamp"
    got = [r[0] for r in out.select(F.date_format("d", "yyyy-MM-dd HH:mm:ss.SS")).collect()]
    assert got == ["2024-01-05 07:08:09.25", "2024-01-15 17:08:09.00", "2024-12-31 00:00:00.00"]
    for text in ("2024-1-5", "2024/1/5", "5.1.2024", "1/5/2024"):
        out = CL.fix_dtypes(spark.createDataFrame([(text,)], "d string"))
        assert [r[0] for r in out.select(F.to_date("d").cast("string")).collect()] == ["2024-01-05"], text


def test_infinite_text_is_a_number(spark):
    out = CL.fix_dtypes(spark.createDataFrame([("inf",), ("-Infinity",), ("1.5",)], "x string"))
    assert [r[0] for r in out.collect()] == [float("inf"), float("-inf"), 1.5]


def test_interaction_keeps_missing_parts_apart(spark):
    rows = [("a", None, 1)] * 3 + [(None, "a", 0)] * 3
    df = spark.createDataFrame(rows, "x string, y string, target int")
    f = FE.interaction("te", df, ["x", "y"], "target")
    got = {(r["x"], r["y"]): r["te"] for r in FE.apply_all(df, [f]).collect()}
    assert got == {("a", None): 1.0, (None, "a"): 0.0}


def test_out_of_fold_mean_of_the_missing_category(spark):
    rows = [(None, 0, 1), (None, 1, 0), (None, 2, 0), ("a", 0, 1), ("a", 1, 1), ("a", 2, 0)]
    df = spark.createDataFrame(rows, "c string, fold int, target int")
    f = FE.target_encoding("te", df, "c", "target", fold="fold")
    got = {(r["c"], r["fold"]): r["te"] for r in FE.apply_all(df, [f]).collect()}
    assert got[(None, 0)] == 0.0 and got[(None, 1)] == 0.5 and got[("a", 2)] == 1.0


def test_ascii_names_count_collisions_past_taken_numbers():
    m = CL.ascii_mapping(["a b", "a-b", "a_b_1", "a.b", "a b"])
    assert m == {"a b": "a_b", "a-b": "a_b_1", "a_b_1": "a_b_1_1", "a.b": "a_b_2"}
    assert CL.ascii_name("  Größe (cm) ") == "Gro_e_cm" and CL.ascii_name("Ω") == "feat"


def test_fallback_ladder_sees_every_column(spark):
    aux = spark.createDataFrame([(i, i * 1.0, i * 2.0, i * 3.0, i * 4.0, i * 5.0, "xy"[i % 2]) for i in range(40)],
                                "id int, a double, b double, c double, d double, e double, late string")
    train = spark.createDataFrame([(i, i % 2) for i in range(30)], "id int, target int")
    test = spark.createDataFrame([(i,) for i in range(30, 40)], "id int")
    level, tr, te, feats = fallback_ladder(train, test, {"aux": aux}, {"aux": ("id", "id")}, "id")
    assert (level, feats) == (1, ["fb_freq_late"]) and te.count() == 10


def test_two_rounds_keep_separate_sets(spark):
    rows = [(i, i % 2, float(i % 2) + (i * 7919 % 97) / 40.0, float(i * 104729 % 89), float(i % 2) + (i * 31 % 11) / 9.0, i % 5)
            for i in range(600)]
    df = spark.createDataFrame(rows, "id int, target int, good double, noise double, better double, fold int")
    round1 = [FE.square("sq_noise", df, "noise"), FE.square("sq_good", df, "good")]
    pool = [FE.square("sq_better", df, "better"), FE.log1p("log_noise", df, "noise"), FE.square("sq_good", df, "good")]
    winner, best = two_round(df, "target", "fold", 1, round1, pool, 5, gate=2.0)
    names = {r["feature"] for r in best.collect()}
    assert names <= ({"sq_noise", "sq_good"} if winner == 1 else {"sq_better", "log_noise"})
    assert two_round(df, "target", "fold", 1, round1, pool, 5, gate=0.0)[0] == 1


def test_intermediates_need_a_shared_folder():
    from tabloom.session import ensure_checkpoint_dir

    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

    class Session:
        conf = Conf({"spark.master": "yarn"})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_pandas_hook_refuses_rather_than_drops(spark):
    from tabloom.operators.distribution import per_column_pandas
    df = spark.createDataFrame([(float(i), float(i)) for i in range(20)], "a double, b double")
    with pytest.raises(ValueError):
        per_column_pandas(df, ["a"], lambda p: p, "column string, value double", max_n=10)


def test_x02_spread_without_pandas_groups(spark, monkeypatch):
    import numpy as np
    from tabloom.operators import distribution as D
    from tabloom.plans import q_shape
    x = {"s_acctbal": [1.0, 2.0, 2.0, 7.5, None, -3.0], "p_retailprice": [4.0, 9.0, 1.0, 1.0, 30.0, 2.0], "p_size": [5.0, 1.0, None, 2.0, 8.0, 8.0]}
    df = spark.createDataFrame(list(zip(*x.values())), ", ".join(f"{c} double" for c in x))
    monkeypatch.setattr(q_shape, "load", lambda *a: df)
    monkeypatch.setattr(D, "per_column_pandas", None)
    got = {r["column"]: (r["n"], r["iqr"], r["mad"]) for r in q_shape.x02(spark, "").collect()}
    for c, v in x.items():
        v = np.array([y for y in v if y is not None])
        assert np.allclose(got[c], (len(v), np.subtract(*np.percentile(v, [75, 25])), np.median(np.abs(v - np.median(v)))))


def test_folder_catalogue(spark, tmpdir_path):
    from tabloom.sources.files import folder_catalog, peek, read_csv
    for name, text in {"a.csv": "x;y\n1;2\n3;4\n", "b.csv": 'p,q\n"1|2|3",NaN\n"4|5|6",2.5\n', "empty.csv": "",
                       "note.txt": "no table"}.items():
        with open(f"{tmpdir_path}/{name}", "w") as f:
            f.write(text)
    got = {r["table"]: r for r in folder_catalog(spark, tmpdir_path, {"joined": spark.range(7).toDF("k")}).collect()}
    assert set(got) == {"a.csv", "b.csv", "empty.csv", "joined"}
    assert (got["a.csv"]["separator"], got["a.csv"]["rows"], got["a.csv"]["columns"]) == (";", 2, "x,y")
    assert (got["b.csv"]["separator"], got["b.csv"]["cols"]) == (",", 2)
    assert got["empty.csv"]["error"] and got["empty.csv"]["rows"] is None
    assert (got["joined"]["kind"], got["joined"]["rows"]) == ("merged", 7)
    back = read_csv(spark, f"{tmpdir_path}/b.csv", ",", schema="p string, q double")
    assert [r["q"] for r in back.orderBy("p").collect()] == [None, 2.5]
    assert peek(spark.range(200), "id", 120).count() == 120
    with pytest.raises(ValueError):
        peek(spark.range(3), "id", -1)


def test_gram_equals_pandas_with_nulls_offsets_and_constants(spark):
    import numpy as np
    import pandas as pd
    from tabloom.operators.distribution import vif
    from tabloom.operators.gram import correlations
    from tabloom.operators.quality import corr_pairs
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    pdf = pd.DataFrame({"a.x": x[:, 0] + 1e9, "b": x[:, 1], "c": x[:, 0] + 0.1 * x[:, 2], "k": 1.5, "d": x[:, 3]})
    pdf.loc[rng.random(400) < 0.3, "b"] = np.nan
    pdf.loc[rng.random(400) < 0.5, "c"] = np.nan
    pdf["void"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    got = {(r["feature_i"], r["feature_j"]): (r["n"], r["corr"]) for r in correlations(df, df.columns).collect()}
    assert len(got) == 15
    for (a, b), (n, r) in got.items():
        both = pdf[[a, b]].dropna()
        assert n == len(both)
        want = None if "k" in (a, b) or n < 2 else both[a].corr(both[b])
        assert (r is None) == (want is None) and (r is None or abs(r - want) < 1e-6), (a, b)
    (pair,) = corr_pairs(df, ["a.x", "d"]).collect()
    assert abs(pair["abs_corr"] - abs(got["a.x", "d"][1])) < 1e-12
    v = {r["feature"]: r["vif"] for r in vif(df, ["a.x", "d", "k"]).collect()}
    assert v["k"] is None and abs(v["d"] - 1 / (1 - got["a.x", "d"][1] ** 2)) < 1e-6
    none = spark.createDataFrame([], "a double, b double")
    assert [tuple(r) for r in correlations(none, ["a", "b"]).collect()] == [("a", "b", 0, None)]
    assert correlations(none, ["a"]).collect() == []


def test_gram_of_a_thousand_features(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from tabloom.operators.gram import correlations
    k = 1000
    df = spark.range(60).select(*[(F.pmod(F.xxhash64("id", F.lit(i % 990)), F.lit(1000)) + F.lit(i // 990)).alias(f"f{i}") for i in range(k)])
    got = correlations(df, df.columns)
    high = {(r["feature_i"], r["feature_j"]) for r in got.where("corr > 0.999").collect()}
    assert high == {(f"f{i}", f"f{i + 990}") for i in range(10)} and got.count() == k * (k - 1) // 2
    x = np.array(df.select("f3", "f500").collect(), float)
    (r,) = got.where("feature_i = 'f3' and feature_j = 'f500'").collect()
    assert abs(r["corr"] - np.corrcoef(x.T)[0, 1]) < 1e-9


def test_modality_and_feature_stats_have_a_row_for_every_column(spark):
    import numpy as np
    import pandas as pd
    from tabloom.operators.distribution import kde_density, modality
    from tabloom.operators.quality import feature_stats
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(-5, 1, 300), rng.normal(5, 1, 300)])
    df = spark.createDataFrame(pd.DataFrame({"two": v, "one": rng.normal(size=600), "const": 3.0, "void": np.nan}))
    got = {r["column"]: (r["peaks"], r["multimodal"]) for r in modality(df, df.columns).collect()}
    assert got["two"] == (2, True) and got["const"] == got["void"] == (1, False) and got["one"][0] >= 1
    h = v.std(ddof=1) * 600 ** -0.2
    g = v.min() + np.arange(200) * (v.max() - v.min()) / 199
    want = np.exp(-0.5 * ((g[:, None] - v) / h) ** 2).sum(axis=1)
    d = {r["i"]: r["d"] for r in kde_density(df, ["two", "void"]).collect()}
    assert np.allclose([d[i] for i in range(200)], want)
    none = spark.createDataFrame([], "a double, target int")
    assert [tuple(r) for r in modality(none, ["a"]).collect()] == [("a", 1, False)]
    (s,) = feature_stats(none, ["a"], "target").collect()
    assert (s["feature"], s["pearson"], s["mutual_info"], s["nunique"], s["null_pct"]) == ("a", 0.0, 0.0, 0, None)


def test_aggregates_of_one_table_share_a_pass(spark):
    aux = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "id int, v double")
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    fits = [FE.group_aggregate(h, aux, "id", "v", h) for h in ("sum", "mean", "max", "count")]
    out = FE.apply_all(df, fits)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 6.0, 3.0, 4.0, 2.0), (2, 5.0, 5.0, 5.0, 1.0), (3, 0.0, 0.0, 0.0, 0.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_feature_stats_with_three_classes(spark):
    import numpy as np
    import pandas as pd
    from tabloom.operators.quality import feature_stats
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 500)
    pdf = pd.DataFrame({"target": y, "a": y + rng.normal(size=500), "b": rng.normal(size=500).round(1)})
    got = {r["feature"]: r for r in feature_stats(spark.createDataFrame(pdf), ["a", "b"], "target").collect()}
    for f in ("a", "b"):
        assert abs(got[f]["pearson"] - pdf[f].corr(pdf["target"])) < 1e-9
        assert abs(got[f]["spearman"] - pdf[f].rank().corr(pdf["target"].rank())) < 1e-9
        assert got[f]["auc"] is None
    assert got["a"]["mutual_info"] > 0.1 > got["b"]["mutual_info"]


def test_knn_mutual_info_takes_text_targets_and_constants(spark):
    import numpy as np
    import pandas as pd
    from tabloom.operators.knn_mi import knn_mutual_info
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 300)
    pdf = pd.DataFrame({"id": range(300), "target": y, "label": np.where(y == 1, "yes", "no"),
                        "x": y + 0.5 * rng.normal(size=300), "const": 1.0})
    df = spark.createDataFrame(pdf)
    a = {r["feature"]: r["mutual_info"] for r in knn_mutual_info(df, ["x", "const"], "target", "id").collect()}
    b = {r["feature"]: r["mutual_info"] for r in knn_mutual_info(df, ["x", "const"], "label", "id").collect()}
    assert all(abs(a[f] - b[f]) < 1e-9 for f in a) and a["x"] > 0.2 and a["const"] < 0.1
