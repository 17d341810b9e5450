"""JSON-safe encoding (NaN / inf -> null at any depth) and ASCII column names."""

import json

from tabloom.operators import clean as CL


def test_nan_and_inf_become_null(spark):
    df = spark.createDataFrame([(float("nan"), 1.0, float("inf"), float("-inf"))], "a double, b double, p double, n double")
    rec = json.loads(CL.to_json_safe(df).first()["json"])
    assert rec == {"a": None, "b": 1.0, "p": None, "n": None}


def test_nested_values(spark):
    df = spark.createDataFrame([([(float("nan"),), (42.0,)], [1.0, float("inf"), 3.0])],
                               "rows array<struct<v:double>>, y array<double>")
    rec = json.loads(CL.to_json_safe(df).first()["json"])
    assert rec["rows"] == [{"v": None}, {"v": 42.0}]
    assert rec["y"] == [1.0, None, 3.0]


def test_ascii_names_collide_and_prefix():
    m = CL.ascii_mapping(["Имя", "a b", "a_b", "1st", "ok"], letter_prefix=True)
    assert m["a b"] == "a_b" and m["a_b"] == "a_b_1"
    assert m["1st"] == "f_1st" and m["ok"] == "ok"
    assert m["Имя"] == "feat"


def test_rename_pair_shares_mapping(spark):
    tr = spark.createDataFrame([(1, 2.0)], "`id` long, `x €` double")
    te = spark.createDataFrame([(1, 3.0)], "`id` long, `x €` double")
    a, b, m = CL.rename_pair(tr, te)
    assert a.columns == b.columns == ["id", "x"]
