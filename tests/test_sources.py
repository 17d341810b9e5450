"""Delimited scans: header probe, delimiter detection, index artefacts."""

import os

from tabloom.sources import files as FS


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_header_columns(spark, tmpdir_path):
    _write(f"{tmpdir_path}/foo.csv", "a,b,c\n1,2,3\n")
    _write(f"{tmpdir_path}/bar.csv", "x,y\n4,5\n")
    assert FS.header_columns(spark, f"{tmpdir_path}/foo.csv") == ["a", "b", "c"]
    assert FS.header_columns(spark, f"{tmpdir_path}/bar.csv") == ["x", "y"]


def test_separators(spark, tmpdir_path):
    for name, sep in (("c", ","), ("s", ";"), ("t", "\t"), ("p", "|")):
        p = f"{tmpdir_path}/{name}.csv"
        _write(p, sep.join(["a", "b", "c"]) + "\n" + sep.join(["1", "2", "3"]) + "\n")
        assert FS.detect_separator_sniff(spark, p) == sep
        assert FS.detect_separator_try(spark, p) == sep
    one = f"{tmpdir_path}/one.csv"
    _write(one, "a\n1\n2\n")
    assert FS.detect_separator_sniff(spark, one) == ","


def test_index_artefacts_dropped(spark, tmpdir_path):
    p = f"{tmpdir_path}/idx.csv"
    _write(p, ",Unnamed: 0,v\n0,0,1\n1,1,2\n")
    df = FS.drop_index_artefacts(FS.read_csv(spark, p))
    assert df.columns == ["v"]


def test_random_baseline_is_a_function_of_id(spark):
    a = FS.random_baseline(spark.range(1000).withColumnRenamed("id", "k"), "k", 2).orderBy("k").collect()
    b = FS.random_baseline(spark.range(1000).repartition(7).withColumnRenamed("id", "k"), "k", 2).orderBy("k").collect()
    assert a == b
    vals = [r["fb_rand_1"] for r in a]
    mean = sum(vals) / len(vals)
    assert abs(mean) < 0.15 and 0.8 < (sum((v - mean) ** 2 for v in vals) / len(vals)) ** 0.5 < 1.2
