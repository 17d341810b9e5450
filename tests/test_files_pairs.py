"""Malformed delimited files, the folder catalogue in one job, and pairs that are committed together."""
import os

import pytest
from pyspark.sql import functions as F

from tabloom.sources import pairs as P
from tabloom.sources.files import folder_catalog, read_csv


def put(folder, name, text):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="") as f:
        f.write(text)
    return f"{folder}/{name}"


def test_quoted_newlines_and_quotes(spark, tmpdir_path):
    p = put(tmpdir_path, "a.csv", 'a,b\n"x\ny",1\n"say ""hi"", you",2\n,\n')
    assert sorted((tuple(r) for r in read_csv(spark, p).collect()), key=str) == [("say \"hi\", you", 2), ("x\ny", 1), (None, None)]


def test_records_with_more_or_fewer_fields(spark, tmpdir_path):
    p = put(tmpdir_path, "r.csv", 'a,b\n1,2\n4,5,6\n7\n"8,8",9\n')
    with pytest.raises(ValueError, match="1 records with more than 2 fields"):
        read_csv(spark, p)
    assert sorted(tuple(r) for r in read_csv(spark, p, schema="a string, b int", bad_records="skip").collect()) == [
        ("1", 2), ("7", None), ("8,8", 9)]
    kept = {r["a"]: r["_corrupt_record"] for r in read_csv(spark, p, schema="a string, b int", bad_records="keep").collect()}
    assert kept == {"1": None, "4": "4,5,6", "7": None, "8,8": None}
    with pytest.raises(ValueError):
        read_csv(spark, p, bad_records="what")


def test_catalogue_counts_records_and_reports_ragged_files(spark, tmpdir_path):
    put(tmpdir_path, "semi.csv", "x;y;z\n1;2;3\n\n4;5;6\n")
    put(tmpdir_path, "broken lines.csv", 'a,b\n"x\ny",1\n"u\n\nv",2\n')
    put(tmpdir_path, "ragged.csv", "a,b\n1,2\n4,5,6\n")
    put(tmpdir_path, "short.csv", "a|b\n1\n")
    put(tmpdir_path, "quoted.csv", 'a,b\n"1,2,3",4\n')
    put(tmpdir_path, "empty.csv", "")
    put(tmpdir_path, "parts/p1.csv", "k\tv\n1\t2\n")
    put(tmpdir_path, "parts/p2.csv", "k\tv\n3\t4\n5\t6\n")
    put(tmpdir_path, "notes.txt", "no table\n")
    got = {r["table"]: (r["separator"], r["rows"], r["columns"], r["error"]) for r in folder_catalog(spark, tmpdir_path).collect()}
    many = "records with more fields than the header"
    assert got == {"semi.csv": (";", 2, "x,y,z", None), "broken lines.csv": (",", 2, "a,b", None), "ragged.csv": (",", 2, "a,b", many),
                   "short.csv": ("|", 1, "a,b", None), "quoted.csv": (",", 1, "a,b", None), "empty.csv": (None, None, None, "empty file"),
                   "parts": ("\t", 3, "k,v", None)}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_pairs_are_read_whole_or_not_at_all(spark, tmpdir_path, fmt, monkeypatch):
    path = f"{tmpdir_path}/out"
    train = spark.createDataFrame([(1, "a\nb", 0.1, 1), (2, None, None, 0), (3, ' "q", ', 1e300, 1), (4, "", -0.0, 0)], "id long, t string, x double, y int")
    test = train.drop("y").where("id > 2")
    with pytest.raises(FileNotFoundError):
        P.read_pair(spark, path)
    first = P.write_pair(train, test, path, fmt)
    a, b = P.read_pair(spark, path)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, train.collect())) and b.columns == test.columns and b.count() == 2
    # a write that dies between the two sides leaves the earlier pair
    whole, calls = P.checksum, []

    def dies(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return whole(df)
    monkeypatch.setattr(P, "checksum", dies)
    with pytest.raises(RuntimeError):
        P.write_pair(train.limit(1), test.limit(1), path, fmt)
    monkeypatch.setattr(P, "checksum", whole)
    assert [m["version"] for m in P.committed(spark, path)] == [first]
    assert P.read_pair(spark, path)[0].count() == 4
    second = P.write_pair(train.limit(1), test.limit(0), path, fmt)
    assert P.read_pair(spark, path)[0].count() == 1 and P.read_pair(spark, path, first)[0].count() == 4
    # a side that lost rows after the commit is refused
    (test if fmt == "csv" else test).select("id").limit(1)
    m = P.committed(spark, path)[-1] | {"train_rows": 5}
    monkeypatch.setattr(P, "committed", lambda *_: [m])
    with pytest.raises(ValueError, match=second):
        P.read_pair(spark, path)


def test_checksum_does_not_depend_on_the_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    assert P.checksum(df) == P.checksum(df.orderBy(F.desc("v")).repartition(5))
    assert P.checksum(df) != P.checksum(df.withColumn("v", F.lit(0)))
