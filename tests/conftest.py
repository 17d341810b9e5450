import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("tabloom-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from tabloom.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def simple_train(spark):
    """200 rows: row_id, feat_a ~ N(0,1), feat_b in {0..4}, target 0/1 (seed 42)."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"row_id": np.arange(200, dtype="int64"), "feat_a": rng.normal(size=200),
                        "feat_b": rng.integers(0, 5, size=200).astype("float64"),
                        "target": rng.integers(0, 2, size=200).astype("int32")})
    return spark.createDataFrame(pdf)


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tabloom-test-", dir="/tmp")
