"""Fitted encodings give the same values on a stream as in batch."""

from tabloom.operators import features as FE
from tabloom.streaming.apply import apply_to_stream, run_to_memory


def test_stream_matches_batch(spark, tmpdir_path):
    train = spark.createDataFrame([(i, "abc"[i % 3], i % 2) for i in range(60)], "id long, c string, y int")
    fits = [FE.target_encoding("te", train, "c", "y"), FE.freq_encoding("fq", train, "c")]
    src = f"{tmpdir_path}/incoming"
    spark.createDataFrame([(100 + i, "abcd"[i % 4]) for i in range(20)], "id long, c string").write.parquet(src)
    stream = spark.readStream.schema("id long, c string").parquet(src)
    got = run_to_memory(apply_to_stream(stream, fits), "tabloom_stream_test", f"{tmpdir_path}/ckpt")
    batch = FE.apply_all(spark.read.parquet(src), fits)
    assert sorted(map(tuple, got.select("id", "te", "fq").collect())) == \
        sorted(map(tuple, batch.select("id", "te", "fq").collect()))
