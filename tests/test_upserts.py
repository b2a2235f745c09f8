"""The upsert store in runs of growing size."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from riskfabric.streaming import sinks


def files(rows):
    return len(rows.inputFiles())


def test_covering_runs():
    for fan in (2, 3, 10):
        for end in range(0, 250):
            runs = sinks.covering_runs(end, fan)
            held = [b for level, number in runs for b in range(number * fan ** level, (number + 1) * fan ** level)]
            assert held == list(range(end))
            assert all(sum(1 for l, _ in runs if l == level) < fan for level in {l for l, _ in runs})


def landed(spark, folder, batch):
    rows = spark.range(batch, batch + 5, 1, 1).select((F.col("id") % 7).alias("k"), F.lit(batch // 3).alias("t"), F.lit(f"b{batch}").alias("v"))
    rows.write.mode("append").parquet(folder)


def run(spark, folder, store, **options):
    stream = spark.readStream.schema("k long, t int, v string").option("maxFilesPerTrigger", 1).parquet(folder)
    sinks.write_upserts(stream, store, ["k"], ["t"], fan=3, files=2, **options).awaitTermination()


def current(spark, store):
    return {r["k"]: r["v"] for r in sinks.read_upserts(spark, store, ["k"], ["t"]).collect()}


def expected(batches):
    newest = {}
    for batch in range(batches):  # equal times: the later batch
        for k in range(batch, batch + 5):
            newest[k % 7] = f"b{batch}"
    return newest


def test_newest_rows_in_few_files_and_a_merge_that_dies(spark, tmp_path, monkeypatch):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    assert sinks.read_upserts(spark, store, ["k"], ["t"]) is None
    for batch in range(7):
        landed(spark, source, batch)
    run(spark, source, store)
    end, fan = sinks.stored_batches(spark, store)
    assert (end, fan) == (7, 3) and current(spark, store) == expected(7)
    assert files(sinks.read_upserts(spark, store, ["k"], ["t"])) <= 2 * 2 + 1 * 8
    for batch in (7, 8):
        landed(spark, source, batch)
    plain = sinks._run

    def dies(folder, level, number):  # the first merge into level 2 (of batch 8) fails
        if level == 2:
            raise OSError("lost")
        return plain(folder, level, number)

    monkeypatch.setattr(sinks, "_run", dies)
    with pytest.raises(StreamingQueryException):
        run(spark, source, store)
    monkeypatch.setattr(sinks, "_run", plain)
    assert sinks.stored_batches(spark, store) == (8, 3) and current(spark, store) == expected(8)
    run(spark, source, store)
    assert sinks.stored_batches(spark, store) == (9, 3) and current(spark, store) == expected(9)
    assert files(sinks.read_upserts(spark, store, ["k"], ["t"])) <= 2
