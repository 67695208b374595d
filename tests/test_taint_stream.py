import random
from datetime import timedelta

import pytest

from fundflow.operators import taint
from fundflow.streaming import taint as stream
from fundflow.streaming.versions import Versions
from helpers import T0, legs

SOURCES = "address string, amount_usd double"


def history(seed, n=60):
    rng = random.Random(seed)
    rows = [(f"w{rng.randrange(7)}", f"w{rng.randrange(7)}", rng.choice([5, 40, 300]), i * 60) for i in range(n)]
    return [r for r in rows if r[0] != r[1]]


def told(df):
    return {r.address: (round(r.tainted_value_usd, 6), round(r.received_value_usd, 6), r.hops) for r in df.collect()}


@pytest.mark.parametrize("model", ["haircut", "fifo"])
def test_any_split_gives_the_batch_result(spark, model):
    rows, seeds = history(61), spark.createDataFrame([("w0", 500.0), ("w4", 90.0)], SOURCES)
    want = told(taint.propagate(legs(spark, rows), seeds, model, 4))
    for cuts in ([30], [7, 8, 40]):
        at = [(T0 + timedelta(minutes=c)).strftime("%Y-%m-%d %H:%M:%S") for c in cuts]
        assert told(stream.in_batches(legs(spark, rows), seeds, at, model, 4)) == want


def test_a_stream_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    """Out-of-order rows wait, a failed batch is run again, a second start goes
    on from the last version; nothing counts twice."""
    rows, seeds = history(62, 50), spark.createDataFrame([("w0", 500.0)], SOURCES)
    rows[10], rows[14] = rows[14], rows[10]  # arrive out of order, by minutes
    files, folder = str(tmp_path / "in"), str(tmp_path / "kept")
    for i in range(0, len(rows), 12):
        if i == 36:  # everything so far is read, and the third batch fails once
            write, failed = Versions.write, []

            def once(self, version, **tables):
                if version == 2 and not failed:
                    failed.append(version)
                    tables["kept"].write.parquet(f"{self.folder}/2/kept")  # left behind, without a marker
                    raise RuntimeError("lost")
                return write(self, version, **tables)

            monkeypatch.setattr(Versions, "write", once)
            source = spark.readStream.schema(legs(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(files)
            with pytest.raises(Exception, match="lost"):
                stream.follow(source, seeds, folder, "haircut", 4).awaitTermination()
            assert failed and Versions(spark, f"{folder}/versions").complete() == [0, 1]
        legs(spark, rows[i : i + 12]).coalesce(1).write.mode("append").parquet(files)
    source = spark.readStream.schema(legs(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(files)
    stream.follow(source, seeds, folder, "haircut", 4).awaitTermination()
    versions = Versions(spark, f"{folder}/versions")
    assert versions.complete()[-1] == -(-len(rows) // 12) - 1 and versions.read("late").count() == 0
    assert told(stream.followed(spark, folder, "haircut", 4)) == told(taint.propagate(legs(spark, rows), seeds, "haircut", 4))


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"), keep=1)
    assert v.read("t") is None and v.complete() == []
    for i in range(4):
        assert v.write(i, t=spark.range(i + 1))
    assert v.complete() == [2, 3] and v.read("t").count() == 4 and v.read("t", 2).count() == 3 and not v.write(3, t=spark.range(9)) and v.read("t").count() == 4
