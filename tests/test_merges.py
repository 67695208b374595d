import pytest

from fundflow.streaming import merges
from fundflow.streaming.versions import Versions
from helpers import legs

ROWS = [("A", "B", 10, 0), ("B", "C", 4, 60), ("A", "C", 1, 120), ("C", "A", 2.5, 180), ("B", "A", 7, 240)]


def told(df):
    return {(r.address.lower(), r.chain): (r.tx_count, r.sent_usd, r.received_usd, str(r.first_seen), str(r.last_seen)) for r in df.collect()}


def test_batches_add_up(spark):
    t = legs(spark, ROWS)
    want = told(merges.wallet_facts(t))
    assert told(merges.in_batches(t, ["2024-01-01 00:01:00", "2024-01-01 00:03:00"])) == want and want["a", "ethereum"][:3] == (4, 11.0, 9.5)
    assert told(merges.in_batches(t.union(t), ["2024-01-01 00:01:00"])) == want


@pytest.mark.parametrize("before", [True, False])
def test_a_batch_that_runs_again_counts_once(spark, tmp_path, monkeypatch, before):
    """It fails once, before its version is complete or just after."""
    folder, files = str(tmp_path / "kept"), str(tmp_path / "in")
    for i in range(0, 5, 2):
        legs(spark, ROWS[: i + 2]).coalesce(1).write.mode("append").parquet(files)  # rows come again in later files
    write, failed = Versions.write, []

    def once(self, version, **tables):
        if version == 1 and not failed:
            failed.append(version)
            if not before:
                write(self, version, **tables)
            raise RuntimeError("lost")
        return write(self, version, **tables)

    monkeypatch.setattr(Versions, "write", once)
    source = lambda: spark.readStream.schema(legs(spark, ROWS[:1]).schema).option("maxFilesPerTrigger", 1).parquet(files)
    with pytest.raises(Exception, match="lost"):
        merges.keep(source(), folder).awaitTermination()
    merges.keep(source(), folder).awaitTermination()
    versions = Versions(spark, f"{folder}/versions")
    assert failed and versions.complete()[-1] == 2 and told(versions.read("wallets")) == told(merges.wallet_facts(legs(spark, ROWS))) and versions.read("seen").count() == 5
