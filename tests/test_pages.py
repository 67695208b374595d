import json

import pytest

from fundflow.sources import pages


def put(folder, account, cursor, data, follows=None, **more):
    (folder / account).mkdir(parents=True, exist_ok=True)
    (folder / account / f"{cursor}.json").write_text(json.dumps({"success": True, "data": data, "meta": {"fingerprint": follows} if follows else {}} | more))


def read(spark, folder, **options):
    rows = pages.register(spark).read.format("account_pages").options(path=f"file://{folder}", retries="1", **options).load()
    return sorted((r.account, r.page, r.place, json.loads(r.entry)) for r in rows.collect())


def test_cursors_are_walked(spark, tmp_path):
    put(tmp_path, "a", "first", [1, 2], "x")
    put(tmp_path, "a", "x", [], "y")
    put(tmp_path, "a", "y", [3])
    put(tmp_path, "b", "first", [{"k": 9}])
    assert read(spark, tmp_path) == [("a", 1, 0, 1), ("a", 1, 1, 2), ("a", 3, 0, 3), ("b", 1, 0, {"k": 9})]
    assert read(spark, tmp_path, accounts="b") == [("b", 1, 0, {"k": 9})]


def test_pages_are_asked_for_again(tmp_path, monkeypatch):
    put(tmp_path, "a", "first", [1])
    waited = []

    def mend(seconds):
        waited.append(seconds)
        put(tmp_path, "a", "next", [2])

    monkeypatch.setattr(pages.time, "sleep", mend)
    assert pages.fetch(str(tmp_path), "a", "next")["data"] == [2] and len(waited) == 1
    (tmp_path / "a" / "next.json").write_text("<html>")
    assert pages.fetch(str(tmp_path), "a", "next")["data"] == [2]
    put(tmp_path, "a", "no", [], success=False, error="limit")
    with pytest.raises(pages.PageError, match="limit"):
        pages.fetch(str(tmp_path), "a", "no")
    monkeypatch.setattr(pages.time, "sleep", lambda s: None)
    with pytest.raises(pages.PageError):
        pages.fetch(str(tmp_path), "a", "gone", retries=2)


def test_a_stream_goes_on_from_the_cursor(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    put(folder, "a", "first", [1, 2], "x")
    put(folder, "a", "x", [3])

    def run():
        stream = pages.register(spark).readStream.format("account_pages").option("path", f"file://{folder}").load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.account, r.page, json.loads(r.entry)) for r in spark.read.parquet(out).collect())

    assert run() == [("a", 1, 1), ("a", 1, 2), ("a", 2, 3)]
    put(folder, "a", "x", [3], "y")  # the chain grows, and another account appears
    put(folder, "a", "y", [4])
    put(folder, "b", "first", [5])
    assert run() == [("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 4), ("b", 1, 5)]


def test_accounts_share_tasks(tmp_path):
    names = [f"a{i:04d}" for i in range(3 * pages.TASKS + 7)]
    for name in names:
        put(tmp_path, name, "first", [name])
    reader = pages.AccountReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) == pages.TASKS
    assert sorted((a, json.loads(e)) for p in parts for a, _, _, e in reader.read(p)) == [(n, n) for n in names]
    ends = {n: [1, pages.FIRST] for n in names}
    assert len(pages.AccountStream({"path": str(tmp_path)}).partitions({}, ends)) == pages.TASKS
