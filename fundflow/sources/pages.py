"""Accounts whose entries come in pages, each naming the next by a cursor.

Pages are JSON documents ``{"success": true, "data": [...], "meta":
{"fingerprint": cursor}}`` below ``path/account``: ``first.json``, then one
document per cursor. Page n is reached by no other way than through those before
it, so an account is walked by one task; a task walks its share of the accounts,
:data:`TASKS` of them side by side. As a
stream, the offset of an account is the number of pages that were read and the
cursor of the last one, from which the next batch goes on when the chain has
grown. A page that can't be read or isn't JSON is asked for again; a page
without a cursor is the last.

>>> pages.register(spark)
>>> spark.read.format("account_pages").option("path", folder).load()
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "account string, page int, place int, entry string"
FIRST = "first"
RETRIES, WAIT_SECONDS = 3, 0.1
#: Tasks that accounts are dealt to; with one each, starting tasks takes longer
#: than reading.
TASKS = 256


def _opened(address: str):
    """File system and path; of ``file:/`` addresses in either form."""
    import re

    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", address))


class PageError(Exception):
    """A page that stayed unreadable, or that its service refused."""


def fetch(folder: str, account: str, cursor: str, retries: int = RETRIES, wait: float = WAIT_SECONDS, opened: tuple | None = None) -> dict:
    """One page, asked for up to ``retries`` times more; ``opened`` is the
    folder's file system and path, if they are at hand."""
    why = None
    for attempt in range(retries + 1):
        try:
            store, path = opened or _opened(folder)
            with store.open_input_stream(f"{path}/{account}/{cursor}.json") as f:
                page = json.loads(f.read())
            if page.get("success") is False:
                raise PageError(f"{account}/{cursor}: {page.get('error')}")
            return page
        except (OSError, ValueError) as e:
            why = e
            time.sleep(wait * 2**attempt)
    raise PageError(f"{account}/{cursor}: {why}")


def follows(page: dict) -> str | None:
    return (page.get("meta") or {}).get("fingerprint") or None


def walk(folder: str, account: str, cursor: str | None, retries: int = RETRIES, opened: tuple | None = None) -> Iterator[tuple[str, dict]]:
    """(cursor, page) from this cursor on, to the page that names no next one."""
    while cursor:
        page = fetch(folder, account, cursor, retries, opened=opened)
        yield cursor, page
        cursor = follows(page)


class _Walk:
    def __init__(self, account: str, cursor: str, read: int, upto: int | None):
        self.account, self.cursor, self.read, self.upto = account, cursor, read, upto


class _Share(InputPartition):
    def __init__(self, walks: list[_Walk]):
        self.walks = walks


def _dealt(walks: list[_Walk]) -> list[InputPartition]:
    return [_Share(walks[i::TASKS]) for i in range(min(TASKS, len(walks)))]


class _Accounts:
    def __init__(self, options: dict[str, str]):
        self.folder, self.retries = options["path"].rstrip("/"), int(options.get("retries", RETRIES))
        self.named = [a for a in options.get("accounts", "").split(",") if a]

    def accounts(self) -> list[str]:
        from pyarrow import fs

        if self.named:
            return sorted(self.named)
        store, path = _opened(self.folder)
        return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory)

    def read(self, share: _Share) -> Iterator[tuple]:
        opened = _opened(self.folder)
        for one in share.walks:
            yield from self._pages(one, opened)

    def _pages(self, one: _Walk, opened: tuple) -> Iterator[tuple]:
        """The pages after the first ``read`` ones; ``cursor`` is that of the last of these."""
        skip = one.read > 0
        n = one.read - skip
        for _, page in walk(self.folder, one.account, one.cursor, self.retries, opened):
            n += 1
            if one.upto is not None and n > one.upto:
                return
            if not (skip and n == one.read):
                for i, entry in enumerate(page.get("data") or []):
                    yield one.account, n, i, json.dumps(entry)


class AccountReader(_Accounts, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return _dealt([_Walk(a, FIRST, 0, None) for a in self.accounts()])


class AccountStream(_Accounts, DataSourceStreamReader):
    """Offsets: pages read and the cursor of the last one, by account."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.known: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for account in self.accounts():
            n, cursor = self.known.get(account, [1, FIRST])
            for at, _ in walk(self.folder, account, cursor, self.retries):
                self.known[account] = [n, at]
                n += 1
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt([_Walk(a, start.get(a, [0, FIRST])[1], start.get(a, [0, FIRST])[0], n) for a, (n, _) in end.items() if n > start.get(a, [0])[0]])


class AccountPages(DataSource):
    """Options: path, accounts (comma-separated; all by default), retries."""

    @classmethod
    def name(cls) -> str:
        return "account_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return AccountReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return AccountStream(self.options)


def register(spark: SparkSession) -> SparkSession:
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning has no shipped code
    spark.dataSource.register(AccountPages)
    return spark


def lay_down(rows: DataFrame, folder: str, account: str, order: list, page_size: int = 200) -> DataFrame:
    """Write the entries of each account as pages below a shared folder, in
    order; (account, pages). What each row holds is its entry."""
    rank = Window.partitionBy(account).orderBy(*order)
    numbered = rows.select(F.col(account).alias("account"), F.to_json(F.struct(*rows.columns)).alias("entry"), F.row_number().over(rank).alias("n"))
    paged = numbered.withColumn("page", F.floor((F.col("n") - 1) / page_size).cast("int")).groupBy("account", "page").agg(F.array_sort(F.collect_list(F.struct("n", "entry"))).alias("entries"))
    known = paged.withColumn("last", F.max("page").over(Window.partitionBy("account"))).select("account", "page", "last", F.transform("entries", lambda e: e["entry"]).alias("entries"))

    def cursor(who: str, page: int) -> str:
        return FIRST if page == 0 else hashlib.sha256(f"{who}/{page}".encode()).hexdigest()[:24]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        for batch in batches:
            for who, page, last, entries in zip(*[c.to_pylist() for c in batch.columns]):
                path = f"{root}/{who}/{cursor(who, page)}.json"
                store.create_dir(f"{root}/{who}")
                meta = {"fingerprint": cursor(who, page + 1)} if page < last else {}
                with store.open_output_stream(path) as out:
                    out.write(json.dumps({"success": True, "data": [json.loads(e) for e in entries], "meta": meta}).encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["account", "page"])

    return known.mapInArrow(run, "account string, page int").groupBy("account").agg(F.count("*").alias("pages"))
