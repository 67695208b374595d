"""Helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.plans.shared import discard, remove, shared_dir, stored

__all__ = ["Cache", "SPACE_CLASS", "WORD_PATTERN", "discard", "only", "packed", "partitions", "remove", "shared_dir", "stored", "unpacked"]

#: Words are maximal runs of anything but these six characters.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, whatever else the table carries (and however its
    other columns clash in upper and lower case)."""
    have = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if len({c.lower() for c in df.columns}) != len(df.columns):
        df = df.toDF(*[c if c in names and have[c] == i else f"_extra_{i}" for i, c in enumerate(df.columns)])
    return df.select(*[F.col(f"`{n}`") for n in names])


class Cache(dict):
    """Results of ``make`` by key; emptied when it holds ``most`` entries."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _place(columns: list[str], name: str) -> int:
    if name not in columns:
        raise ValueError(f"missing columns: {name}")
    return columns.index(name)


def packed(df: DataFrame, *names: str) -> DataFrame:
    """``_row``, a struct of all columns, and these columns beside it. What else
    is joined on can't clash with the table's own columns, see :func:`unpacked`."""
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return rows.select(F.struct(*rows.columns).alias("_row"), *[F.col(f"c{_place(df.columns, n)}").alias(n) for n in names])


def unpacked(rows: DataFrame, columns: list[str], *more: Column, without: tuple[str, ...] = (), **other: Column) -> DataFrame:
    """The columns of the table that :func:`packed` packed, ``without`` some and
    some with other values, and ``more`` after them (in place of columns of
    these names)."""
    added = {rows.select(m).columns[0].lower() for m in more}
    gone = {_place(columns, n) for n in without}
    place = {_place(columns, n): c for n, c in other.items()}
    own = [place.get(i, F.col("_row")[f"c{i}"]).alias(c) for i, c in enumerate(columns) if i not in gone and c.lower() not in added]
    return rows.select(*own, *more)
