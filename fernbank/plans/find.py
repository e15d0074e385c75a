"""Queries: filter, sort, skip, limit, then projection, in that order."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.scratch import folder
from .filters import where
from .pipeline import sort_columns, whole

#: Rows of a cursor that the driver fetches at once.
PAGE_ROWS = 20_000


class NotFound(LookupError):
    """No row matches."""


def project(df: DataFrame, projection: Mapping[str, bool] | None, *, strict_compat: bool = False, forced: Sequence[str] = ()) -> DataFrame:
    """Any true entry makes it an inclusion (false ones are ignored); else listed fields are left out.

    ``forced`` columns stay unless they are excluded by name. ``strict_compat`` makes
    a pure exclusion keep everything.
    """
    if not projection:
        return df
    kept = [k for k, v in projection.items() if v]
    if kept:
        names = [c for c in df.columns if c in kept or (c in forced and projection.get(c) is not False)]
        return df.select(*[c for c in kept if c in names], *[c for c in names if c not in kept])
    return df if strict_compat else df.drop(*projection)


def find(
    df: DataFrame,
    filter: Mapping[str, Any] | None = None,
    *,
    projection: Mapping[str, bool] | None = None,
    sort: Sequence[tuple[str, bool]] | None = None,
    skip: int = 0,
    limit: int = 0,
    strict_compat: bool = False,
) -> DataFrame:
    """Matching rows. A limit of 0 is none; ``sort`` lists (field, ascending); a ``$text`` key searches (see ``text_search``)."""
    filter = dict(filter or {})
    if "$text" in filter:
        from ..operators.text import text_search

        text = filter.pop("$text")
        df = text_search(df, text["$search"], text["$fields"], id_field=text.get("$id", "_id")).drop("_textScore")
    found = where(df, filter)
    known = [(f, asc) for f, asc in sort or () if f in df.columns]
    if known:
        found = found.orderBy(*sort_columns(known))
    if whole(skip, "skip"):
        found = found.offset(int(skip))
    if whole(limit, "limit"):
        found = found.limit(int(limit))
    return project(found, projection, strict_compat=strict_compat)


def find_one(df: DataFrame, filter: Mapping[str, Any] | None = None, *, id_field: str = "_id") -> Row:
    """The matching row of the smallest id."""
    rows = find(df, filter, sort=[(id_field, True)], limit=1).collect()
    if not rows:
        raise NotFound(str(filter))
    return rows[0]


def count(df: DataFrame, filter: Mapping[str, Any] | None = None) -> int:
    """How many rows match."""
    return where(df, filter).count()


def _pages(df: DataFrame, rows: int) -> Iterator[Row]:
    """The rows of ``df`` in order, at most ``rows`` of them on the driver: a file each, one read after the other."""
    spark, path = df.sparkSession, folder(df.sparkSession, "cursor")
    empty = {k for k, t in enumerate(df.dtypes) if t[1] == "void"}  # files can't hold columns without a type
    names = [f"c{k}" for k in range(len(df.columns))]  # nor two of one name
    stored = df.toDF(*names).withColumns({names[k]: F.col(names[k]).cast("string") for k in empty})
    stored.write.option("maxRecordsPerFile", rows).parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f.getPath().getName() for f in fs.listStatus(target)]
    # part-<task>-<id>-c<file of the task>...: both numbers grow beyond their digits
    placed = sorted((int(m[1]), int(m[2]), f) for f in files if (m := re.match(r"part-(\d+)-.*-c(\d+)\.", f)))
    for *_, file in placed:
        yield from spark.read.schema(stored.schema).parquet(f"{path}/{file}").toDF(*df.columns).collect()
    fs.delete(target, True)


class Cursor:
    """Rows of a query in their order, as they are when the first is fetched.

    They are written to the shared folder then and fetched in pages of ``page`` rows, so the
    driver's memory depends on neither the result's size nor its partitions'. The
    files go when the last row is fetched.
    """

    def __init__(self, df: DataFrame, batch: int = 100, page: int = PAGE_ROWS) -> None:
        self.batch, self._rows, self._held = batch, _pages(df, page), []

    def has_next(self) -> bool:
        """Whether a row is left."""
        if not self._held:
            row = next(self._rows, None)
            if row is not None:
                self._held.append(row)
        return bool(self._held)

    def __next__(self) -> Row:
        if not self.has_next():
            raise StopIteration
        return self._held.pop()

    def __iter__(self) -> Iterator[Row]:
        return self

    def next_batch(self, n: int | None = None) -> list[Row]:
        """Up to ``n`` further rows."""
        found = []
        while len(found) < (n or self.batch) and self.has_next():
            found.append(next(self))
        return found
