"""Collections that change: Parquet snapshots and a log of versions.

A database is a folder. Each commit writes new snapshot folders and then one
manifest file, ``manifest/<version>.json``, created only if it isn't there; so of two
commits from one version the first wins and the other fails. Readers see the
snapshots of the manifest they opened; ``vacuum`` removes what no kept manifest names.
A commit that dies half way leaves a lock, which is void after ``LOCK_SECONDS``. Files go
through Hadoop's file system, so the folder can be in any store that Spark reads.

Text and geo indexes are tables of their own (postings sorted by token, points sorted by
grid cell), written again in the same commit as the rows they are of.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import geo_search, stats, text, ttl, updates
from ..plans.explain import explain
from ..plans.filters import quoted, where
from ..plans.find import find
from ..plans.pipeline import aggregate


#: Seconds after which an unfinished commit's lock is void.
LOCK_SECONDS = 60
#: Results that a database keeps, and for how many seconds.
CACHED, CACHE_SECONDS = 1000, 300


class Conflict(RuntimeError):
    """Another commit came first."""


class CatalogError(ValueError):
    """A collection that is or isn't there."""


class Files:
    """Small text files and folders in any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """What is in a folder; nothing if it isn't there."""
        p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def create(self, name: str, text: str) -> bool:
        """Write a new file; false if it is there already. Readers never see half of it."""
        target, part = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/.part-{uuid.uuid4().hex}")
        if self._fs.exists(target):
            return False
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        lock = self._path(f"{self.root}/{name}.lock")
        if self._fs.exists(lock) and time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000 > LOCK_SECONDS:
            self._fs.delete(lock, False)
        done = bool(self._fs.createNewFile(lock)) and not self._fs.exists(target) and bool(self._fs.rename(part, target))
        if not done:
            self._fs.delete(part, False)
        return done

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self._fs.getFileStatus(self._path(f"{self.root}/{name}")).getModificationTime() / 1000

    def read(self, name: str) -> str:
        """A file's text."""
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        """Remove a file or folder."""
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Database:
    """Named collections with versions. ``state`` is {collection: {snapshot, indexes, ttl}}."""

    def __init__(self, spark: SparkSession, root: str, *, audit: bool = False) -> None:
        self.spark, self.files, self.audited = spark, Files(spark, root), audit
        self._cache: OrderedDict[tuple, tuple[float, DataFrame]] = OrderedDict()
        self._manifests: dict[int, str] = {}
        self._schemas: dict[str, StructType] = {}

    def version(self) -> int:
        """The last committed version; 0 for a new database."""
        return max((int(n.split(".")[0]) for n in self.files.names("manifest") if n.endswith(".json")), default=0)

    def _manifest(self, version: int | None = None) -> dict[str, Any]:
        version = self.version() if version is None else version
        if version and version not in self._manifests:  # written once, so read once
            self._manifests = {version: self.files.read(f"manifest/{version:09d}.json")}
        return json.loads(self._manifests[version]) if version else {"collections": {}, "migrations": []}

    def state(self, version: int | None = None) -> dict[str, dict]:
        """The collections of a version."""
        return self._manifest(version)["collections"]

    def migrations(self) -> list[str]:
        """The names of the migrations that have run, in order."""
        return self._manifest()["migrations"]

    def commit(self, state: Mapping[str, dict], base: int, *, migrations: Sequence[str] | None = None) -> int:
        """Make ``state`` the version after ``base``, its text and geo indexes made anew where their rows have changed."""
        for collection in state.values():
            collection["indexes"] = {n: self._built(i, collection["snapshot"]) for n, i in collection["indexes"].items()}
        history = list(self._manifest(base)["migrations"] if migrations is None else migrations)
        if not self.files.create(f"manifest/{base + 1:09d}.json", json.dumps({"collections": state, "migrations": history})):
            raise Conflict(f"version {base + 1} is taken")
        for _, held in self._cache.values():
            held.unpersist()
        self._cache.clear()
        return base + 1

    def snapshot(self, df: DataFrame) -> str:
        """Write rows; the snapshot's name."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.files.root}/{name}")
        return name

    def load(self, snapshot: str) -> DataFrame:
        """A snapshot's rows. Its schema is read once."""
        path = f"{self.files.root}/{snapshot}"
        if snapshot not in self._schemas:
            self._schemas[snapshot] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[snapshot]).parquet(path)

    def _built(self, index: dict, snapshot: str) -> dict:
        """A text or geo index with its table for these rows; others as they are."""
        if index.get("kind") not in ("text", "2d", "2dsphere") or index.get("of") == snapshot:
            return index
        rows = self.load(snapshot)
        if index["kind"] == "text":
            postings, documents, length = text.build_index(rows, index["fields"], id_field=index["id"], stemmed=index["stemmed"])
            return index | {"of": snapshot, "data": self.snapshot(postings), "documents": documents, "length": length}
        points = geo_search.build_index(rows, _field(index["fields"]), id_field=index["id"], spherical=index["kind"] == "2dsphere")
        return index | {"of": snapshot, "data": self.snapshot(points)}

    def _change(self, edit) -> int:
        base = self.version()
        state = self.state(base)
        edit(state)
        return self.commit(state, base)

    def vacuum(self, *, keep: int = 1, grace_seconds: float = 3600) -> int:
        """Remove all but the last ``keep`` versions and the tables that none of these names; how many tables.

        Tables younger than the grace may belong to a commit under way and stay.
        """
        versions = sorted(int(n.split(".")[0]) for n in self.files.names("manifest") if n.endswith(".json"))
        used = {t for v in versions[-keep:] for c in self.state(v).values() for t in (c["snapshot"], *(i.get("data") for i in c["indexes"].values()))}
        for v in versions[:-keep]:
            self.files.delete(f"manifest/{v:09d}.json")
        gone = [t for n in self.files.names("data") if (t := f"data/{n}") not in used and self.files.age(t) >= grace_seconds]
        for t in gone:
            self.files.delete(t)
        return len(gone)

    def note(self, kind: str, **entry: Any) -> None:
        """Add an entry to the log ``kind`` (``audit`` or ``profile``): one JSON file, with its time."""
        self.files.create(f"{kind}/{uuid.uuid4().hex}.json", json.dumps({"at": datetime.now(timezone.utc).isoformat(), **entry}, default=str))

    def log(self, kind: str) -> DataFrame:
        """The entries of a log: ``at, operation, collection`` and, by kind, ``ok`` or ``duration_ms``."""
        names = [n for n in self.files.names(kind) if n.endswith(".json")]
        schema = "at timestamp, operation string, collection string, ok boolean, detail string, duration_ms double"
        return self.spark.read.schema(schema).json([f"{self.files.root}/{kind}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    @contextmanager
    def timed(self, operation: str, collection: str) -> Iterator[None]:
        """Log the time that a block takes, for ``stats.slow_queries``."""
        began = time.time()
        yield
        self.note("profile", operation=operation, collection=collection, duration_ms=1000 * (time.time() - began))

    @contextmanager
    def audit(self, operation: str, collection: str, detail: str = "") -> Iterator[None]:
        """Log an operation and whether it went well, if the database is audited."""
        ok = False
        try:
            yield
            ok = True
        finally:
            if self.audited:
                self.note("audit", operation=operation, collection=collection, ok=ok, detail=detail)

    def cached(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        """The persisted result of an equal query; the least recently used and those past their time go."""
        now = time.time()
        for old in [k for k, (at, _) in self._cache.items() if now - at > CACHE_SECONDS]:
            self._cache.pop(old)[1].unpersist()
        if key not in self._cache:
            if len(self._cache) >= CACHED:
                self._cache.popitem(last=False)[1][1].unpersist()
            self._cache[key] = (now, make().persist())
        self._cache.move_to_end(key)
        return self._cache[key][1]

    def collections(self) -> list[str]:
        """Names in order."""
        return sorted(self.state())

    def create(self, name: str, rows: DataFrame) -> Collection:
        """A new collection with these rows."""

        def edit(state: dict) -> None:
            if name in state:
                raise CatalogError(f"{name} is there already")
            state[name] = {"snapshot": self.snapshot(rows), "indexes": {}, "ttl": {}}

        self._change(edit)
        return Collection(self, name)

    def collection(self, name: str) -> Collection:
        """A collection that is there."""
        if name not in self.state():
            raise CatalogError(f"no collection {name}")
        return Collection(self, name)

    def get_or_create(self, name: str, schema: str = "_id string") -> Collection:
        """A collection, made without rows if it isn't there."""
        return Collection(self, name) if name in self.state() else self.create(name, self.spark.createDataFrame([], schema))

    def drop(self, name: str) -> None:
        """Remove a collection."""

        def edit(state: dict) -> None:
            if state.pop(name, None) is None:
                raise CatalogError(f"no collection {name}")

        self._change(edit)

    def rename(self, old: str, new: str) -> None:
        """Rename a collection to a free name."""

        def edit(state: dict) -> None:
            if old not in state or new in state:
                raise CatalogError(f"can't rename {old} to {new}")
            state[new] = state.pop(old)

        self._change(edit)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A collection's rows at a version."""
        return self.load(self.state(version)[name]["snapshot"])

    @contextmanager
    def transaction(self):
        """A transaction that commits once at the end, unless its version was passed meanwhile."""
        t = Transaction(self)
        yield t
        t.commit()

    def _copied(self, other: Database) -> dict[str, dict]:
        """All of another database's collections as snapshots of this one; text and geo indexes are made again."""
        plain = lambda i: {k: v for k, v in i.items() if k not in ("of", "data")}
        return {k: v | {"snapshot": self.snapshot(other.read(k)), "indexes": {n: plain(i) for n, i in v["indexes"].items()}} for k, v in other.state().items()}

    def backup(self, target: str) -> None:
        """Copy all collections, their indexes and the history of migrations to a new folder."""
        other = Database(self.spark, target)
        other.commit(other._copied(self), other.version(), migrations=self.migrations())

    def restore(self, source: str) -> None:
        """Take all collections and the history of a backup."""
        other = Database(self.spark, source)
        self.commit(self._copied(other), self.version(), migrations=other.migrations())

    def stats(self) -> dict[str, Any]:
        """Counts of collections and indexes, and the version."""
        state = self.state()
        return {"version": self.version(), "collections": len(state), "indexes": sum(len(c["indexes"]) for c in state.values())}

    def migrate(self, migrations: Sequence[tuple[str, Any, Any]], *, to: int | None = None) -> list[str]:
        """Run (name, up, down) steps not yet in the history, or undo those from ``to`` on; each takes the database."""
        done = self.migrations()
        to = len(migrations) if to is None else to
        for name, up, _ in migrations[:to]:
            if name not in done:
                up(self)
                done.append(name)
                self.commit(self.state(), self.version(), migrations=done)
        for name, _, down in reversed(migrations[to:]):
            if name in done:
                down(self)
                done.remove(name)
                self.commit(self.state(), self.version(), migrations=done)
        return done


def _field(fields: Sequence[str]) -> str | tuple[str, str]:
    """A geo index's field: one point column, or two of coordinates."""
    return fields[0] if len(fields) == 1 else (fields[0], fields[1])


class Transaction:
    """Staged frames over one snapshot, committed by one manifest. Savepoints keep earlier stages."""

    def __init__(self, db: Database) -> None:
        self.db, self.base = db, db.version()
        self.state = db.state(self.base)
        self.staged: dict[str, DataFrame] = {}
        self.edits: list[Callable[[dict], None]] = []
        self._saved: dict[str, dict[str, DataFrame]] = {}

    def rows(self, name: str) -> DataFrame:
        """A collection as this transaction sees it."""
        return self.staged[name] if name in self.staged else self.db.read(name, self.base)

    def edit(self, change: Callable[[dict], None]) -> None:
        """Change the catalog in the same commit; ``change`` gets the state."""
        self.edits.append(change)

    def stage(self, name: str, rows: DataFrame) -> None:
        """Put new rows in a collection's place."""
        if name not in self.state:
            raise CatalogError(f"no collection {name}")
        self.staged[name] = rows

    def savepoint(self, name: str) -> None:
        """Remember the stages of now."""
        self._saved[name] = dict(self.staged)

    def rollback_to(self, name: str) -> None:
        """Back to a savepoint; later ones go."""
        names = list(self._saved)
        self.staged = dict(self._saved[name])
        for later in names[names.index(name) + 1 :]:
            del self._saved[later]

    def release(self, name: str) -> None:
        """Forget a savepoint."""
        del self._saved[name]

    def commit(self) -> int:
        """Write what is staged; fails if another commit changed one of its collections, however small."""
        if not self.staged and not self.edits:
            return self.base
        now = self.db.version()
        state = self.db.state(now)
        for name in self.staged:
            if state.get(name, {}).get("snapshot") != self.state[name]["snapshot"]:
                raise Conflict(f"{name} has changed since version {self.base}")
        for name, rows in self.staged.items():
            state[name] = {**state[name], "snapshot": self.db.snapshot(rows)}
        for edit in self.edits:
            edit(state)
        return self.db.commit(state, now)


class Collection:
    """Reads and writes of one collection. Every write is one new version."""

    def __init__(self, db: Database, name: str, id_field: str = "_id") -> None:
        self.db, self.name, self.id_field = db, name, id_field

    def df(self) -> DataFrame:
        """The rows of the last version."""
        return self.db.read(self.name)

    def find(self, filter: Mapping[str, Any] | None = None, **options: Any) -> DataFrame:
        """See ``plans.find.find``. An equal query of the same version returns the same persisted frame."""
        key = (self.db.version(), self.name, json.dumps([filter, options], sort_keys=True, default=str))
        return self.db.cached(key, lambda: find(self.df(), filter, **options))

    def aggregate(self, stages: Sequence[Mapping[str, Any]]) -> DataFrame:
        """See ``plans.pipeline.aggregate``; ``$lookup`` sees the database's collections."""
        named = {n: self.db.read(n) for n in self.db.collections() if any("$lookup" in s for s in stages)}
        return aggregate(self.df(), stages, collections=named)

    def count(self, filter: Mapping[str, Any] | None = None) -> int:
        """How many rows match."""
        return where(self.df(), filter).count()

    def _spec(self, name: str) -> dict:
        return self.db.state()[self.name]["indexes"][name]

    def _unique(self) -> list[tuple[str, dict]]:
        return [(n, i) for n, i in self.db.state()[self.name]["indexes"].items() if i.get("unique")]

    def _keeps_unique(self, df: DataFrame, changed: set[str] | None = None, new: DataFrame | None = None) -> None:
        """Fail if a unique index has a key twice. ``changed`` are the fields of an update, ``new`` the rows of an insert: what they leave alone isn't looked at."""
        for name, spec in self._unique():
            if changed is not None and not changed & {f.split(".")[0] for f in (*spec["fields"], *(spec.get("filter") or {}))}:
                continue
            rows = where(df, spec.get("filter"))
            if new is not None and all(f in new.columns for f in spec["fields"]):
                keys = new.select(*[F.col(quoted(f)) for f in spec["fields"]]).distinct()
                rows = rows.join(keys, list(spec["fields"]), "left_semi")
            if not _repeats(rows, spec["fields"]).isEmpty():
                raise updates.UpdateError(f"duplicate key in {name}")

    def _write(self, operation: str, edit: Callable[[DataFrame], DataFrame]) -> None:
        with self.db.audit(operation, self.name), self.db.transaction() as t:
            t.stage(self.name, edit(t.rows(self.name)))

    def _inserted(self, df: DataFrame, rows: DataFrame) -> DataFrame:
        out = updates.insert(df, rows, self.id_field)
        self._keeps_unique(out, new=rows)
        return out

    def _updated(self, df: DataFrame, filter: Mapping[str, Any] | None, update: Mapping[str, Any], now: datetime | None = None) -> DataFrame:
        out = updates.apply_update(df, filter, update, now=now)
        self._keeps_unique(out, changed={f.split(".")[0] for f in updates.changes(df.schema, update, now=now)})
        return out

    def insert(self, rows: DataFrame) -> None:
        """Add rows with new ids that keep every unique index."""
        self._write("insert", lambda df: self._inserted(df, rows))

    def update_many(self, filter: Mapping[str, Any] | None, update: Mapping[str, Any], *, now: datetime | None = None) -> int:
        """Change all matching rows; how many matched. Fails if a unique index would have a key twice."""
        n = self.count(filter)
        if n:
            self._write("update", lambda df: self._updated(df, filter, update, now))
        return n

    def update_one(self, filter: Mapping[str, Any] | None, update: Mapping[str, Any], *, now: datetime | None = None) -> Any:
        """Change the matching row of the smallest id; that id. Fails if none matches."""
        first = updates.first_match(self.df(), filter, self.id_field)
        if first is None:
            raise LookupError(str(filter))
        self._write("update", lambda df: self._updated(df, {self.id_field: first}, update, now))
        return first

    def delete_many(self, filter: Mapping[str, Any] | None) -> int:
        """Remove all matching rows; how many."""
        n = self.count(filter)
        if n:
            self._write("delete", lambda df: updates.delete(df, filter))
        return n

    def delete_one(self, filter: Mapping[str, Any] | None) -> Any:
        """Remove the matching row of the smallest id; that id. Fails if none matches."""
        first = updates.first_match(self.df(), filter, self.id_field)
        if first is None:
            raise LookupError(str(filter))
        self._write("delete", lambda df: updates.delete(df, {self.id_field: first}))
        return first

    def bulk_write(self, operations: Sequence[Mapping[str, Any]], *, ordered: bool = True) -> list[str]:
        """Insert, update and delete in one version; errors by text. Ordered stops at the first and keeps what came before."""
        errors: list[str] = []

        def edit(df: DataFrame) -> DataFrame:
            for op in operations:
                try:
                    if "insert" in op:
                        df = self._inserted(df, op["insert"])
                    elif "update" in op:
                        df = self._updated(df, op.get("filter"), op["update"])
                    elif "delete" in op:
                        df = updates.delete(df, op["delete"])
                    else:
                        raise updates.UpdateError(f"unsupported operation: {sorted(op)}")
                except ValueError as error:
                    errors.append(str(error))
                    if ordered:
                        break
            return df

        self._write("bulk", edit)
        return errors

    def create_index(self, fields: Sequence[str], *, unique: bool = False, filter: Mapping[str, Any] | None = None, partitions: int | None = None) -> str:
        """Cluster the rows by ``fields``, so that Parquet's statistics skip what a filter on them can't need.

        A unique index is checked now and at every write; one with a filter is kept as
        its definition (see ``view``). Rows and definition are one commit.
        """
        name = "_".join(f"{f}_1" for f in fields)
        spec = {"fields": list(fields), "unique": unique, "filter": filter}
        with self.db.audit("create index", self.name, name), self.db.transaction() as t:
            rows = where(t.rows(self.name), filter)
            if unique and not _repeats(rows, fields).isEmpty():
                raise updates.UpdateError(f"duplicate key in {name}")
            if filter is None:
                keys = [quoted(f) for f in fields]
                df = t.rows(self.name)
                df = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
                t.stage(self.name, df.sortWithinPartitions(*keys))
            t.edit(lambda state: state[self.name]["indexes"].update({name: spec}))
        return name

    def _create(self, name: str, spec: dict) -> str:
        with self.db.audit("create index", self.name, name), self.db.transaction() as t:
            t.edit(lambda state: state[self.name]["indexes"].update({name: spec}))
        return name

    def create_text_index(self, fields: Sequence[str], *, stemmed: bool = True) -> str:
        """Keep postings of the fields' text, sorted by token; ``text_search`` reads those of its own tokens alone."""
        return self._create("_".join(f"{f}_text" for f in fields), {"kind": "text", "fields": list(fields), "id": self.id_field, "stemmed": stemmed})

    def create_geo_index(self, field: str | tuple[str, str], *, spherical: bool = True) -> str:
        """Keep a table of points, sorted by grid cell; ``near``, ``geo_within`` and ``geo_intersects`` read the cells that they need."""
        fields, kind = [field] if isinstance(field, str) else list(field), "2dsphere" if spherical else "2d"
        return self._create("_".join(f"{f}_{kind}" for f in fields), {"kind": kind, "fields": fields, "id": self.id_field})

    def _index(self, kinds: Sequence[str], fields: Sequence[str] | None = None) -> dict:
        found = [i for i in self.db.state()[self.name]["indexes"].values() if i.get("kind") in kinds and (fields is None or i["fields"] == list(fields))]
        if not found:
            raise CatalogError(f"{self.name} has no {' or '.join(kinds)} index")
        return found[0]

    def text_search(self, query: str, *, projection: Mapping[str, bool] | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        """Rows by relevance with ``_textScore``, ties by id, through the text index. Fails without one."""
        index = self._index(["text"])
        scores = text.index_scores(self.db.load(index["data"]), query, index["documents"], index["length"], stemmed=index["stemmed"])
        return text.ranked(self.df(), scores, id_field=self.id_field, projection=projection, skip=skip, limit=limit)

    def _of_points(self, points: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        found = points.select(F.col("id").alias(self.id_field), *extra)
        return self.df().join(found, self.id_field)

    def near(self, field: str | tuple[str, str], centre: Sequence[float], max_distance: float, *, spherical: bool = True, limit: int = 0) -> DataFrame:
        """See ``geo_search.near``; through the geo index on the field. Fails without one."""
        index = self._index(["2dsphere" if spherical else "2d"], [field] if isinstance(field, str) else field)
        points = geo_search.near(self.db.load(index["data"]), ("x", "y"), centre, max_distance, spherical=spherical, limit=limit, id_field="id")
        return self._of_points(points, ["_distance"]).orderBy("_distance", self.id_field)

    def _inside(self, field: str | tuple[str, str], search: Callable[[DataFrame], DataFrame], skip: int, limit: int) -> DataFrame:
        index = self._index(["2d", "2dsphere"], [field] if isinstance(field, str) else field)
        rows = self._of_points(search(self.db.load(index["data"])))
        rows = rows.orderBy(self.id_field) if skip or limit else rows
        rows = rows.offset(skip) if skip else rows
        return rows.limit(limit) if limit else rows

    def geo_within(self, field: str | tuple[str, str], polygon: Sequence, *, skip: int = 0, limit: int = 0) -> DataFrame:
        """See ``geo_search.within``; through the geo index on the field, by id where rows are skipped or limited."""
        return self._inside(field, lambda points: geo_search.within(points, ("x", "y"), polygon), skip, limit)

    def geo_intersects(self, field: str | tuple[str, str], low: Sequence[float], high: Sequence[float], *, skip: int = 0, limit: int = 0) -> DataFrame:
        """See ``geo_search.intersects``; through the geo index on the field, by id where rows are skipped or limited."""
        return self._inside(field, lambda points: geo_search.intersects(points, ("x", "y"), low, high), skip, limit)

    def explain(self, filter: Mapping[str, Any] | None = None, **options: Any) -> dict[str, Any]:
        """What a query reads; see ``plans.explain``."""
        return explain(find(self.df(), filter, **options))

    def analyze(self, columns: Sequence[str] | None = None) -> DataFrame:
        """Statistics of columns; see ``stats.analyze``."""
        return stats.analyze(self.df(), columns or self.df().columns)

    def view(self, index: str) -> DataFrame:
        """The rows of a partial index."""
        return where(self.df(), self._spec(index).get("filter"))

    def indexes(self) -> list[str]:
        """Index names, the one on the id first."""
        return ["_id_", *self.db.state()[self.name]["indexes"]]

    def drop_index(self, name: str) -> None:
        """Remove an index; the one on the id stays."""
        if name == "_id_" or name not in self.db.state()[self.name]["indexes"]:
            raise CatalogError(f"can't drop {name}")
        self.db._change(lambda s: s[self.name]["indexes"].pop(name))

    def create_ttl_index(self, field: str, seconds: int) -> None:
        """Rows expire ``seconds`` after ``field``."""
        self.db._change(lambda s: s[self.name]["ttl"].update({field: seconds}))

    def expire(self, now: datetime) -> int:
        """Remove what has expired by ``now``; how many rows."""
        limits = self.db.state()[self.name]["ttl"]
        n = ttl.swept(self.df(), limits, now).count()
        if n:
            self._write("expire", lambda df: ttl.live(df, limits, now))
        return n

    def compact(self, partitions: int) -> None:
        """Rewrite into fewer files."""
        self._write("compact", lambda df: df.coalesce(partitions))

    def stats(self) -> dict[str, Any]:
        """Rows, fields and indexes."""
        df = self.df()
        return {"name": self.name, "count": df.count(), "fields": len(df.columns), "indexes": self.indexes()}


def _repeats(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keys that more than one row has; rows without a key don't count."""
    keys = [quoted(f) for f in fields]
    return df.where(F.coalesce(*[F.col(k) for k in keys]).isNotNull()).groupBy(*keys).count().where("count > 1")
