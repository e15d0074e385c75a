"""Registered queries of what is stored: collections, indexes, transactions, import and export, change streams.

Each makes its database or files anew in the shared folder and returns rows that SQL
can tell from the tables alone. The indexed searches keep theirs for the session.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .functions import geo
from .functions.scratch import folder
from .functions.stemmer import stem
from .operators import routing, stats, text, updates
from .plans.find import Cursor, find
from .sources import impex, tables
from .sources.store import Conflict, Database
from .streaming import changes

#: Rows of a cursor that the driver holds before it writes them.
HELD_ROWS = 100_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLE_SQL[name] = build, sql
        return build

    return register


_table = tables.table


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("_id"), "c_name", "c_acctbal", F.col("c_nationkey").cast("long").alias("nation"))


_C = "(SELECT c_custkey::BIGINT AS _id, c_name, c_acctbal, c_nationkey::BIGINT AS nation FROM customer)"


def _db(spark: SparkSession, sf_dir: str, **options) -> Database:
    db = Database(spark, folder(spark, "db"), **options)
    db.create("customers", _customers(spark, sf_dir))
    return db


# ---- import and export


@_add("json_round_trip", f"SELECT * FROM {_C}")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "json")
    impex.write(_customers(spark, sf_dir), path, "json")
    return impex.read(spark, path, "json").select("_id", "c_name", "c_acctbal", "nation")


@_add("json_array_round_trip", "SELECT n_nationkey::BIGINT AS key, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def _json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "array") + ".json"
    nested = _table(spark, sf_dir, "nation").select(F.struct(F.col("n_nationkey").cast("double").alias("key"), F.array("n_name").alias("names")).alias("x"), F.col("n_regionkey").cast("double").alias("region"))
    impex.write(nested, path, "json", pretty=True)
    return impex.read(spark, path, "json", lines=False).select("x.key", F.get("x.names", F.lit(0)).alias("name"), "region")


@_add("csv_round_trip", f"SELECT * FROM {_C}")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "csv")
    impex.write(_customers(spark, sf_dir), path, "csv")
    return impex.read(spark, path, "csv").select("_id", "c_name", "c_acctbal", "nation")


@_add("csv_by_cell", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'BOOLEAN' WHEN c_custkey % 3 = 1 THEN 'BIGINT' ELSE 'STRING' END AS kind, count(*) AS n FROM customer GROUP BY 1")
def _csv_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "cells")
    cell = F.when(F.col("c_custkey") % 3 == 0, "true").when(F.col("c_custkey") % 3 == 1, F.col("c_custkey").cast("string")).otherwise(F.col("c_name"))
    impex.write(_table(spark, sf_dir, "customer").select(cell.alias("cell")), path, "csv")
    return impex.read(spark, path, "csv", strict=True).groupBy(F.schema_of_variant("cell").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---- catalog, writes, indexes


@_add("catalog", "SELECT * FROM (VALUES ('clients'), ('empty')) AS t(name)")
def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir)
    db.get_or_create("customers")
    db.get_or_create("empty")
    db.get_or_create("gone")
    db.drop("gone")
    db.rename("customers", "clients")
    return spark.createDataFrame([(n,) for n in db.collections()], "name string")


@_add("update_one", f"SELECT _id, CASE WHEN _id = (SELECT min(_id) FROM {_C} WHERE c_acctbal > 5000) THEN 'first' ELSE c_name END AS c_name FROM {_C}")
def _update_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _db(spark, sf_dir).collection("customers")
    customers.update_one({"c_acctbal": {"$gt": 5000}}, {"$set": {"c_name": "first"}})
    return customers.df().select("_id", "c_name")


@_add("delete_one", f"SELECT _id FROM {_C} WHERE _id <> (SELECT min(_id) FROM {_C} WHERE nation = 3)")
def _delete_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _db(spark, sf_dir).collection("customers")
    customers.delete_one({"nation": 3})
    return customers.df().select("_id")


@_add(
    "bulk_write",
    f"""SELECT _id, CASE WHEN nation = 4 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal FROM {_C} WHERE nation <> 5
        UNION ALL SELECT -r_regionkey::BIGINT - 1, 1.5::DOUBLE FROM region""",
)
def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _db(spark, sf_dir).collection("customers")
    new = _table(spark, sf_dir, "region").select((-F.col("r_regionkey").cast("long") - 1).alias("_id"), F.lit(1.5).alias("c_acctbal"))
    errors = customers.bulk_write([{"insert": new}, {"insert": new}, {"update": {"$inc": {"c_acctbal": 10}}, "filter": {"nation": 4}}, {"delete": {"nation": 5}}], ordered=False)
    if errors != ["duplicate id"]:
        raise AssertionError(errors)
    return customers.df().select("_id", "c_acctbal")


@_add("unique_index", "SELECT 'c_name_1' AS name, 4 AS refused, count(*) AS n, count(DISTINCT c_name) AS names FROM customer")
def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _db(spark, sf_dir).collection("customers")
    name = customers.create_index(["c_name"], unique=True)
    taken = customers.df().agg(F.max("c_name")).first()[0]
    row = lambda k: spark.createDataFrame([(k, taken)], "_id long, c_name string")
    refused = 0
    for change in (lambda: customers.insert(row(-1)), lambda: customers.update_many({}, {"$set": {"c_name": "same"}}), lambda: customers.update_one({}, {"c_name": taken})):
        try:
            change()
        except updates.UpdateError:
            refused += 1
    refused += len(customers.bulk_write([{"insert": row(-2)}]))
    return customers.df().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_name").alias("names")).select(F.lit(name).alias("name"), F.lit(refused).alias("refused"), "n", "names")


@_add("index_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 120000")
def _index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, folder(spark, "db"))
    orders = db.create("orders", _table(spark, sf_dir, "orders"))
    orders.id_field = "o_orderkey"
    orders.create_index(["o_totalprice", "o_custkey"])
    return orders.find({"o_totalprice": {"$gte": 100000, "$lt": 120000}}, projection={"o_orderkey": True, "o_totalprice": True})


@_add("partial_index", f"SELECT _id, c_acctbal FROM {_C} WHERE c_acctbal > 9000")
def _partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _db(spark, sf_dir).collection("customers")
    return customers.view(customers.create_index(["c_acctbal"], filter={"c_acctbal": {"$gt": 9000}})).select("_id", "c_acctbal")


@_add("index_list", "SELECT * FROM (VALUES ('_id_'), ('c_name_text'), ('nation_1')) AS t(name)")
def _index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _db(spark, sf_dir).collection("customers")
    customers.create_index(["nation"])
    customers.drop_index(customers.create_index(["c_acctbal"]))
    customers.create_text_index(["c_name"])
    return spark.createDataFrame([(n,) for n in customers.indexes()], "name string")


@_add("database_stats", "SELECT 2::BIGINT AS collections, 1::BIGINT AS indexes, count(*) AS n, 4::BIGINT AS fields FROM customer")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir)
    db.get_or_create("other")
    customers = db.collection("customers")
    customers.create_index(["nation"])
    whole, one = db.stats(), customers.stats()
    return spark.createDataFrame([(whole["collections"], whole["indexes"], one["count"], one["fields"])], "collections long, indexes long, n long, fields long")


@_add("explain_filter", "SELECT 'parquet' AS scan, true AS pushed, 0 AS exchanges")
def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _db(spark, sf_dir).collection("customers").explain({"c_acctbal": {"$gt": 9000}}, projection={"_id": True})
    return spark.createDataFrame([(found["scans"][0], any("GreaterThan(c_acctbal" in x for x in found["pushed"]), found["exchanges"])], "scan string, pushed boolean, exchanges int")


@_add("cached_find", f"SELECT _id FROM {_C} WHERE nation + 1 = 7")
def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _db(spark, sf_dir).collection("customers")
    if customers.find({"nation": 7}) is not customers.find({"nation": 7}):
        raise AssertionError("an equal query must return the kept result")
    customers.update_many({}, {"$inc": {"nation": 1}})
    return customers.find({"nation": 7}, projection={"_id": True})


@_add("audit_log", "SELECT * FROM (VALUES ('create index', true, 1::BIGINT), ('insert', false, 1), ('update', true, 2)) AS t(operation, ok, n)")
def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, audit=True)
    customers = db.collection("customers")
    customers.create_index(["nation"])
    for k in (1, 2):
        customers.update_many({"nation": k}, {"$inc": {"c_acctbal": 1}})
    try:
        customers.insert(customers.df().limit(1))
    except updates.UpdateError:
        pass
    return db.log("audit").groupBy("operation", "ok").agg(F.count(F.lit(1)).alias("n"))


# ---- transactions, backup, migrations


@_add("transaction_savepoint", f"SELECT _id, nation FROM {_C} WHERE nation >= 5")
def _savepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir)
    with db.transaction() as t:
        t.stage("customers", updates.delete(t.rows("customers"), {"nation": {"$lt": 5}}))
        t.savepoint("kept")
        t.stage("customers", updates.delete(t.rows("customers"), {}))
        t.rollback_to("kept")
        t.release("kept")
    return db.read("customers").select("_id", "nation")


@_add("snapshot_isolation", f"SELECT _id, c_acctbal + 1 AS c_acctbal, c_acctbal AS before, true AS refused FROM {_C}")
def _isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two transactions over one version the second to commit is refused, and an old version reads as it was."""
    db = _db(spark, sf_dir)
    opened, refused = db.version(), False
    try:
        with db.transaction() as t:
            t.stage("customers", t.rows("customers").limit(0))
            db.collection("customers").update_many({}, {"$inc": {"c_acctbal": 1}})
    except Conflict:
        refused = True
    old = db.read("customers", opened).select("_id", F.col("c_acctbal").alias("before"))
    return db.read("customers").select("_id", "c_acctbal").join(old, "_id").withColumn("refused", F.lit(refused))


@_add("backup_restore", f"SELECT _id, c_name, c_acctbal, nation FROM {_C}")
def _backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, copy = _db(spark, sf_dir), folder(spark, "backup")
    db.migrate([("nothing", lambda d: None, lambda d: None)])
    db.collection("customers").create_index(["nation"])
    db.backup(copy)
    db.collection("customers").delete_many({})
    db.drop("customers")
    db.restore(copy)
    customers = db.collection("customers")
    if db.migrations() != ["nothing"] or customers.indexes() != ["_id_", "nation_1"]:
        raise AssertionError("a backup has the history and the indexes")
    return customers.df()


@_add("migrations", f"SELECT _id, c_acctbal * 2 AS c_acctbal, 'a,b' AS ran FROM {_C} WHERE nation <> 1")
def _migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir)
    of = lambda d: d.collection("clients")
    steps = [
        ("a", lambda d: d.rename("customers", "clients"), lambda d: d.rename("clients", "customers")),
        ("b", lambda d: (of(d).delete_many({"nation": 1}), of(d).update_many({}, {"$mul": {"c_acctbal": 2}})), lambda d: None),
        ("c", lambda d: of(d).update_many({}, {"$unset": {"c_acctbal": ""}}), lambda d: db.restore(copy)),
    ]
    db.migrate(steps, to=2)
    copy = folder(spark, "before")
    db.backup(copy)
    db.migrate(steps)
    ran = db.migrate(steps, to=2)
    return of(db).df().select("_id", "c_acctbal", F.lit(",".join(ran)).alias("ran"))


@_add("cursor_batches", "SELECT o_orderkey, o_totalprice FROM orders")
def _cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, path = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), folder(spark, "batches")
    orders.limit(0).write.parquet(path)
    cursor, held = Cursor(orders, 500), []
    while cursor.has_next():
        held += cursor.next_batch()
        if len(held) >= HELD_ROWS or not cursor.has_next():
            columns = [pa.array(c, t) for c, t in zip(zip(*held), to_arrow_schema(orders.schema).types)]
            spark.createDataFrame(pa.table(columns, names=orders.columns), orders.schema).coalesce(1).write.mode("append").parquet(path)
            held = []
    return spark.read.schema(orders.schema).parquet(path)


# ---- searches


def words_of_stem(wanted: str) -> list[str]:
    """Words with a stem: those that it makes with up to two usual endings."""
    endings = "s es ed ing ings er ers ly ness ion ions ation ations al ally e y i ies ied able ible ment ments ement ent ant ance ence ful est ive iveness ity iti ize ized izer ism ic ical icate ate ative al ou ous ousness fulness ousli logi entli eli bli".split()
    roots = {wanted, wanted + wanted[-1], wanted + "e", wanted[:-1] + "y", wanted + "at", wanted + "iz", wanted + "bl"}
    return sorted({w for root in roots for a, b in product(["", *endings], repeat=2) if stem(w := root + a + b) == wanted})


def bm25_sql(query: str, stemmed: bool) -> str:
    """BM25 of a query over ``documents`` as SQL: ``id, score``."""
    wanted = text.query_tokens(query, stemmed)
    rows = [(w, t, wanted.count(t)) for t in dict.fromkeys(wanted) for w in (words_of_stem(t) if stemmed else [t])]
    stop = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    values = ", ".join(f"('{w}', '{t}', {n}.0::DOUBLE)" for w, t, n in rows)
    return f"""
WITH d AS (
  SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)), lambda w: strlen(w) >= 2 AND w NOT IN ({stop})) AS ts FROM documents WHERE text IS NOT NULL
), n AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM d
), q(word, token, times) AS (VALUES {values}
), tf AS (SELECT id, dl, token, times, count(*)::DOUBLE AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS word FROM d) JOIN q USING (word) GROUP BY ALL
), df AS (SELECT token, count(*)::DOUBLE AS df FROM tf GROUP BY token)
SELECT id, sum(times * ln((n.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (token), n GROUP BY id
"""


_KEPT: dict[tuple[str, str, str], Database] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[Database], None]) -> Database:
    """A database that the session makes once for a data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        db = Database(spark, folder(spark, name))
        make(db)
        _KEPT[key] = db
    return _KEPT[key]


def _indexed_text(spark: SparkSession, sf_dir: str, stemmed: bool):
    def make(db: Database) -> None:
        documents = db.create("documents", _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), "text"))
        documents.create_text_index(["text"], stemmed=stemmed)

    return _kept(spark, sf_dir, f"text-{stemmed}", make).collection("documents")


def _ranked(found: DataFrame) -> DataFrame:
    return found.select(F.col("_id").alias("id"), F.round("_textScore", 6).alias("score"))


STEMMED, PLAIN = "attions ending", "attion the anonin attion"


@_add("text_index_search", f"SELECT id, round(score, 6) AS score FROM ({bm25_sql(PLAIN, False)})")
def _text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_indexed_text(spark, sf_dir, False).text_search(PLAIN, projection={"_id": True, "_textScore": True}))


@_add("text_index_stemmed", f"SELECT id, round(score, 6) AS score FROM ({bm25_sql(STEMMED, True)})")
def _text_index_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_indexed_text(spark, sf_dir, True).text_search(STEMMED, projection={"_id": True, "_textScore": True}))


@_add("text_filter", f"SELECT doc_id, n_chars FROM documents JOIN ({bm25_sql(STEMMED, True)}) ON id = doc_id WHERE n_chars < 2000")
def _text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"$text": {"$search": STEMMED, "$fields": ["text"], "$id": "doc_id"}, "n_chars": {"$lt": 2000}}
    return find(_table(spark, sf_dir, "documents"), wanted, projection={"doc_id": True, "n_chars": True})


_TOKENS = "list_filter(list_transform(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda x: lower(x)), lambda w: strlen(w) >= 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "))"


@_add("text_positions", f"SELECT doc_id AS id, len(ts) AS n, ts[1] AS first, ts[len(ts)] AS last FROM (SELECT doc_id, {_TOKENS} AS ts FROM documents WHERE text IS NOT NULL) WHERE len(ts) > 0")
def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.positions(_table(spark, sf_dir, "documents"), ["text"], "doc_id")
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min_by("token", "position").alias("first"), F.max_by("token", "position").alias("last"))


_PLACES = "(SELECT c_custkey, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) + 0.25 AS lon, CAST(c_custkey * 53 % 180 - 90 AS DOUBLE) + 0.25 AS lat FROM customer)"
_HAV = "sin(radians(10 - lat) / 2) * sin(radians(10 - lat) / 2) + cos(radians(lat)) * cos(radians(10.0)) * sin(radians(20 - lon) / 2) * sin(radians(20 - lon) / 2)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.expr("cast(c_custkey * 37 % 360 - 180 as double) + 0.25").alias("lon"), F.expr("cast(c_custkey * 53 % 180 - 90 as double) + 0.25").alias("lat")
    return _table(spark, sf_dir, "customer").select("c_custkey", lon, lat)


def _indexed_places(spark: SparkSession, sf_dir: str):
    def make(db: Database) -> None:
        places = db.create("places", _places(spark, sf_dir).withColumnRenamed("c_custkey", "_id"))
        places.create_geo_index(("lon", "lat"))
        places.create_geo_index(("lon", "lat"), spherical=False)

    return _kept(spark, sf_dir, "places", make).collection("places")


@_add("geo_index_within", f"SELECT c_custkey AS _id, lon, lat FROM {_PLACES} WHERE lon BETWEEN -50 AND 60 AND lat BETWEEN -40 AND 50 AND NOT (lon BETWEEN 0 AND 20 AND lat BETWEEN 0 AND 20)")
def _geo_index_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed_places(spark, sf_dir).geo_within(("lon", "lat"), [[(-50, -40), (60, -40), (60, 50), (-50, 50)], [(0, 0), (20, 0), (20, 20), (0, 20)]])


@_add("geo_index_near", f"SELECT c_custkey AS _id, round(2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)), 2) AS _distance FROM (SELECT *, {_HAV} AS a FROM {_PLACES}) WHERE 2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)) <= 3000000")
def _geo_index_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed_places(spark, sf_dir).near(("lon", "lat"), (20, 10), 3_000_000).select("_id", F.round("_distance", 2).alias("_distance"))


@_add("geo_filter", f"SELECT c_custkey FROM {_PLACES} WHERE lon BETWEEN -20 AND 30 AND lat BETWEEN -10 AND 40")
def _geo_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = _places(spark, sf_dir).select("c_custkey", F.struct("lon", "lat").alias("at"))
    return find(located, {"at": {"$geoIntersects": {"$box": [(-20, -10), (30, 40)]}}}, projection={"c_custkey": True})


@_add("geo_grid", f"SELECT floor(lon / 10)::BIGINT AS cx, floor(lat / 10)::BIGINT AS cy, count(*) AS n FROM {_PLACES} GROUP BY 1, 2")
def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).groupBy(geo.grid_cell(F.col("lon"), F.col("lat"), 10.0).alias("cell")).agg(F.count(F.lit(1)).alias("n")).select("cell.cx", "cell.cy", "n")


# ---- routing and statistics

_MOD = 1 << 64
_BYTES = ", ".join(f"((k >> {shift}) & 255)::HUGEINT" for shift in range(56, -8, -8))
_FNV = f"list_reduce([{_BYTES}], lambda h, b: (xor(h, b) * {routing.FNV_PRIME}::HUGEINT) % {_MOD}::HUGEINT, {routing.FNV_OFFSET}::HUGEINT)"


def hash_shards_sql(key: str, table: str, shards: int) -> str:
    """``k, shard``: FNV-1a of a whole-number key, as SQL."""
    return f"SELECT k, ({_FNV} % {shards})::INT AS shard FROM (SELECT {key}::BIGINT AS k FROM {table})"


@_add("route_to_shard", f"SELECT k, shard, 4 AS everywhere FROM ({hash_shards_sql('n_nationkey', 'nation', 4)})")
def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [r.n_nationkey for r in _table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    everywhere = len(routing.route({"k": {"$gt": 3}}, ["k"], 4))
    return spark.createDataFrame([(k, routing.route({"k": k, "other": 1}, ["k"], 4)[0], everywhere) for k in keys], "k long, shard int, everywhere int")


@_add("chunks", "SELECT * FROM (VALUES (NULL::BIGINT, 10::BIGINT, 0), (10, 25, 2), (25, NULL, 1)) AS t(low, high, shard)")
def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, rest = routing.split_chunk((None, None, 0), 10)
    second, third = routing.split_chunk(rest, 25)
    return spark.createDataFrame([first, routing.move_chunk(second, 2), routing.move_chunk(third, 1)], "low long, high long, shard int")


@_add(
    "selectivity",
    """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS t, (max(o_totalprice) - min(o_totalprice)) / 8 AS w FROM orders),
       h AS (SELECT least(floor((o_totalprice - lo) / w), 7) AS k, lo, w, t, count(*) AS n FROM orders, b GROUP BY ALL)
       SELECT round(sum(n / t::DOUBLE * greatest(least(lo + (k + 1) * w, 250000) - greatest(lo + k * w, 50000), 0) / w), 6) AS part FROM h""",
)
def _selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stats.histogram(_table(spark, sf_dir, "orders"), "o_totalprice", 8).collect()
    return spark.createDataFrame([(round(stats.selectivity(h, 50000, 250000), 6),)], "part double")


# ---- changes


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "signup", 0).when(kind == "purchase", 1).when(kind == "error", 2).otherwise(7)
    doc = F.concat(F.lit('{"_id": "'), F.col("user_id").cast("string"), F.lit('", "value": 1}'))
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("op_id"), F.col("ts").cast("timestamp").alias("ts"), op.cast("tinyint").alias("op"), F.lit("shop").alias("db"), F.lit("users").alias("coll"),
        F.col("user_id").cast("string").alias("doc_id"), F.when(op == 0, doc).alias("doc"), F.when(op == 1, '{"$set": {"a": 1}}').alias("update"), F.lit(None).cast("string").alias("filter"), F.lit(None).cast("string").alias("index_def"),
    )


_KINDS = "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'update' ELSE 'delete' END"


@_add("log_since", "SELECT event_id AS op_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 7 END AS op FROM events WHERE event_id > 250")
def _oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = folder(spark, "log")
    changes.append(_entries(spark, sf_dir), log)
    return changes.entries_since(spark, log, 250).select("op_id", F.col("op").cast("int").alias("op"))


def _streamed(spark: SparkSession, sf_dir: str, parts: Sequence[str], **options) -> DataFrame:
    """The sink of a stream that is stopped and started again after each part of the log."""
    log, sink, at = (folder(spark, x) for x in ("log", "sink", "progress"))
    for part in parts:
        changes.append(_entries(spark, sf_dir).where(part), log)
        changes.stream(spark, log, sink, at, **options).awaitTermination()
    return spark.read.parquet(sink)


@_add("change_stream", f'SELECT event_id AS token, {_KINDS} AS "operationType", user_id::VARCHAR AS "documentKey" FROM events WHERE event_type IN (\'signup\', \'purchase\', \'error\') AND event_id > 50')
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, ["op_id % 2 = 0", "op_id % 2 = 1"], database="shop", resume_after=50).select("token", "operationType", "documentKey")


@_add("change_stream_pipeline", "SELECT event_id AS token FROM events WHERE event_type = 'error'")
def _stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, ["true"], collection="users", pipeline=[{"$match": {"operationType": "delete"}}, {"$sort": {"token": 1}}]).select("token")


@_add("change_events_current", "SELECT event_id AS token, n.n_name AS name FROM events LEFT JOIN nation n ON n.n_nationkey = user_id % 1000000 WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05'")
def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates from a time on, each with its document as the table has it now."""
    found = changes.watch(changes.events(_entries(spark, sf_dir), start_at=datetime(2024, 1, 5)), filter={"operationType": "update"})
    now = changes.with_current(found, _table(spark, sf_dir, "nation").withColumn("_id", F.col("n_nationkey").cast("string")))
    return now.select("token", F.get_json_object("fullDocument", "$.n_name").alias("name"))
