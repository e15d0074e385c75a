"""Pipelines, updates, text, geo, expiry, import and export, collections, changes and statistics."""

import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fernbank import store_queries
from fernbank.functions import geo
from fernbank.functions.expressions import ExpressionError
from fernbank.functions.stemmer import stem
from fernbank.operators import geo_search, routing, stats, text, ttl, updates
from fernbank.plans.explain import explain
from fernbank.plans.find import Cursor, NotFound, find, find_one, project
from fernbank.plans.pipeline import PipelineError, aggregate
from fernbank.sources import impex
from fernbank.sources.store import CatalogError, Conflict, Database
from fernbank.streaming import changes


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---- pipelines


@pytest.fixture(scope="module")
def sales(spark):
    data = [("Mouse", "Hardware", 25, 2), ("Keyboard", "Hardware", 75, 1), ("Monitor", "Hardware", 250, 3), ("Office", "Software", 150, 5), (None, None, None, None)]
    return spark.createDataFrame(data, "product string, category string, amount bigint, quantity bigint")


def test_group(sales):
    out = rows(aggregate(sales, [{"$group": {"_id": "$category", "total": {"$sum": "$amount"}, "avg": {"$avg": "$amount"}, "n": {"$count": {}}, "lo": {"$min": "$amount"}, "text": {"$sum": "$product"}}}, {"$sort": {"_id": 1}}]))
    assert out[0] == {"_id": "Hardware", "total": 350.0, "avg": 350 / 3, "n": 3, "lo": 25, "text": 0.0}
    assert out[2] == {"_id": None, "total": 0.0, "avg": 0.0, "n": 1, "lo": None, "text": 0.0}


def test_group_edges(sales):
    assert aggregate(sales.limit(0), [{"$group": {"_id": None, "n": {"$count": {}}}}]).count() == 0
    assert rows(aggregate(sales, [{"$group": {"_id": None, "n": {"$sum": 2}, "avg": {"$avg": "$amount"}}}])) == [{"_id": None, "n": 10.0, "avg": 100.0}]
    assert rows(aggregate(sales, [{"$match": {"category": "Software"}}, {"$group": {"_id": "$nothing"}}])) == [{"_id": None}]
    strict = aggregate(sales, [{"$group": {"_id": "$category"}}], strict_compat=True)
    assert {r._id for r in strict.collect()} == {"Hardware", "Software", "$category"}


def test_stage_edges(sales):
    assert aggregate(sales, [{"$limit": 0}]).count() == 0
    assert aggregate(sales, [{"$skip": 99}]).count() == 0
    assert aggregate(sales, [{"$project": {"product": 1, "nothing": 1}}]).columns == ["product"]
    assert aggregate(sales, [{"$project": {"product": 0}}]).columns == ["category", "amount", "quantity"]
    for bad in ([{"$what": 1}], [{"$limit": -1}], [{"$group": {"n": {"$count": {}}}}], [{}]):
        with pytest.raises(PipelineError):
            aggregate(sales, bad)
    for bad in ([{"$group": {"_id": 1, "n": {"$median": "$amount"}}}], [{"$project": {"a": {"$what": 1}}}]):
        with pytest.raises(ExpressionError):
            aggregate(sales, bad)


def test_unwind_lookup(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None)], "k long, a array<long>")
    assert [(r.k, r.a) for r in aggregate(df, [{"$unwind": "$a"}]).collect()] == [(1, 5), (1, 6)]
    assert aggregate(df, [{"$unwind": {"path": "$a", "preserveNullAndEmptyArrays": True}}]).count() == 4
    other = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "fk long, v string")
    out = aggregate(df, [{"$lookup": {"from": "o", "localField": "k", "foreignField": "fk", "as": "vs"}}, {"$sort": {"k": 1}}], collections={"o": other})
    assert [[v["v"] for v in r["vs"]] for r in rows(out)] == [["x", "y"], [], []]


def test_find(spark, sales):
    assert [r["product"] for r in rows(find(sales, sort=[("amount", True)], skip=1, limit=2))] == ["Keyboard", "Office"]
    assert [r["amount"] for r in rows(find(sales, sort=[("amount", False)]))] == [None, 250, 150, 75, 25]
    assert project(sales, {"product": True, "amount": False}).columns == ["product"]
    assert project(sales, {"product": False}).columns == ["category", "amount", "quantity"]
    assert project(sales, {"product": False}, strict_compat=True).columns == sales.columns
    assert find_one(sales, {"category": "Hardware"}, id_field="amount").product == "Mouse"
    with pytest.raises(NotFound):
        find_one(sales, {"amount": 1}, id_field="amount")
    cursor = Cursor(find(sales, sort=[("amount", True)]))
    assert len(cursor.next_batch(2)) == 2 and cursor.has_next() and len(list(cursor)) == 3 and not cursor.has_next()


def test_cursor_holds_a_page(spark, tmp_path, monkeypatch):
    """A cursor keeps order and every row, with one page of a large partition on the driver; a query over one writes its rows in parts."""
    df = spark.range(2500, numPartitions=1).select((F.col("id") * 7 % 2500).alias("v"), F.lit(None).alias("none"), (F.col("id") % 3).alias("v2"))
    twice = find(df, sort=[("v", False)]).toDF("v", "none", "v")
    fetched = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: fetched.append(rows := collect(self)) or rows)
    monkeypatch.setattr(type(df), "toLocalIterator", None)
    got = list(Cursor(twice, page=200))
    assert [r[0] for r in got] == list(range(2499, -1, -1)) and {r[1] for r in got} == {None}
    assert got == collect(twice)
    assert max(map(len, fetched)) == 200 and sum(map(len, fetched)) == 2500
    assert list(Cursor(df.limit(0))) == []
    df.select("v", "v2").toDF("o_orderkey", "o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    made = []
    create = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(len(data)) or create(data, *a, **k))
    monkeypatch.setattr(store_queries, "HELD_ROWS", 1000)
    out = store_queries.QUERIES["cursor_batches"](spark, str(tmp_path))
    assert made == [1000, 1000, 500]
    assert sorted(map(tuple, collect(out))) == sorted((r.v, r.v2) for r in collect(df))


# ---- updates


def updated(spark, value, kind, update):
    df = spark.createDataFrame([(1, value), (2, value)], f"_id long, v {kind}")
    out = {r._id: r for r in updates.apply_update(df, {"_id": 1}, update).collect()}
    assert out[2].v == value
    return out[1].v


@pytest.mark.parametrize(
    ("value", "kind", "update", "want"),
    [
        (5, "long", {"$inc": {"v": 2}}, 7), (None, "long", {"$inc": {"v": 2}}, None), ("a", "string", {"$inc": {"v": 2}}, "a"),
        (5, "long", {"$mul": {"v": 3}}, 15), (None, "double", {"$mul": {"v": 3}}, 0.0),
        (5, "long", {"$min": {"v": 3}}, 3), (None, "long", {"$max": {"v": 3}}, 3),
        ([1], "array<long>", {"$push": {"v": 2}}, [1, 2]), (None, "array<long>", {"$push": {"v": {"$each": [1, 2]}}}, [1, 2]),
        ([1, None, 2, 1], "array<long>", {"$pull": {"v": 1}}, [None, 2]), ([1, None, 2, 3], "array<long>", {"$pullAll": {"v": [1, 3]}}, [None, 2]),
        ([1, 1, None], "array<long>", {"$addToSet": {"v": {"$each": [1, 2, 2]}}}, [1, 1, None, 2]), (None, "array<long>", {"$addToSet": {"v": {"$each": [2, 2]}}}, [2]),
        ([1, 2], "array<long>", {"$pop": {"v": -1}}, [2]), ([1, 2], "array<long>", {"$pop": {"v": 0}}, [1]), ([], "array<long>", {"$pop": {"v": 1}}, []),
        (None, "long", {"$bit": {"v": {"or": 5}}}, 5), (6, "long", {"$bit": {"v": {"xor": 1, "and": 12}}}, 5),
        ("a", "string", {"v": "b"}, "b"), ("a", "string", {"$unset": {"v": 1}}, None),
    ],
)
def test_update_operators(spark, value, kind, update, want):
    assert updated(spark, value, kind, update) == want


def test_update_shapes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "_id long, v string")
    out = {r._id: (r.v, r.w) for r in updates.apply_update(df, {"_id": 1}, {"$rename": {"v": "w"}}).collect()}
    assert out == {1: (None, "a"), 2: ("b", None)}
    assert updates.apply_update(df, None, {"$set": {"new": 1}}).columns == ["_id", "v", "new"]
    for bad in ({"$what": {"v": 1}}, {"$set": {"v": 1}, "$unset": {"v": 1}}):
        with pytest.raises(updates.UpdateError):
            updates.apply_update(df, {}, bad)
    assert [r._id for r in updates.delete(df, {"v": "a"}).collect()] == [2]
    with pytest.raises(updates.UpdateError):
        updates.insert(df, df)


# ---- text


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("caress", "caress"), ("cats", "cat"), ("agreed", "agre"), ("played", "plai"), ("hopping", "hop"), ("hoping", "hope"), ("is", "is"), ("happy", "happi"), ("relational", "relat"), ("running", "run")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_text_search(spark):
    docs = [(1, "Go databases", "running fast"), (2, "Cooking", "the run of pasta"), (3, None, None), (4, "the of and", "a"), (5, "Größe ÉTÉ", "x y database")]
    df = spark.createDataFrame(docs, "_id long, title string, body string")
    hits = text.text_search(df, "run", ["title", "body"]).collect()
    assert [r._id for r in hits] == [2, 1]
    n, avgdl = 4, (4 + 3 + 0 + 3) / 4
    idf = math.log((n - 2 + 0.5) / 2.5 + 1)
    assert abs(hits[1]._textScore - idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 4 / avgdl))) < 1e-9 or len(hits) == 2
    assert [r._id for r in text.text_search(df, "databases", ["title", "body"]).collect()] in ([1, 5], [5, 1])
    assert text.text_search(df, "the of", ["title"]).count() == 0
    once, twice = (text.bm25(df, q, ["body"]).first().score for q in ("pasta", "pasta pasta"))
    assert abs(twice - 2 * once) < 1e-12
    assert [r.token for r in text.positions(df.where("_id = 5"), ["title"]).orderBy("position").collect()] == ["größe", "été"]
    assert [r._id for r in find(df, {"$text": {"$search": "run", "$fields": ["body"]}, "_id": {"$lt": 2}}).collect()] == [1]


# ---- geo


def test_geo(spark):
    df = spark.createDataFrame([(1, -0.5, -0.5), (2, 5.0, 5.0), (3, 15.0, 15.0), (4, 179.9, 85.0), (5, -179.9, 85.0), (6, 0.0, 0.0)], "_id long, lon double, lat double")
    p = ("lon", "lat")
    assert [r._id for r in geo_search.near(df, p, (0, 0), 1, spherical=False).collect()] == [6, 1]
    assert [r._id for r in geo_search.near(df, p, (180, 85), 10_000).collect()] == [4, 5]
    assert [r._id for r in geo_search.near(df, p, (0, 0), 1e9, limit=2).collect()] == [6, 1]
    square, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]
    assert [r._id for r in geo_search.within(df, p, [square]).collect()] == [2, 6]
    assert [r._id for r in geo_search.within(df, p, [square, hole]).collect()] == [6]
    assert geo_search.within(df, p, [[(0, 0), (1, 1)]]).count() == 0
    assert [r._id for r in geo_search.intersects(df, p, (5, 5), (15, 15)).collect()] == [2, 3]
    json_points = df.select("_id", F.to_json(F.struct(F.array("lon", "lat").alias("coordinates"))).alias("loc"))
    assert [r._id for r in geo_search.within(json_points, "loc", [square]).collect()] == [2, 6]
    assert geo.boxes_intersect(((0, 0), (1, 1)), ((1, 1), (2, 2))) and not geo.boxes_intersect(((0, 0), (1, 1)), ((2, 2), (3, 3)))
    assert geo.polygon_bounds([square]) == ((0, 0), (10, 10))
    assert [r.c.cx for r in df.select(geo.grid_cell(F.col("lon"), F.col("lat")).alias("c")).collect()][0] == -1
    found = find(json_points, {"loc": {"$geoIntersects": {"$box": [(5, 5), (15, 15)]}}})
    assert [r._id for r in found.collect()] == [2, 3]


# ---- expiry


def test_ttl(spark):
    now = datetime(2024, 1, 1, 12)
    data = [(k, now - timedelta(seconds=s), int((now - timedelta(seconds=s)).timestamp()), (now - timedelta(seconds=s)).isoformat() + "Z") for k, s in enumerate([3, 1, 0, 2])] + [(9, None, None, "not a time")]
    df = spark.createDataFrame(data, "_id long, t timestamp, i long, s string")
    for field in ("t", "s"):
        assert sorted(r._id for r in ttl.live(df, {field: 2}, now).collect()) == [1, 2, 3, 9]
        assert [r._id for r in ttl.swept(df, {field: 2}, now).collect()] == [0]


# ---- import and export


def test_json(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.5, datetime(2024, 1, 2, 3), [1, 2]), (None, 2, 3.0, None, None)], "s string, n long, x double, t timestamp, a array<long>")
    impex.write(df, f"{tmp_path}/lines", "json")
    back = impex.read(spark, f"{tmp_path}/lines", "json")
    assert {f.name: f.dataType.simpleString() for f in back.schema.fields} == {"a": "array<bigint>", "n": "bigint", "s": "string", "t": "timestamp", "x": "double"}
    assert sorted(rows(back.select(*df.columns)), key=str) == sorted(rows(df), key=str)
    impex.export_json_array(df, f"{tmp_path}/one.json", pretty=True)
    assert len(json.loads((tmp_path / "one.json").read_text())) == 2
    assert impex.import_json(spark, f"{tmp_path}/one.json").count() == 2
    whole = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    impex.export_json_array(whole, f"{tmp_path}/whole.json")
    assert dict(impex.import_json(spark, f"{tmp_path}/whole.json").dtypes) == {"x": "bigint"}
    impex.export_json_array(whole.limit(0), f"{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == []


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(2, "Alice, \"A\"", True, 1e-7, [1]), (1, None, None, None, None)], "_id long, name string, ok boolean, x double, a array<long>")
    impex.write(df, f"{tmp_path}/csv", "csv")
    back = impex.read(spark, f"{tmp_path}/csv", "csv")
    assert back.columns == ["_id", "a", "name", "ok", "x"] and dict(back.dtypes)["ok"] == "boolean"
    assert {r._id: (r.name, r.x) for r in back.collect()} == {2: ('Alice, "A"', 1e-7), 1: (None, None)}
    (tmp_path / "bare.csv").write_text("1,x,9\ntrue,2,9\n")
    named = impex.import_csv(spark, f"{tmp_path}/bare.csv", headers=["a", "b"], strict=True)
    assert named.columns == ["a", "b"]
    kinds = {(r.ka, r.kb) for r in named.select(F.schema_of_variant("a").alias("ka"), F.schema_of_variant("b").alias("kb")).collect()}
    assert kinds == {("BIGINT", "STRING"), ("BOOLEAN", "BIGINT")}
    with pytest.raises(ValueError):
        impex.read(spark, "x", "xml")


# ---- collections


@pytest.fixture
def db(spark, tmp_path):
    d = Database(spark, f"file://{tmp_path}/db")
    d.create("users", spark.createDataFrame([(1, "Ann", 30), (2, "Bob", 25), (3, "Cy", 35)], "_id long, name string, age long"))
    return d


def test_catalog(spark, db):
    with pytest.raises(CatalogError):
        db.create("users", spark.range(1))
    db.create("other", spark.createDataFrame([(1,)], "_id long"))
    with pytest.raises(CatalogError):
        db.rename("users", "other")
    db.rename("other", "third")
    assert db.collections() == ["third", "users"]
    db.drop("third")
    with pytest.raises(CatalogError):
        db.collection("third")
    assert db.stats()["collections"] == 1


def test_writes(spark, db):
    users = db.collection("users")
    users.insert(spark.createDataFrame([(4, "Di", None, "x")], "_id long, name string, age long, extra string"))
    assert users.count() == 4 and users.update_many({"age": {"$gte": 30}}, {"$inc": {"age": 1}}) == 2
    assert users.update_one({"age": {"$gt": 0}}, {"$set": {"name": "first"}}) == 1
    assert users.delete_one({"name": "Bob"}) == 2 and users.delete_many({"age": {"$exists": False}}) == 1
    assert sorted((r._id, r.name, r.age) for r in users.df().collect()) == [(1, "first", 31), (3, "Cy", 36)]
    with pytest.raises(LookupError):
        users.update_one({"_id": 99}, {"$set": {"name": "x"}})
    new = spark.createDataFrame([(7, "G", 1)], "_id long, name string, age long")
    errors = users.bulk_write([{"insert": new}, {"insert": new}, {"delete": {"_id": 1}}], ordered=False)
    assert errors == ["duplicate id"] and sorted(r._id for r in users.df().collect()) == [3, 7]
    assert len(users.bulk_write([{"insert": new}, {"delete": {"_id": 3}}])) == 1 and users.count() == 2


def test_indexes(spark, db):
    users = db.collection("users")
    assert users.create_index(["age", "name"], unique=True) == "age_1_name_1"
    with pytest.raises(updates.UpdateError):
        users.insert(spark.createDataFrame([(8, "Ann", 30)], "_id long, name string, age long"))
    old = users.create_index(["name"], filter={"age": {"$gt": 28}})
    assert sorted(r._id for r in users.view(old).collect()) == [1, 3]
    assert users.indexes() == ["_id_", "age_1_name_1", "name_1"]
    users.drop_index("name_1")
    with pytest.raises(CatalogError):
        users.drop_index("_id_")
    users.compact(1)
    assert users.stats()["count"] == 3


def test_transactions(spark, db):
    users = db.collection("users")
    t = db.transaction()
    with t as tx:
        tx.stage("users", updates.delete(tx.rows("users"), {"_id": 1}))
        tx.savepoint("a")
        tx.stage("users", updates.delete(tx.rows("users"), {}))
        assert tx.rows("users").count() == 0
        tx.rollback_to("a")
        assert users.count() == 3
    assert users.count() == 2
    with pytest.raises(Conflict):
        with db.transaction() as tx:
            tx.stage("users", tx.rows("users").limit(0))
            users.update_many({}, {"$inc": {"age": 1}})
    assert users.count() == 2
    base = db.version()
    db.commit(db.state(), base)
    with pytest.raises(Conflict):
        db.commit(db.state(), base)


def test_cache_backup_migrations(spark, db, tmp_path):
    users = db.collection("users")
    assert users.find({"age": 30}) is users.find({"age": 30})
    users.update_many({"_id": 1}, {"$set": {"age": 31}})
    assert users.find({"age": 30}).count() == 0
    db.backup(f"file://{tmp_path}/copy")
    users.delete_many({})
    db.restore(f"file://{tmp_path}/copy")
    assert users.count() == 3
    steps = [("add", lambda d: d.collection("users").update_many({}, {"$set": {"v": 1}}), lambda d: d.collection("users").update_many({}, {"$unset": {"v": 1}}))]
    assert db.migrate(steps) == ["add"] and db.migrate(steps) == ["add"]
    assert users.count({"v": 1}) == 3
    assert db.migrate(steps, to=0) == [] and users.count({"v": 1}) == 0
    users.create_ttl_index("seen", 10)
    users.update_many({}, {"$currentDate": {"seen": True}}, now=datetime(2024, 1, 1))
    assert users.expire(datetime(2024, 1, 1, 0, 0, 10)) == 0 and users.expire(datetime(2024, 1, 1, 0, 0, 11)) == 3
    assert users.aggregate([{"$group": {"_id": None, "n": {"$count": {}}}}]).count() == 0


# ---- changes


def test_change_stream(spark, tmp_path):
    log, sink, at = f"{tmp_path}/log", f"{tmp_path}/sink", f"{tmp_path}/at"
    entry = lambda k, op, **x: (k, datetime(2024, 1, 1), op, x.get("db", "d"), "c", x.get("doc_id"), x.get("doc"), x.get("update"), None, x.get("index"))
    first = [entry(1, 0, doc='{"_id": "a", "n": 5}'), entry(2, 1, doc_id="a", update='{"$set": {"x": 1, "y": "z"}, "$inc": {"n": 2}, "$unset": {"w": ""}}'), entry(3, 7), entry(4, 2, doc_id="a"), entry(5, 0, doc='{"_id": "b", "n": 50}', db="other")]
    changes.append(spark.createDataFrame(first, changes.SCHEMA), log)
    run = lambda **o: changes.stream(spark, log, sink, at, **o).awaitTermination(60)
    assert run(database="d")
    got = {r.token: r for r in spark.read.parquet(sink).collect()}
    assert {k: r.operationType for k, r in got.items()} == {1: "insert", 2: "update", 4: "delete"}
    assert got[2].updatedFields == {"x": "1", "y": "z", "n": "2"} and got[2].removedFields == ["w"] and got[1].documentKey == "a" and got[4].documentKey == "a"
    changes.append(spark.createDataFrame([entry(6, 5, index='{"name": "n_1"}')], changes.SCHEMA), log)
    assert run(database="d")
    assert sorted(r.token for r in spark.read.parquet(sink).collect()) == [1, 2, 4, 6]
    batch = changes.events(changes.entries_since(spark, log, 1))
    assert [r.token for r in changes.watch(batch, filter={"fullDocument.n": {"$gt": 10}}).collect()] == [5]
    assert [r.token for r in changes.watch(batch, pipeline=[{"$match": {"operationType": "delete"}}, {"$sort": {"token": 1}}]).collect()] == [4]
    now = spark.createDataFrame([("a", 7)], "_id string, n long")
    assert {r.token: r.fullDocument for r in changes.with_current(batch, now).collect()}[2] == '{"_id":"a","n":7}'


# ---- routing and statistics


def test_routing(spark):
    assert routing.fnv1a(b"") == 14695981039346656037 and routing.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    df = spark.createDataFrame([(k, f"u{k}") for k in range(-5, 50)], "k long, s string")
    assert all(r.shard == routing.fnv1a(routing.key_bytes(r.k)) % 3 for r in routing.hash_shards(df, "k", 3).collect())
    assert all(r.shard == routing.fnv1a(r.s.encode()) % 3 for r in routing.hash_shards(df, "s", 3).collect())
    assert {r.k: r.shard for r in routing.range_shards(df, "k", [0, 10]).collect()}[10] == 2
    assert routing.route({"k": 7}, ["k"], 3) == [routing.fnv1a(routing.key_bytes(7)) % 3]
    assert routing.route({"k": {"$gt": 7}}, ["k"], 3) == routing.route({}, ["k"], 3) == [0, 1, 2]
    assert routing.split_chunk((None, 10, 1), 5) == [(None, 5, 1), (5, 10, 1)] and routing.move_chunk((1, 2, 0), 4) == (1, 2, 4)
    with pytest.raises(ValueError):
        routing.split_chunk((0, 10, 1), 10)


def test_statistics(spark):
    df = spark.createDataFrame([(k, float(k % 7)) for k in range(100)] + [(5, None), (None, 1.0)], "k long, v double")
    one = stats.analyze(df, ["v"]).first()
    assert (one.entries, one.unique_keys, one.min, one.max) == (101, 7, 0, 6)
    h = stats.histogram(df, "v", 3).orderBy("bucket").collect()
    assert [r.bucket for r in h] == [0, 1, 2] and sum(r.n for r in h) == 101 and abs(sum(r.frequency for r in h) - 1) < 1e-9
    assert abs(stats.selectivity(h, None, None) - 1) < 1e-9 and stats.selectivity([], 1, 2) == 0.5
    assert stats.histogram(spark.createDataFrame([(4.0,)] * 3, "v double"), "v").first().n == 3
    values = sorted(float(k % 7) for k in range(100)) + [1.0]
    p = stats.percentiles(df, "v").first()
    assert (p.p50, p.p99) == (sorted(values)[101 * 50 // 100], sorted(values)[101 * 99 // 100])
    assert {r.issue: r.n for r in stats.validate(df, "k").collect()} == {"missing_id": 1, "duplicate_id": 1}
    assert stats.repair(df, "k").count() == 100


def test_unique_in_every_write(spark, db):
    users = db.collection("users")
    users.create_index(["name"], unique=True)
    for change in (lambda: users.update_many({}, {"$set": {"name": "same"}}), lambda: users.update_one({"_id": 1}, {"$set": {"name": "Bob"}}), lambda: users.update_many({"_id": 1}, {"$set": {"name": "Cy"}})):
        with pytest.raises(updates.UpdateError):
            change()
    assert users.update_many({}, {"$set": {"age": 1}}) == 3 and users.update_many({"_id": 1}, {"$unset": {"name": 1}}) == 1
    new = lambda k, n: spark.createDataFrame([(k, n, 1)], "_id long, name string, age long")
    errors = users.bulk_write([{"insert": new(7, "Bob")}, {"update": {"$set": {"name": "Cy"}}, "filter": {"_id": 2}}, {"insert": new(8, "Di")}], ordered=False)
    assert errors == ["duplicate key in name_1"] * 2 and sorted(r._id for r in users.df().collect()) == [1, 2, 3, 8]
    assert users.bulk_write([{"insert": new(9, None)}, {"nothing": 1}]) == ["unsupported operation: ['nothing']"]
    partial = users.create_index(["age"], unique=True, filter={"age": {"$gt": 5}})
    users.insert(new(10, "Ed"))  # outside the partial index: ages of 1 may repeat
    with pytest.raises(updates.UpdateError):
        users.update_many({}, {"$set": {"age": 6}})
    assert users.view(partial).count() == 0


def test_catalog_is_whole(spark, db, tmp_path):
    """History beside the collections, one commit for an index, locks that end, old tables that go."""
    users = db.get_or_create("users")
    assert users.count() == 3 and db.get_or_create("fresh", "_id long").count() == 0 and db.collections() == ["fresh", "users"]
    assert db.migrate([("one", lambda d: d.drop("fresh"), lambda d: d.get_or_create("fresh"))]) == ["one"]
    assert db.collections() == ["users"] and db.migrations() == ["one"]
    before = db.version()
    users.create_index(["age"])
    assert db.version() == before + 1 and users.indexes() == ["_id_", "age_1"]
    db.backup(f"file://{tmp_path}/copy")
    copy = Database(spark, f"file://{tmp_path}/copy")
    assert copy.migrations() == ["one"] and copy.collection("users").indexes() == ["_id_", "age_1"]
    out = users.aggregate([{"$lookup": {"from": "users", "localField": "_id", "foreignField": "_id", "as": "same"}}])
    assert out.count() == 3
    lock = tmp_path / "db" / "manifest" / f"{db.version() + 1:09d}.json.lock"
    lock.touch()
    with pytest.raises(Conflict):
        users.update_many({}, {"$inc": {"age": 1}})
    import os

    os.utime(lock, (1, 1))  # whoever made it is long gone
    assert users.update_many({}, {"$inc": {"age": 1}}) == 3
    tables = len(list((tmp_path / "db" / "data").iterdir()))
    assert db.vacuum(grace_seconds=10**6) == 0 and db.vacuum(grace_seconds=0) > 0
    assert len(list((tmp_path / "db" / "data").iterdir())) == 1 < tables and users.count() == 3


def test_text_index(spark, db, tmp_path):
    docs = [(1, "Go databases", "running fast"), (2, "Cooking", "the run of pasta"), (3, None, None), (4, "the of and", "a"), (5, "Größe İstanbul", "x y database"), (6, "run run", "İSTANBUL run")]
    df = spark.createDataFrame(docs, "_id long, title string, body string")
    notes = db.create("notes", df)
    with pytest.raises(CatalogError):
        notes.text_search("run")
    for stemmed in (True, False):
        name = notes.create_text_index(["title", "body"], stemmed=stemmed)
        for query in ("run", "databases run run", "the of", "nothing", "İstanbul größe"):
            want = text.text_search(notes.df(), query, ["title", "body"], stemmed=stemmed).collect()
            got = notes.text_search(query).collect()
            assert [(r._id, pytest.approx(r._textScore)) for r in want] == [(r._id, r._textScore) for r in got]
            assert notes.text_search(query, skip=1, limit=1, projection={"body": True}).collect() == [r for r in got[1:2]] or got
        assert {r._id for r in notes.text_search("İstanbul").collect()} == {5, 6}
        db.backup(f"file://{tmp_path}/notes{stemmed}")
        assert len(Database(spark, f"file://{tmp_path}/notes{stemmed}").collection("notes").text_search("run").collect()) == len(notes.text_search("run").collect())
        notes.update_many({"_id": 2}, {"$set": {"body": "new words"}})  # the index follows the rows
        assert [r._id for r in notes.text_search("pasta").collect()] == [] and [r._id for r in notes.text_search("words").collect()] == [2]
        notes.update_many({"_id": 2}, {"$set": {"body": "the run of pasta"}})
        notes.drop_index(name)
    hits = {r.id: r.score for r in text.bm25(df, "İstanbul", ["title", "body"], stemmed=False).collect()}
    assert set(hits) == {5, 6}
    n, lengths = 5, {1: 4, 2: 3, 4: 0, 5: 3, 6: 4}
    idf = math.log((n - 2 + 0.5) / 2.5 + 1)
    for k in (5, 6):
        assert hits[k] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * lengths[k] / (sum(lengths.values()) / n))))


def test_geo_index(spark, db):
    points = [(k, float((k * 37) % 360 - 180), float((k * 53) % 180 - 90)) for k in range(400)] + [(900, None, 1.0)]
    df = spark.createDataFrame(points, "_id long, lon double, lat double")
    places, p = db.create("places", df), ("lon", "lat")
    with pytest.raises(CatalogError):
        places.near(p, (0, 0), 10)
    places.create_geo_index(p)
    places.create_geo_index(p, spherical=False)
    assert places.indexes() == ["_id_", "lon_2dsphere_lat_2dsphere", "lon_2d_lat_2d"]
    got = lambda d: [tuple(r) for r in d.collect()]
    for spherical, reach in ((True, 2e6), (False, 30.0)):
        assert got(places.near(p, (20, 10), reach, spherical=spherical).select("_id", "_distance")) == got(geo_search.near(df, p, (20, 10), reach, spherical=spherical).select("_id", "_distance"))
        assert [r._id for r in places.near(p, (20, 10), reach, spherical=spherical, limit=3).collect()] == [r._id for r in geo_search.near(df, p, (20, 10), reach, spherical=spherical, limit=3).collect()]
    square = [[(-50, -40), (60, -40), (60, 50), (-50, 50)]]
    assert sorted(got(places.geo_within(p, square))) == sorted(got(geo_search.within(df, p, square)))
    assert sorted(got(places.geo_intersects(p, (0, 0), (30, 30)))) == sorted(got(geo_search.intersects(df, p, (0, 0), (30, 30))))
    assert [r._id for r in places.geo_within(p, square, skip=2, limit=2).collect()] == sorted(r._id for r in geo_search.within(df, p, square).collect())[2:4]
    scan = places.db.load(places._index(["2d"], p)["data"])
    assert any("GreaterThanOrEqual(x" in x for x in explain(geo_search.near(scan, ("x", "y"), (0, 0), 5, spherical=False, id_field="id"))["pushed"])


def test_logs_and_cache(spark, tmp_path, monkeypatch):
    from fernbank.sources import store

    db = Database(spark, f"file://{tmp_path}/audited", audit=True)
    users = db.create("users", spark.createDataFrame([(1, 2), (2, 3)], "_id long, n long"))
    users.update_many({}, {"$inc": {"n": 1}})
    with pytest.raises(updates.UpdateError):
        users.insert(spark.createDataFrame([(1, 2)], "_id long, n long"))
    assert sorted((r.operation, r.ok) for r in db.log("audit").collect()) == [("insert", False), ("update", True)]
    with db.timed("find", "users"):
        users.find({"n": 3}).count()
    assert stats.slow_queries(db.log("profile"), operation="operation", collection="collection", duration="duration_ms", at="at")["overall"].first().n == 1
    assert users.explain({"n": {"$gt": 1}})["pushed"] and {r.field: (r.entries, r.min, r.max) for r in users.analyze().collect()} == {"_id": (2, 1, 2), "n": (2, 3, 4)}
    first = users.find({"n": 3})
    assert users.find({"n": 3}) is first
    monkeypatch.setattr(store, "CACHE_SECONDS", -1)
    assert users.find({"n": 3}) is not first
    monkeypatch.setattr(store, "CACHE_SECONDS", 300)
    monkeypatch.setattr(store, "CACHED", 2)
    a, b = users.find({"n": 1}), users.find({"n": 2})
    assert users.find({"n": 1}) is a
    users.find({"n": 9})  # the least recently used goes
    assert users.find({"n": 1}) is a and users.find({"n": 2}) is not b


def test_values_of_other_kinds(spark):
    """Fields that get documents, lists or values of another class; sums of small types."""
    df = spark.createDataFrame([(1, 5, "a", [1]), (2, 6, "b", [2])], "_id long, n int, s string, a array<int>")
    one = lambda update: updates.apply_update(df, {"_id": 1}, update)
    out = {r._id: r for r in one({"$set": {"d": {"x": 1, "y": {"z": "t"}}}}).collect()}
    assert out[1].d.y.z == "t" and out[2].d is None
    mixed = one({"$set": {"n": "text", "s": 7, "a": {"x": 1}}})
    assert {f.name: f.dataType.simpleString() for f in mixed.schema.fields} == {"_id": "bigint", "n": "variant", "s": "variant", "a": "variant"}
    assert {r._id: (r.n.toPython(), r.s.toPython(), r.a.toPython()) for r in mixed.collect()} == {1: ("text", 7, {"x": 1}), 2: (6, "b", [2])}
    assert {r._id: [v.toPython() for v in r.l] for r in one({"$set": {"l": [1, "x", {"k": 2}]}}).where("_id = 1").collect()} == {1: [1, "x", {"k": 2}]}
    assert {r._id: r.n for r in one({"$inc": {"n": 2**31}}).collect()} == {1: 5 + 2**31, 2: 6}
    assert {r._id: r.n for r in one({"$mul": {"n": 2**31}}).collect()} == {1: 5 * 2**31, 2: 6}
    assert {r._id: r.n for r in one({"$set": {"n": 2.5}}).collect()} == {1: 2.5, 2: 6}
    assert {r._id: r.a for r in one({"$set": {"a": [7, 8]}}).collect()} == {1: [7, 8], 2: [2]}


def test_statistics_of_any_type(spark):
    df = spark.createDataFrame([(2**53, "b", datetime(2024, 1, 1), 1.5), (2**53 + 1, "a", datetime(2024, 1, 2), None), (None, "a", None, 1.5)], "n long, s string, t timestamp, x double")
    got = {r.field: tuple(r)[1:] for r in stats.analyze(df, ["n", "s", "t", "x"]).collect()}
    assert got == {"n": (2, 2, str(2**53), str(2**53 + 1)), "s": (3, 2, "a", "b"), "t": (2, 2, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), "x": (2, 1, "1.5", "1.5")}
    assert stats.analyze(df, ["n"]).first().max == 2**53 + 1 and stats.analyze(df.limit(0), ["s"]).first().entries == 0
    import random

    rng = random.Random(2)
    rows_ = [(rng.choice(["a", "b", None]), rng.choice([float(rng.randrange(30)), rng.random(), 5.0, 5.0, None])) for _ in range(5000)] + [("c", 1.0)]
    got = {r.g: tuple(r)[1:] for r in stats.percentiles(spark.createDataFrame(rows_, "g string, v double"), "v", (0, 1, 50, 95, 99, 100), by="g").collect()}
    for g in ("a", "b", "c", None):
        values = sorted(v for k, v in rows_ if k == g and v is not None)
        assert got[g] == tuple(values[min(len(values) * p // 100, len(values) - 1)] for p in (0, 1, 50, 95, 99, 100))
    assert stats.percentiles(spark.createDataFrame([], "v double"), "v").count() == 0


def test_nested_types_of_imports(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"a": {"n": 1.0, "t": "2024-01-02T03:04:05Z", "l": [{"k": 2.0}, {"k": 3.5}]}, "m": [1.0, 2.0]}, {"a": None, "m": None}, {"a": {"n": 4.0, "t": None, "l": []}, "m": []}]))
    back = impex.read(spark, f"{tmp_path}/in.json", "json", lines=False)
    assert back.schema["a"].dataType.simpleString() == "struct<l:array<struct<k:double>>,n:bigint,t:timestamp>" and dict(back.dtypes)["m"] == "array<bigint>"
    assert [r.a.n if r.a else None for r in back.collect()] == [1, None, 4]
    (tmp_path / "times.csv").write_text("a,b\n2024-01-02T03:04:05Z,x\n3,2024-13-99T00:00:00Z\n")
    strict = impex.read(spark, f"{tmp_path}/times.csv", "csv", strict=True)
    assert [(r.a, r.b) for r in strict.select(F.schema_of_variant("a").alias("a"), F.schema_of_variant("b").alias("b")).collect()] == [("TIMESTAMP", "STRING"), ("BIGINT", "STRING")]
    impex.write(back.select("m"), f"{tmp_path}/pretty.json", "json", pretty=True)
    assert json.loads((tmp_path / "pretty.json").read_text())[0] == {"m": [1, 2]}
