"""The registered queries, each with the SQL it is held against.

Test tables have no nulls, coordinates or arrays of strings of their own, so some
queries derive them from keys with the same arithmetic on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store_queries
from .operators import geo_search, routing, stats, text, ttl
from .operators.updates import apply_update, delete, insert
from .plans.find import find
from .plans.pipeline import aggregate
from .sources import tables
from .streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


_table = tables.table


def _add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = sql


def _find(name: str, table: str, filter: dict, columns: list[str], condition: str) -> None:
    projection = dict.fromkeys(columns, True)
    _add(name, lambda s, d: find(_table(s, d, table), filter, projection=projection), f"SELECT {', '.join(columns)} FROM {table} WHERE {condition}")


# ---- filters

_O = ["o_orderkey", "o_totalprice", "o_orderpriority"]
_L = ["l_orderkey", "l_linenumber", "l_quantity"]
_E = ["event_id", "event_type", "value"]
_find("filter_implicit_eq", "orders", {"o_orderpriority": "1-URGENT"}, _O, "o_orderpriority = '1-URGENT'")
_find("filter_eq", "orders", {"o_orderkey": {"$eq": 7}}, _O, "o_orderkey = 7")
_find("filter_ne", "orders", {"o_orderpriority": {"$ne": "1-URGENT"}}, _O, "o_orderpriority <> '1-URGENT'")
_find("filter_gt", "lineitem", {"l_quantity": {"$gt": 45}}, _L, "l_quantity > 45")
_find("filter_gte", "lineitem", {"l_quantity": {"$gte": 45}}, _L, "l_quantity >= 45")
_find("filter_lt", "lineitem", {"l_quantity": {"$lt": 5}}, _L, "l_quantity < 5")
_find("filter_lte", "lineitem", {"l_quantity": {"$lte": 5}}, _L, "l_quantity <= 5")
_find("filter_time_range", "orders", {"o_orderdate": {"$gte": datetime(1995, 1, 1), "$lt": datetime(1996, 1, 1)}}, _O, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_find("filter_in", "events", {"event_type": {"$in": ["click", "error", 5]}}, _E, "event_type IN ('click', 'error')")
_find("filter_nin", "events", {"event_type": {"$nin": ["click", None, 5]}}, _E, "event_type NOT IN ('click')")
_find("filter_type_mismatch", "events", {"event_type": {"$gt": 5}}, _E, "false")
_find("filter_ne_type_mismatch", "events", {"event_type": {"$ne": 5}}, _E, "event_type IS NOT NULL")
_find("filter_regex", "part", {"p_name": {"$regex": "(?i)^[a-m].*[0-9]$"}}, ["p_partkey", "p_name"], "regexp_matches(p_name, '(?i)^[a-m].*[0-9]$')")
_find("filter_size", "embeddings", {"embedding": {"$size": 64}}, ["vec_id", "label"], "len(embedding) = 64")
_find("filter_elem_match", "embeddings", {"embedding": {"$elemMatch": {"$gt": 0.25, "$lt": 0.3}}}, ["vec_id", "label"], "len(list_filter(embedding, lambda x: x > 0.25 AND x < 0.3)) > 0")
_find("filter_and", "lineitem", {"$and": [{"l_quantity": {"$gte": 30}}, {"l_discount": {"$lt": 0.03}}, {"l_returnflag": "R"}]}, _L, "l_quantity >= 30 AND l_discount < 0.03 AND l_returnflag = 'R'")
_find("filter_or", "lineitem", {"$or": [{"l_quantity": {"$gt": 49}}, {"l_discount": {"$lt": 0.005}}]}, _L, "l_quantity > 49 OR l_discount < 0.005")
_find("filter_empty_or", "lineitem", {"$or": []}, _L, "false")
_find("filter_empty", "region", {}, ["r_regionkey", "r_name"], "true")
_find("filter_empty_operators", "region", {"nothing": {}}, ["r_regionkey", "r_name"], "true")
_find("filter_not", "events", {"value": {"$not": {"$gte": 50}}}, _E, "NOT (value >= 50)")
_find("filter_nor", "events", {"$nor": [{"value": {"$gte": 50}}, {"event_type": "click"}]}, _E, "NOT (value >= 50 OR event_type = 'click')")
_find("filter_type", "events", {"value": {"$type": "double"}}, _E, "true")
_find("filter_mod", "events", {"event_id": {"$mod": [7, 3]}}, _E, "event_id % 7 = 3")


def _with_nulls(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "events").select("event_id", F.expr("nullif(event_type, 'click')").alias("event_type"))


_NULLS = "(SELECT event_id, nullif(event_type, 'click') AS event_type FROM events)"
_add("filter_exists", lambda s, d: find(_with_nulls(s, d), {"event_type": {"$exists": True}}), f"SELECT * FROM {_NULLS} WHERE event_type IS NOT NULL")
_add("filter_not_exists", lambda s, d: find(_with_nulls(s, d), {"event_type": {"$exists": False}}), f"SELECT * FROM {_NULLS} WHERE event_type IS NULL")
_add("filter_ne_missing", lambda s, d: find(_with_nulls(s, d), {"event_type": {"$ne": "view"}}), f"SELECT * FROM {_NULLS} WHERE event_type <> 'view'")
_add(
    "filter_all",
    lambda s, d: find(_table(s, d, "customer").select("c_custkey", F.expr("array(c_nationkey % 3, c_nationkey % 5)").alias("tags")), {"tags": {"$all": [1, 2]}}, projection={"c_custkey": True}),
    "SELECT c_custkey FROM customer WHERE (c_nationkey % 3 = 1 OR c_nationkey % 5 = 1) AND (c_nationkey % 3 = 2 OR c_nationkey % 5 = 2)",
)
_add(
    "filter_dot_path",
    lambda s, d: find(_table(s, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("segment")).alias("info")), {"info.key": {"$lt": 5}, "info.segment": "BUILDING"}, projection={"c_custkey": True}),
    "SELECT c_custkey FROM customer WHERE c_nationkey < 5 AND c_mktsegment = 'BUILDING'",
)


def _variant(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "events").select("event_id", F.parse_json("props").alias("props"))


_K = "json_extract(props, '$.k')"
_add("variant_filter", lambda s, d: find(_variant(s, d), {"props.k": {"$gte": 50}}, projection={"event_id": True}), f"SELECT event_id FROM events WHERE json_type({_K}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST({_K} AS DOUBLE) >= 50")
_add("variant_type_mismatch", lambda s, d: find(_variant(s, d), {"props.k": {"$eq": "50"}}, projection={"event_id": True}), f"SELECT event_id FROM events WHERE json_type({_K}) = 'VARCHAR' AND json_extract_string(props, '$.k') = '50'")
_add("variant_in", lambda s, d: find(_variant(s, d), {"props.k": {"$in": [1, 2, "3"]}}, projection={"event_id": True}), f"SELECT event_id FROM events WHERE json_type({_K}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST({_K} AS DOUBLE) IN (1, 2)")

# ---- projection, order, limits

_add("project_include", lambda s, d: find(_table(s, d, "customer"), projection={"c_name": True, "c_acctbal": True, "c_custkey": False}), "SELECT c_name, c_acctbal FROM customer")
_add("project_exclude", lambda s, d: find(_table(s, d, "customer"), projection={"c_name": False, "c_acctbal": False}), "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
_add(
    "sort_skip_limit",
    lambda s, d: find(_table(s, d, "orders"), {"o_totalprice": {"$gt": 1000}}, sort=[("o_totalprice", False), ("o_orderkey", True)], skip=20, limit=100, projection={"o_orderkey": True}),
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 20",
)
_add("sort_missing_last", lambda s, d: find(_with_nulls(s, d), sort=[("event_type", True), ("event_id", True)], skip=300), f"SELECT * FROM {_NULLS} ORDER BY event_type ASC NULLS LAST, event_id OFFSET 300")
_add("sort_missing_first", lambda s, d: find(_with_nulls(s, d), sort=[("event_type", False), ("event_id", True)], skip=300), f"SELECT * FROM {_NULLS} ORDER BY event_type DESC NULLS FIRST, event_id OFFSET 300")
_add("skip_beyond", lambda s, d: find(_table(s, d, "region"), sort=[("r_regionkey", True)], skip=100), "SELECT * FROM region WHERE false")
_add("count_filtered", lambda s, d: find(_table(s, d, "lineitem"), {"l_shipdate": {"$gte": datetime(1997, 1, 1)}}).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'")
_add("find_one", lambda s, d: find(_table(s, d, "orders"), {"o_orderpriority": "5-LOW"}, sort=[("o_orderkey", True)], limit=1), "SELECT * FROM orders WHERE o_orderpriority = '5-LOW' ORDER BY o_orderkey LIMIT 1")

# ---- pipelines


def _agg(name: str, table: str, stages: list, sql: str, round_: tuple[str, ...] = (), with_: tuple[str, ...] = ()) -> None:
    def build(s: SparkSession, d: str) -> DataFrame:
        out = aggregate(_table(s, d, table), stages, collections={n: _table(s, d, n) for n in with_})
        return out.withColumns({c: F.round(c, 4) for c in round_}) if round_ else out

    _add(name, build, sql)


FLAGSHIP = [
    {"$match": {"o_totalprice": {"$gte": 100000}}},
    {"$group": {"_id": "$o_orderpriority", "avgPrice": {"$avg": "$o_totalprice"}, "count": {"$count": {}}}},
    {"$sort": {"_id": 1}},
]
_agg("match_group_sort", "orders", FLAGSHIP, "SELECT o_orderpriority AS _id, round(sum(o_totalprice) / count(*), 4) AS \"avgPrice\", count(*) AS count FROM orders WHERE o_totalprice >= 100000 GROUP BY 1", ("avgPrice",))
_agg("group_sum", "lineitem", [{"$group": {"_id": "$l_returnflag", "total": {"$sum": "$l_quantity"}, "threes": {"$sum": 3}, "none": {"$sum": "$l_linestatus"}}}], "SELECT l_returnflag AS _id, round(sum(l_quantity), 4) AS total, 3.0::DOUBLE * count(*) AS threes, 0.0::DOUBLE AS none FROM lineitem GROUP BY 1", ("total",))
_agg("group_avg", "lineitem", [{"$group": {"_id": "$l_linestatus", "avg": {"$avg": "$l_extendedprice"}}}], "SELECT l_linestatus AS _id, round(sum(l_extendedprice) / count(*), 4) AS avg FROM lineitem GROUP BY 1", ("avg",))
_agg("group_min_max", "lineitem", [{"$group": {"_id": "$l_returnflag", "lo": {"$min": "$l_extendedprice"}, "hi": {"$max": "$l_linestatus"}}}], "SELECT l_returnflag AS _id, min(l_extendedprice) AS lo, max(l_linestatus) AS hi FROM lineitem GROUP BY 1")
_agg("group_count", "lineitem", [{"$group": {"_id": "$l_suppkey", "n": {"$count": {}}}}], "SELECT l_suppkey AS _id, count(*) AS n FROM lineitem GROUP BY 1")
_agg("group_const_key", "orders", [{"$group": {"_id": "all", "n": {"$count": {}}, "total": {"$sum": "$o_totalprice"}}}], "SELECT 'all' AS _id, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders", ("total",))
_agg("group_empty_input", "orders", [{"$match": {"o_orderkey": {"$lt": 0}}}, {"$group": {"_id": "all", "n": {"$count": {}}}}], "SELECT 'all' AS _id, 0::BIGINT AS n WHERE false")
_agg("group_having", "orders", [{"$group": {"_id": "$o_custkey", "n": {"$count": {}}}}, {"$match": {"n": {"$gte": 15}}}], "SELECT o_custkey AS _id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
_agg("group_compound_key", "lineitem", [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$count": {}}}}, {"$project": {"flag": "$_id.flag", "status": "$_id.status", "n": 1}}], "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
_agg("project_stage", "orders", [{"$project": {"o_orderkey": 1, "o_totalprice": True, "missing": 1}}], "SELECT o_orderkey, o_totalprice FROM orders")
_agg("sort_limit_stage", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 5}, {"$limit": 10}], "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_agg("limit_zero_stage", "orders", [{"$limit": 0}], "SELECT * FROM orders LIMIT 0")
_agg("group_push", "nation", [{"$group": {"_id": "$n_regionkey", "names": {"$push": "$n_name"}}}], "SELECT n_regionkey AS _id, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1")
_agg("group_add_to_set", "customer", [{"$group": {"_id": "$c_nationkey", "segments": {"$addToSet": "$c_mktsegment"}}}], "SELECT c_nationkey AS _id, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer GROUP BY 1")
_agg(
    "group_first_last", "orders", [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_totalprice"}, "last": {"$last": "$o_totalprice"}}}],
    "SELECT o_custkey AS _id, arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last FROM orders GROUP BY 1",
)
_agg("unwind", "embeddings", [{"$project": {"vec_id": 1, "embedding": 1}}, {"$unwind": "$embedding"}, {"$group": {"_id": "$vec_id", "n": {"$count": {}}, "hi": {"$max": "$embedding"}}}], "SELECT vec_id AS _id, count(*) AS n, max(e) AS hi FROM (SELECT vec_id, unnest(embedding) AS e FROM embeddings) GROUP BY 1")
_agg(
    "lookup", "region", [{"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "nations"}}, {"$unwind": {"path": "$nations", "preserveNullAndEmptyArrays": True}}, {"$project": {"r_name": 1, "n_name": "$nations.n_name"}}],
    "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey", with_=("nation",),
)
_agg(
    "expressions", "customer",
    [{"$project": {"c_custkey": 1, "label": {"$concat": [{"$toUpper": "$c_name"}, "/", {"$toLower": "$c_mktsegment"}]}, "part": {"$substr": ["$c_name", 2, 4]}, "rich": {"$cond": {"if": {"$gt": ["$c_acctbal", 5000]}, "then": "yes", "else": "no"}}}}],
    "SELECT c_custkey, upper(c_name) || '/' || lower(c_mktsegment) AS label, substr(c_name, 3, 4) AS part, CASE WHEN c_acctbal > 5000 THEN 'yes' ELSE 'no' END AS rich FROM customer",
)
_agg("add_fields", "nation", [{"$addFields": {"upper": {"$toUpper": "$n_name"}}}], "SELECT *, upper(n_name) AS upper FROM nation")
_agg("bucket", "customer", [{"$bucket": {"groupBy": "$c_acctbal", "boundaries": [-1000, 0, 5000], "default": 9999, "output": {"n": {"$count": {}}}}}], "SELECT CASE WHEN c_acctbal >= -1000 AND c_acctbal < 0 THEN -1000 WHEN c_acctbal >= 0 AND c_acctbal < 5000 THEN 0 ELSE 9999 END AS _id, count(*) AS n FROM customer GROUP BY 1")
_agg(
    "lookup_orders", "customer",
    [{"$match": {"c_acctbal": {"$gt": 9000}}}, {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}, {"$unwind": "$orders"}, {"$group": {"_id": "$c_custkey", "n": {"$count": {}}, "hi": {"$max": "$orders.o_totalprice"}}}],
    "SELECT c_custkey AS _id, count(*) AS n, max(o_totalprice) AS hi FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000 GROUP BY 1", with_=("orders",),
)

# ---- updates


def _update(name: str, source: Callable[[SparkSession, str], DataFrame], filter: dict, update: dict, sql: str) -> None:
    _add(name, lambda s, d: apply_update(source(s, d), filter, update), sql)


def _cust(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")


def _tags(s: SparkSession, d: str) -> DataFrame:
    tags = F.expr("if(c_nationkey = 0, null, array(c_nationkey % 3, c_nationkey % 2, c_nationkey % 3))").alias("tags")
    return _table(s, d, "customer").select("c_custkey", tags)


_M = {"c_custkey": {"$lte": 100}}
_T = "(SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN NULL ELSE [c_nationkey % 3, c_nationkey % 2, c_nationkey % 3] END AS tags FROM customer)"


def _cust_sql(field: str, value: str) -> str:
    cols = [f"CASE WHEN c_custkey <= 100 THEN {value} ELSE {c} END AS {c}" if c == field else c for c in ("c_custkey", "c_acctbal", "c_mktsegment")]
    return f"SELECT {', '.join(cols)} FROM customer"


def _tags_sql(value: str) -> str:
    return f"SELECT c_custkey, CASE WHEN c_custkey <= 100 THEN {value} ELSE tags END AS tags FROM {_T}"


_update("update_set", _cust, _M, {"$set": {"c_mktsegment": "NEW"}}, _cust_sql("c_mktsegment", "'NEW'"))
_update("update_direct", _cust, _M, {"c_mktsegment": "NEW"}, _cust_sql("c_mktsegment", "'NEW'"))
_update("update_unset", _cust, _M, {"$unset": {"c_mktsegment": ""}}, _cust_sql("c_mktsegment", "NULL"))
_update("update_inc", _cust, _M, {"$inc": {"c_acctbal": 100}}, _cust_sql("c_acctbal", "c_acctbal + 100"))
_update("update_mul", _cust, _M, {"$mul": {"c_acctbal": 2}}, _cust_sql("c_acctbal", "coalesce(c_acctbal * 2, 0)"))
_update("update_min", _cust, _M, {"$min": {"c_acctbal": 500}}, _cust_sql("c_acctbal", "least(c_acctbal, 500)"))
_update("update_max", _cust, _M, {"$max": {"c_acctbal": 500}}, _cust_sql("c_acctbal", "greatest(c_acctbal, 500)"))
_update("update_push", _tags, _M, {"$push": {"tags": {"$each": [7, 8]}}}, _tags_sql("list_concat(coalesce(tags, []), [7, 8])"))
_update("update_pull", _tags, _M, {"$pull": {"tags": 1}}, _tags_sql("list_filter(tags, lambda x: x <> 1)"))
_update("update_pull_all", _tags, _M, {"$pullAll": {"tags": [0, 2]}}, _tags_sql("list_filter(tags, lambda x: x NOT IN (0, 2))"))
_update("update_add_to_set", _tags, _M, {"$addToSet": {"tags": {"$each": [1, 9, 9]}}}, _tags_sql("list_concat(coalesce(tags, []), list_filter([1, 9], lambda x: NOT list_contains(coalesce(tags, []), x)))"))
_update("update_pop_last", _tags, _M, {"$pop": {"tags": 1}}, _tags_sql("tags[1:len(tags) - 1]"))
_update("update_pop_first", _tags, _M, {"$pop": {"tags": -1}}, _tags_sql("tags[2:len(tags)]"))
_update("update_rename", _cust, _M, {"$rename": {"c_mktsegment": "segment"}}, "SELECT c_custkey, c_acctbal, CASE WHEN c_custkey > 100 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey <= 100 THEN c_mktsegment END AS segment FROM customer")
_update("update_bit", lambda s, d: _table(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("flags")), _M, {"$bit": {"flags": {"and": 13, "or": 16, "xor": 3}}}, "SELECT c_custkey, CASE WHEN c_custkey <= 100 THEN xor((c_nationkey::BIGINT & 13) | 16, 3) ELSE c_nationkey::BIGINT END AS flags FROM customer")
_add("update_current_date", lambda s, d: apply_update(_cust(s, d), _M, {"$currentDate": {"seen": {"$type": "timestamp"}}}, now=datetime(2024, 1, 2)), "SELECT c_custkey, c_acctbal, c_mktsegment, CASE WHEN c_custkey <= 100 THEN 1704153600 END AS seen FROM customer")
_add("delete_many", lambda s, d: delete(_table(s, d, "orders"), {"o_totalprice": {"$lt": 200000}}), "SELECT * FROM orders WHERE NOT (o_totalprice < 200000)")
_add("insert_many", lambda s, d: insert(_table(s, d, "region"), _table(s, d, "nation").where("n_nationkey > 20").select((F.col("n_nationkey")).alias("r_regionkey"), F.col("n_regionkey").alias("extra")), "r_regionkey"), "SELECT r_regionkey, r_name, NULL::INT AS extra FROM region UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation WHERE n_nationkey > 20")

# ---- text

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_BM25_QUERY = "attion the anonin attion"
_add(
    "bm25_unstemmed",
    lambda s, d: text.bm25(_table(s, d, "documents"), _BM25_QUERY, ["text"], id_field="doc_id", stemmed=False).select("id", F.round("score", 6).alias("score")),
    f"""
WITH d AS (
  SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)), lambda w: strlen(w) >= 2 AND w NOT IN ({_STOP})) AS ts FROM documents
), n AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM d
), q(token, times) AS (VALUES ('attion', 2.0), ('anonin', 1.0)
), tf AS (SELECT id, len(ts) AS dl, q.token, times, len(list_filter(ts, lambda w: w = q.token))::DOUBLE AS tf FROM d, q
), df AS (SELECT token, count(*)::DOUBLE AS df FROM tf WHERE tf > 0 GROUP BY token)
SELECT id, round(sum(times * ln((n.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (token), n WHERE tf > 0 GROUP BY id
""",
)
_STEMMED_SQL = store_queries.bm25_sql(store_queries.STEMMED, True)
_add("bm25_stemmed", lambda s, d: text.bm25(_table(s, d, "documents"), store_queries.STEMMED, ["text"], id_field="doc_id").select("id", F.round("score", 6).alias("score")), f"SELECT id, round(score, 6) AS score FROM ({_STEMMED_SQL})")
_add(
    "text_search",
    lambda s, d: text.text_search(_table(s, d, "documents"), store_queries.STEMMED, ["text"], id_field="doc_id", projection={"doc_id": True, "_textScore": True}, limit=20).withColumn("_textScore", F.round("_textScore", 6)),
    f'SELECT id AS doc_id, round(score, 6) AS "_textScore" FROM ({_STEMMED_SQL}) ORDER BY round(score, 9) DESC, id LIMIT 20',
)
_add(
    "text_postings",
    lambda s, d: text.postings(_table(s, d, "documents"), ["text"], id_field="doc_id", stemmed=False).groupBy("token").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")),
    f"""
SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (
  SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda x: lower(x))) AS token FROM documents)
WHERE strlen(token) >= 2 AND token NOT IN ({_STOP}) GROUP BY token
""",
)

# ---- geo


def _places(s: SparkSession, d: str) -> DataFrame:
    lon, lat = F.expr("cast(c_custkey * 37 % 360 - 180 as double) + 0.25").alias("lon"), F.expr("cast(c_custkey * 53 % 180 - 90 as double) + 0.25").alias("lat")
    return _table(s, d, "customer").select("c_custkey", lon, lat)


_PLACES = "(SELECT c_custkey, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) + 0.25 AS lon, CAST(c_custkey * 53 % 180 - 90 AS DOUBLE) + 0.25 AS lat FROM customer)"
_HAV = "sin(radians(10 - lat) / 2) * sin(radians(10 - lat) / 2) + cos(radians(lat)) * cos(radians(10.0)) * sin(radians(20 - lon) / 2) * sin(radians(20 - lon) / 2)"
_add("geo_near_2d", lambda s, d: geo_search.near(_places(s, d), ("lon", "lat"), (10, 20), 40, spherical=False, id_field="c_custkey").withColumn("_distance", F.round("_distance", 6)), f"SELECT *, round(sqrt((lon - 10) * (lon - 10) + (lat - 20) * (lat - 20)), 6) AS _distance FROM {_PLACES} WHERE sqrt((lon - 10) * (lon - 10) + (lat - 20) * (lat - 20)) <= 40")
_add(
    "geo_near_sphere",
    lambda s, d: geo_search.near(_places(s, d), ("lon", "lat"), (20, 10), 3_000_000, limit=25, id_field="c_custkey").select("c_custkey", F.round("_distance", 2).alias("_distance")),
    f"SELECT c_custkey, round(dist, 2) AS _distance FROM (SELECT *, 2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)) AS dist FROM (SELECT *, {_HAV} AS a FROM {_PLACES})) WHERE dist <= 3000000 ORDER BY dist, c_custkey LIMIT 25",
)
_add("geo_within", lambda s, d: geo_search.within(_places(s, d), ("lon", "lat"), [[(-50, -40), (60, -40), (60, 50), (-50, 50)], [(0, 0), (20, 0), (20, 20), (0, 20)]]), f"SELECT * FROM {_PLACES} WHERE lon BETWEEN -50 AND 60 AND lat BETWEEN -40 AND 50 AND NOT (lon BETWEEN 0 AND 20 AND lat BETWEEN 0 AND 20)")
_add("geo_intersects", lambda s, d: geo_search.intersects(_places(s, d), ("lon", "lat"), (-20.75, -10), (30.25, 40.25)), f"SELECT * FROM {_PLACES} WHERE lon BETWEEN -20.75 AND 30.25 AND lat BETWEEN -10 AND 40.25")

# ---- time to live, changes, routing


def _now(s: SparkSession, d: str):
    return datetime(2024, 1, 15)


_AT = "TIMESTAMP '2024-01-15'"
_add("ttl_live", lambda s, d: ttl.live(_table(s, d, "events"), {"ts": 86400}, _now(s, d)).select("event_id"), f"SELECT event_id FROM events WHERE NOT (ts + INTERVAL 86400 SECOND < {_AT})")
_add("ttl_expired", lambda s, d: ttl.swept(_table(s, d, "events"), {"ts": 86400}, _now(s, d)).select("event_id"), f"SELECT event_id FROM events WHERE ts + INTERVAL 86400 SECOND < {_AT}")


def _log(s: SparkSession, d: str) -> DataFrame:
    doc = F.concat(F.lit('{"_id": "'), F.col("user_id").cast("string"), F.lit('", "value": 1}'))
    op = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 2).otherwise(7)
    change = F.lit('{"$set": {"a": 1}, "$inc": {"n": 2}, "$unset": {"z": ""}}')
    return _table(s, d, "events").select(
        F.col("event_id").alias("op_id"), F.col("ts").cast("timestamp").alias("ts"), op.cast("tinyint").alias("op"), F.lit("shop").alias("db"), F.lit("users").alias("coll"),
        F.col("user_id").cast("string").alias("doc_id"), F.when(op == 0, doc).alias("doc"), F.when(op == 1, change).alias("update"), F.lit(None).cast("string").alias("filter"), F.lit(None).cast("string").alias("index_def"),
    )


_add(
    "change_events",
    lambda s, d: changes.watch(changes.events(_log(s, d), resume_after=100), database="shop").select("token", "operationType", "documentKey", F.col("updatedFields")["n"].alias("n"), F.concat_ws(",", "removedFields").alias("removed")),
    """SELECT event_id AS token, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'update' ELSE 'delete' END AS "operationType", user_id::VARCHAR AS "documentKey",
       CASE WHEN event_type = 'purchase' THEN '2' END AS n, CASE WHEN event_type = 'purchase' THEN 'z' ELSE '' END AS removed FROM events WHERE event_type IN ('signup', 'purchase', 'error') AND event_id > 100""",
)
_add(
    "change_events_matched",
    lambda s, d: changes.watch(changes.events(_log(s, d)), filter={"operationType": "insert", "fullDocument._id": {"$in": ["7", "42", "55"]}}).select("token", "documentKey"),
    "SELECT event_id AS token, user_id::VARCHAR AS \"documentKey\" FROM events WHERE event_type = 'signup' AND user_id IN (7, 42, 55)",
)
_add("hash_shards", lambda s, d: routing.hash_shards(_table(s, d, "orders"), "o_custkey", 4).groupBy("shard").agg(F.count(F.lit(1)).alias("n")), f"SELECT shard, count(*) AS n FROM ({store_queries.hash_shards_sql('o_custkey', 'orders', 4)}) GROUP BY shard")
_add("range_shards", lambda s, d: routing.range_shards(_table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", [200, 800]), "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey >= 800 THEN 2 WHEN o_custkey >= 200 THEN 1 ELSE 0 END AS shard FROM orders")

# ---- statistics

_add("analyze_stats", lambda s, d: stats.analyze(_table(s, d, "lineitem"), ["l_quantity", "l_discount"]), " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS entries, count(DISTINCT {c}) AS unique_keys, min({c}) AS min, max({c}) AS max FROM lineitem" for c in ("l_quantity", "l_discount")))
_add(
    "histogram",
    lambda s, d: stats.histogram(_table(s, d, "orders"), "o_totalprice", 8).select("bucket", F.round("lower", 3).alias("lower"), "n", F.round("frequency", 6).alias("frequency")),
    "WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS t FROM orders) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 8)), 7)::BIGINT AS bucket, round(lo + bucket * ((hi - lo) / 8), 3) AS lower, count(*) AS n, round(count(*) / t::DOUBLE, 6) AS frequency FROM orders, b GROUP BY bucket, lo, hi, t",
)
_add("latency_buckets", lambda s, d: stats.latency_buckets(_table(s, d, "events"), "value"), "SELECT CASE WHEN value < 1 THEN '<1ms' WHEN value < 10 THEN '1-10ms' WHEN value < 100 THEN '10-100ms' WHEN value < 1000 THEN '100-1000ms' ELSE '>=1000ms' END AS bucket, count(*) AS n FROM events GROUP BY 1")
_add(
    "percentiles",
    lambda s, d: stats.percentiles(_table(s, d, "events"), "value", by="event_type"),
    "SELECT event_type, " + ", ".join(f"list_sort(list(value))[least(count(*) * {p} // 100, count(*) - 1) + 1] AS p{p}" for p in (50, 95, 99)) + " FROM events GROUP BY 1",
)
_add("slow_query_stats", lambda s, d: stats.slow_queries(_table(s, d, "events"), operation="event_type", collection="user_id", duration="value", at="ts")["by_operation"].withColumn("avg", F.round("avg", 6)), "SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
_add("slow_query_top", lambda s, d: stats.top_slow(_table(s, d, "events"), "value", 10, "event_id").select("event_id", "value"), "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
_add("validate_ids", lambda s, d: stats.validate(_table(s, d, "lineitem"), "l_orderkey"), "SELECT 'missing_id' AS issue, count(*) FILTER (l_orderkey IS NULL) AS n FROM lineitem UNION ALL SELECT 'duplicate_id', count(l_orderkey) - count(DISTINCT l_orderkey) FROM lineitem")

QUERIES |= store_queries.QUERIES
ORACLE_SQL |= store_queries.ORACLE_SQL
