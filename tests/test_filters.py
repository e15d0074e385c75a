"""The filter language: cases of each operator, and random filters against a plain interpreter."""

import random
import re
from datetime import datetime

import pytest

from fernbank.plans.explain import explain
from fernbank.plans.filters import FilterError, compile_filter, where

SCHEMA = "id long, n long, x double, s string, b boolean, t timestamp, a array<long>, o struct<k: long, s: string>"
ROWS = [
    (1, 5, 1.5, "alpha", True, datetime(2024, 1, 1), [1, 2, 3], (1, "a")),
    (2, None, None, None, None, None, None, None),
    (3, -7, 2.0, "Beta", False, datetime(2024, 6, 1), [], (None, "b")),
    (4, 5, 99.25, "", True, datetime(2023, 1, 1), [3, 3, None], (2, None)),
    (5, 0, -1.0, "alphabet", False, datetime(2024, 1, 1), [7], (1, "a")),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def ids(df, spec):
    return sorted(r.id for r in where(df, spec).collect())


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({}, [1, 2, 3, 4, 5]),
        ({"n": 5}, [1, 4]),
        ({"n": None}, []),
        ({"missing": 1}, []),
        ({"n": 5.0}, [1, 4]),
        ({"n": {"$ne": 5}}, [3, 5]),
        ({"s": {"$ne": 5}}, [1, 3, 4, 5]),
        ({"s": {"$gt": 5}}, []),
        ({"b": {"$gte": True}}, [1, 4]),
        ({"b": {"$gt": False}}, []),
        ({"t": {"$gt": datetime(2024, 1, 1)}}, [3]),
        ({"n": {"$in": [5, "x", None]}}, [1, 4]),
        ({"n": {"$in": 5}}, []),
        ({"n": {"$nin": [5, None]}}, [3, 5]),
        ({"n": {"$nin": 5}}, [1, 3, 4, 5]),
        ({"n": {"$exists": True}}, [1, 3, 4, 5]),
        ({"n": {"$exists": False}}, [2]),
        ({"missing": {"$exists": False}}, [1, 2, 3, 4, 5]),
        ({"s": {"$regex": "^alp"}}, [1, 5]),
        ({"s": {"$regex": "(?i)BETA"}}, [3]),
        ({"n": {"$regex": "5"}}, []),
        ({"a": {"$size": 3}}, [1, 4]),
        ({"a": {"$size": 0}}, [3]),
        ({"n": {"$size": 1}}, []),
        ({"a": {"$elemMatch": {"$gt": 2, "$lt": 5}}}, [1, 4]),
        ({"a": {"$all": [3]}}, [1, 4]),
        ({"a": [7]}, [5]),
        ({"a": {"$in": [[7], [1, 2, 3]]}}, [1, 5]),
        ({"o": {"$eq": {"k": 1, "s": "a"}}}, [1, 5]),
        ({"o.k": {"$gte": 1}}, [1, 4, 5]),
        ({"$and": []}, [1, 2, 3, 4, 5]),
        ({"$or": []}, []),
        ({"$or": [{"n": 0}, {"x": {"$gt": 50}}]}, [4, 5]),
        ({"n": {}}, [1, 2, 3, 4, 5]),
        ({"missing": {}}, [1, 2, 3, 4, 5]),
        ({"n": {"$not": {"$gt": 0}}}, [2, 3, 5]),
        ({"$nor": [{"n": 5}]}, [2, 3, 5]),
        ({"n": {"$mod": [5, 0]}}, [1, 4, 5]),
        ({"a": {"$type": "array"}}, [1, 3, 4, 5]),
    ],
)
def test_operators(df, spec, want):
    assert ids(df, spec) == want


@pytest.mark.parametrize(
    "spec",
    [{"n": {"$what": 1}}, {"$what": 1}, {"$or": {}}, {"$and": 1}, {"n": {"$exists": 1}}, {"s": {"$regex": "("}}, {"s": {"$regex": "a(?=b)"}}, {"s": {"$regex": r"(a)\1"}}, {"s": {"$regex": 5}}, {"a": {"$elemMatch": {"k": 1}}}, {"a": {"$size": "1"}}],
)
def test_errors_while_planning(df, spec):
    with pytest.raises(FilterError):
        compile_filter(df.schema, spec)


def interpret(row, spec):
    """A filter by hand, for the fields n, x and s."""
    kind = lambda v: "s" if isinstance(v, str) else "n"

    def one(v, op, w):
        if op == "$exists":
            return (v is not None) == w
        if v is None:
            return False
        same = kind(v) == kind(w) if not isinstance(w, list) else None
        return {
            "$eq": lambda: same and v == w, "$ne": lambda: not (same and v == w),
            "$gt": lambda: same and v > w, "$gte": lambda: same and v >= w, "$lt": lambda: same and v < w, "$lte": lambda: same and v <= w,
            "$in": lambda: any(kind(v) == kind(y) and v == y for y in w), "$nin": lambda: not any(kind(v) == kind(y) and v == y for y in w),
            "$regex": lambda: isinstance(v, str) and bool(re.search(w, v)),
        }[op]()

    for key, value in spec.items():
        if key in ("$and", "$or"):
            if not (all if key == "$and" else any)(interpret(row, s) for s in value):
                return False
        elif isinstance(value, dict):
            if not all(one(row[key], op, w) for op, w in value.items()):
                return False
        elif not one(row[key], "$eq", value):
            return False
    return True


def random_filter(rng, depth=0):
    value = lambda: rng.choice([0, 1, 2, 3.5, -1, "a", "ab", "", "b"])
    spec = {}
    for _ in range(rng.randint(1, 2)):
        if depth < 2 and rng.random() < 0.3:
            spec[rng.choice(["$and", "$or"])] = [random_filter(rng, depth + 1) for _ in range(rng.randrange(3))]
            continue
        field = rng.choice("nxs")
        op = rng.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$regex", None])
        if op is None:
            spec[field] = value()
        else:
            spec[field] = {op: [value() for _ in range(rng.randrange(4))] if op in ("$in", "$nin") else rng.random() < 0.5 if op == "$exists" else rng.choice(["a", "^b", "b$"]) if op == "$regex" else value()}
    return spec


def test_random_filters(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(k, rng.choice([None, 0, 1, 2, -1]), rng.choice([None, 0.0, 3.5, 1.0]), rng.choice([None, "", "a", "ab", "b", "ba"])) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, n long, x double, s string").cache()
    specs = [random_filter(rng) for _ in range(150)]
    flags = df.select("id", *[F.coalesce(c if (c := compile_filter(df.schema, s)) is not None else F.lit(True), F.lit(False)).alias(f"f{k}") for k, s in enumerate(specs)]).collect()
    by_id = {r.id: r for r in flags}
    for i, n, x, s in rows:
        for k, spec in enumerate(specs):
            assert by_id[i][f"f{k}"] == interpret({"n": n, "x": x, "s": s}, spec), (spec, n, x, s)


def test_variants(spark):
    from pyspark.sql import functions as F

    docs = ['{"a": 5, "s": "x"}', '{"a": "5"}', '{"a": null}', "{}", '{"a": [1, "2", 3]}', '{"a": 5.5, "o": {"k": true}}']
    df = spark.createDataFrame(list(enumerate(docs)), "id long, j string").select("id", F.parse_json("j").alias("v"))
    for spec, want in [
        ({"v.a": 5}, [0]), ({"v.a": "5"}, [1]), ({"v.a": {"$gt": 1}}, [0, 5]), ({"v.a": {"$exists": True}}, [0, 1, 4, 5]), ({"v.a": {"$ne": 5}}, [1, 2, 4, 5]),
        ({"v.a": {"$size": 3}}, [4]), ({"v.a": {"$elemMatch": {"$gte": 3}}}, [4]), ({"v.o.k": True}, [5]), ({"v.a": {"$in": [5, "5"]}}, [0, 1]), ({"v.a": {"$nin": [5]}}, [1, 2, 4, 5]), ({"v.a": {"$type": "string"}}, [1]),
    ]:
        assert ids(df, spec) == want, spec


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    found = explain(where(df, {"value": {"$gte": 100.0}, "event_type": {"$in": ["error", "view"]}}).select("event_id"))
    assert any("GreaterThanOrEqual(value,100.0)" in p and "In(event_type" in p for p in found["pushed"])
    assert found["exchanges"] == 0 and "props" not in found["read"][0]
