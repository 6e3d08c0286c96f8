"""Graph operators against plain Python, and every catalogue query against its SQL."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from weft import schema
from weft.functions import exprs
from weft.operators import impact, resolve, search, store, traverse
from weft.plans import catalogue

DATA = "/root/testdata/sf0.001"


def walk(edges, start, depth, outbound, kinds):
    reached, frontier = {start: 0}, {start}
    for d in range(depth):
        frontier = {(t if outbound else s) for s, t, k in edges if (s if outbound else t) in frontier and (not kinds or k in kinds)} - set(reached)
        reached |= dict.fromkeys(frontier, d + 1)
    return reached


@pytest.mark.parametrize("seed", range(3))
def test_traversal_equals_plain_search(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}", r.choice(["calls", "contains", "injects"])) for _ in range(60)]
    df = spark.createDataFrame([(*e, 1.0) for e in edges], "source string, target string, kind string, confidence double")
    for depth, out, kinds in ((0, True, ()), (2, True, ()), (4, False, ("calls",)), (6, True, ("calls", "injects"))):
        found = traverse.distances(traverse.seeds_of(spark, ["n1", "n2"]), df, depth, out, kinds)
        got = {(x.seed, x.node): x.distance for x in found.collect()}
        assert got == {(s, n): d for s in ("n1", "n2") for n, d in walk(edges, s, depth, out, kinds).items()}
        passed = {tuple(x) for x in traverse.passed_edges(found, df, depth, out, kinds).select("source", "target", "kind").collect()}
        inner = {n for s in ("n1", "n2") for n, d in walk(edges, s, depth, out, kinds).items() if d < depth}
        assert passed == {e for e in edges if e[0 if out else 1] in inner and (not kinds or e[2] in kinds)}


def test_plan_of_traversal_has_no_cross_join(spark):
    df = spark.createDataFrame([("a", "b", "calls", 1.0)], "source string, target string, kind string, confidence double")
    plan = traverse.distances(traverse.seeds_of(spark, ["a"]), df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name,want", [("URLPath", "url_path"), ("customerName", "customer_name"), ("getHTTPCode", "get_http_code"), ("a1B", "a1b"), ("ID", "id"), ("", "")])
def test_camel_to_snake(spark, name, want):
    from weft.operators import java

    assert spark.range(1).select(exprs.camel_to_snake(F.lit(name)).alias("x")).first().x == want == java.snake(name)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    from weft.operators import java, rows

    for p in ("orders/{id}/12//x/", "/a/${b}/", "", "/v1/2"):
        assert one(exprs.normalize_path(F.lit(p))) == java.normalized(p)
    assert one(exprs.stable_id(*[F.lit(x) for x in ("workspace", "p", "class", "A", "")])) == rows.stable_id("p", "class", "A")
    assert [one(exprs.tentative(F.lit(c), F.lit(v))) for c, v in (("fact", 1.0), ("inferred", 0.9), ("resolved", 0.95), ("resolved", 0.6), (None, 1.0))] == [False, True, False, True, True]
    assert one(exprs.suffix_aligned(F.lit("/api/orders/{}"), F.lit("/orders/{}"))) and not one(exprs.suffix_aligned(F.lit("/foo"), F.lit("/a/b/foo")))
    assert not one(exprs.suffix_aligned(F.lit("/a/b/c/d/foo"), F.lit("/foo"))) and not one(exprs.suffix_aligned(F.lit("/a"), F.lit("/")))
    vec = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert [one(exprs.cosine(vec(1, 0), x)) for x in (vec(1, 0), vec(0, 0), vec(1), vec(float("nan"), 1))] == [1.0, 0.0, 0.0, 0.0]
    assert one(exprs.anchor(F.lit("f"), F.lit(1), F.lit(3))) == '{"file":"f","line":[1,3]}'
    assert schema.clamp_depth(99) == 10 and schema.clamp_limit(0) == 1 and impact.default_depth("rename") == 2
    with pytest.raises(ValueError):
        schema.check_kinds("nope")


def test_search_recall_and_order(spark):
    e = spark.createDataFrame([(str(i), "method", n, n) for i, n in enumerate(["getUserId", "UserServiceImpl", "eqUser", "user", "a_b", "axb"])], "id string, kind string, name string, qualified_name string")
    names = lambda df: [r.name for r in df.collect()]
    assert names(search.search(e, "user"))[0] == "user" and len(names(search.search(e, "user"))) == 4
    assert names(search.search(e, "eq")) == ["eqUser"] and names(search.search(e, "a_b")) == ["a_b"]
    assert set(names(search.search(e, "userid impl"))) == {"getUserId", "UserServiceImpl"}
    index = search.trigram_index(e)
    for w in ("userid", "ser", "eq"):
        assert set(names(search.search_by_index(e, index, w))) == set(names(search.search(e, w)))


def test_impact_bridge(spark):
    kinds = {"f": "frontend_field", "file": "file", "call": "http_client_call", "end": "http_endpoint"}
    e = spark.createDataFrame([(k, v, k, k) for k, v in kinds.items()], "id string, kind string, name string, qualified_name string")
    g = spark.createDataFrame([("file", "f", "contains", 1.0), ("file", "call", "contains", 1.0), ("call", "end", "matches_endpoint", 0.6)], "source string, target string, kind string, confidence double")
    found = impact.impact(e, g, "f", "remove").first()
    assert found.path == ["call", "end", "f", "file"] and found.confidence == 0.6 and found.plane == "frontend"


def test_http_confidences(spark):
    clients = spark.createDataFrame([("c1", "GET", "/api/orders/{}"), ("c2", "POST", "/foo"), ("c3", "GET", "/orders/{}")], "id string, method string, path string")
    ends = spark.createDataFrame([("e1", "GET", "/orders/{}"), ("e2", None, "/foo"), ("e3", "", "orders")], "id string, method string, path string")
    got = {(r.source, r.target): (round(r.confidence, 2), r.classification) for r in resolve.http_matches(clients, ends).collect()}
    assert got == {("c1", "e1"): (0.6, "inferred"), ("c3", "e1"): (0.95, "resolved"), ("c2", "e2"): (0.57, "inferred")}


def test_store(spark):
    t = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "id string, v int, seq int")
    batch = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("c", 7, 1)], "id string, v int, seq int")
    assert {(r.id, r.v) for r in store.upsert(t, batch, ["id"]).collect()} == {("a", 6), ("b", 2), ("c", 7)}


QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    rows = [tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)]
    return columns, sorted(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(catalogue.oracle_sql()[name]).df())
