"""Discovery, scans and tools, end to end on a small tree."""

import io
import json

import pytest
from pyspark.sql import functions as F

from weft import cli
from weft.operators import scan
from weft.service import Service, answer
from weft.sources import config, discover
from weft.sources.warehouse import Warehouse
from weft.streaming import rescan

TREE = {
    "src/com/acme/OrderController.java": '@RestController @RequestMapping("/orders") class OrderController { private OrderService service; @Autowired OrderController(OrderService service){ this.service = service; } @GetMapping("/{id}") OrderDto getOrder(){ return this.service.load(); } }',
    "src/com/acme/OrderService.java": "class OrderService { @Autowired private OrderMapper mapper; Order load(){ return mapper.find(); } } class OrderDto { private String customerName; }",
    "src/com/acme/Order.java": '@TableName("t_order") class Order extends BaseEntity { @TableField("customer_name") private String customerName; } abstract class BaseEntity {}',
    "src/com/acme/OrderMapper.java": "interface OrderMapper extends BaseMapper<Order> { Order find(); }",
    "src/com/acme/OrderServiceTest.java": "class OrderServiceTest { @Test void works(){} }",
    "res/OrderMapper.xml": '<mapper namespace="com.acme.OrderMapper"><select id="find">SELECT customer_name AS customerName FROM t_order</select></mapper>',
    "web/OrderPage.vue": '{{ order.customerName }} axios.get("/api/orders/1")',
    "web/package.json": '{"name":"web","dependencies":{"vue":"3"}}',
    "web/app.min.js": "a.b",
    "node_modules/x/index.js": "a.bad",
    "build/generated/sources/G.java": "class Gen {}",
    "build/classes/H.java": "class Hidden {}",
    "skip/S.java": "class Skipped {}",
    ".gitignore": "skip/\n*.tmp.js\n",
    "a.tmp.js": "q.w",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in TREE.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path / "tree"


def test_discover(spark, tree):
    (tree / "bad.java").write_bytes(b"\xff\xfe class X {}")
    (tree / "big.java").write_text("x" * 1000)
    found = discover.discover(spark, str(tree), config.parse('max_file_bytes = 900\nexcluded_patterns = ["*Test.java"]'))
    assert {r.path for r in found.collect()} == {k for k in TREE if k.split("/")[0] in ("src", "res", "web")} - {"web/app.min.js", "src/com/acme/OrderServiceTest.java"} | {"build/generated/sources/G.java"}


def test_config():
    assert config.parse('schedulers = ["X"]\nextra_excluded_dirs = ["gen"]').excluded_dirs[-1] == "gen"
    assert config.parse("").max_file_bytes == 2 * 1024 * 1024
    for bad in ("x = 1", "schedulers = 3", "= ", 'max_file_bytes = "a"'):
        with pytest.raises(ValueError):
            config.parse(bad)


def names(w):
    e = {r.id: f"{r.kind}:{r.name}" for r in w.entities().collect()}
    return {f"{e.get(r.source)} {r.kind} {e.get(r.target)}": round(r.confidence, 2) for r in w.edges().collect()}


def test_scan_is_incremental_and_tools_answer(spark, tree, tmp_path):
    w = Warehouse(spark, str(tmp_path / "db/default"))
    first = scan.scan(spark, str(tree), w)
    assert (first.added, first.files_extracted, first.failed) == (9, 9, 0) and first.entities > 20
    edges = names(w)
    assert edges["http_client_call:GET /api/orders/{} matches_endpoint http_endpoint:GET /orders/{}"] == 0.6
    assert edges["method:getOrder calls method:load"] == 0.7 and edges["method:load calls method:find"] == 0.7
    assert edges["method:find binds_to_statement xml_statement:find"] == 0.9 and edges["class:BaseEntity superclass_of class:Order"] == 1.0
    assert edges["mapper:OrderMapper depends_on table:t_order"] == 0.9 and edges["class:OrderServiceTest tests class:OrderService"] == 0.7
    assert edges["frontend_field:customerName mapped_from field:customerName"] == 0.9

    again = scan.scan(spark, str(tree), w)
    assert (again.unchanged, again.files_extracted) == (9, 0) and again.entities == first.entities and names(w) == edges
    (tree / "res/OrderMapper.xml").unlink()
    (tree / "src/com/acme/Order.java").write_text("class Order {}")
    third = scan.scan(spark, str(tree), w)
    assert (third.changed, third.deleted, third.unchanged) == (1, 1, 7)
    assert not any("xml_statement" in k or "table:t_order" in k for k in names(w))

    s = Service(spark, str(tmp_path / "db"))
    assert [x["kind"] for x in s.search_entities("customerName")["items"]]
    assert s.find_endpoint("orders")["items"][0]["kind"] == "http_endpoint"
    assert {x["name"] for x in s.trace_callees("getOrder", depth=3)["items"]} >= {"load", "find"}
    assert {x["name"] for x in s.trace_callers("find", depth=3)["items"]} >= {"load", "getOrder"}
    found = s.analyze_change("customerName", "rename")
    assert found["total"] >= 2 and all(f["path"] and f["severity"] == "review_required" for f in found["findings"])
    assert s.semantic_search("order service", limit=3)["items"][0]["score"] > 0.3
    assert s.verify_edge("getOrder", "service")["match_count"] == 1
    doc = s.build_relay_doc("OrderService")
    assert doc["inbound"] or doc["outbound"]
    assert doc["target"]["anchor"]["file"].endswith("OrderService.java") and doc["target"]["business"] == "custom:needs-review" and not doc["inbound_has_more"]
    assert all(x["anchor"]["file"] and not x["needs_review"] for x in doc["inbound"] + doc["outbound"])
    whole = s.build_relay_doc("OrderService", verbose=True)
    assert all(x["evidence"] for x in whole["inbound"] + whole["outbound"])
    first = s.build_relay_doc("OrderService", limit=1)
    assert len(first["outbound"]) <= 1 and first["outbound_has_more"] == (len(doc["outbound"]) > 1)
    assert all(f["evidence"] and f["evidence"][0]["file"] for f in found["findings"]) and any("resolved across files" in x["reason"] for f in found["findings"] for x in f["evidence"])
    assert all({"tentative", "evidence_count"} <= x.keys() for x in s.trace_callees("getOrder", depth=3)["edges"])
    assert s.call("build_relay_doc", {"qn": "No"})["status"] == "error" and s.call("nothing", {})["status"] == "error"
    assert s.list_repositories()["repositories"][0]["repository"] == "default"
    assert len(json.dumps(s.show_system_view("api"))) < 2000

    out = io.StringIO()
    assert cli.main(["--database", str(tmp_path / "db"), "status"], spark, out) == 0 and json.loads(out.getvalue())["data"]["entity_count"] > 0
    assert cli.main(["--database", str(tmp_path / "db"), "--format", "text", "search", "order"], spark, io.StringIO()) == 0


def test_protocol(spark, tmp_path):
    s = Service(spark, str(tmp_path))
    assert answer(s, "{")["error"]["code"] == -32700 and answer(s, '{"method":"x"}') is None
    assert answer(s, '{"id":1,"method":"x"}')["error"]["code"] == -32601 and answer(s, '{"id":1,"method":"ping"}')["result"] == {}
    assert len(answer(s, '{"id":1,"method":"tools/list"}')["result"]["tools"]) == 15
    assert answer(s, '{"id":1,"method":"tools/call","params":{"name":"no"}}')["result"]["isError"]
    tools = {t["name"]: t for t in answer(s, '{"id":1,"method":"tools/list"}')["result"]["tools"]}
    for name in ("trace_callers", "trace_callees"):
        inputs = tools[name]["inputSchema"]
        assert inputs["properties"]["name"]["type"] == "string" and inputs["properties"]["depth"]["default"] == 2 and inputs["required"] == ["name"]
        assert inputs["properties"]["edge_kinds"]["default"] == ["calls", "injects", "declares", "superclass_of"]
    assert "target_kind" in tools["analyze_change"]["inputSchema"]["properties"] and "query" in tools["find_endpoint"]["inputSchema"]["required"]
    assert all(t["outputSchema"]["properties"]["data"]["properties"] for t in tools.values())


def test_stream(spark, tree, tmp_path):
    w = Warehouse(spark, str(tmp_path / "db"))
    for _ in range(2):
        rescan.start(spark, str(tree), w, str(tmp_path / "cp"), once=True).awaitTermination()
    assert w.entities().where("kind = 'class'").count() >= 5
    assert w.table("file").select("path").distinct().count() == w.table("file").count()


def test_failed_file_is_tried_again(spark, tmp_path):
    from weft.operators import files

    def bad(path, text, file_hash, config):
        raise RuntimeError("no")

    before = files.EXTRACTORS["toml"]
    w = Warehouse(spark, str(tmp_path / "db"))
    rows = spark.createDataFrame([("a.toml", "toml", "h", "x"), ("A.java", "java", "h", "class A {}")], "path string, kind string, hash string, content string")
    try:
        files.register("toml", bad)
        assert scan.scan_files(spark, rows, w).failed == 1
    finally:
        files.register("toml", before)
    assert scan.scan_files(spark, rows, w).added == 1
    assert w.entities().where(F.col("kind") == "class").count() == 1


def test_unresolved_names_are_written_to_the_metadata(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "db"))
    java = lambda *texts: spark.createDataFrame([(f"{k}.java", "java", v, v) for k, v in texts], "path string, kind string, hash string, content string")
    two = (("a/Base", "class Base {}"), ("b/Base", "class Base {}"))
    said = lambda: {r.name: json.loads(r.metadata or "{}") for r in w.entities().where("kind = 'class'").collect()}
    scan.scan_files(spark, java(*two, ("c/Some", "class Some extends Base {}")), w)
    found = said()["Some"]
    assert [(x["name"], x["candidates"]) for x in found["ambiguous_resolution"]] == [("Base", ["a/Base.java", "b/Base.java"])] and found["superclass"] == "Base"
    scan.scan_files(spark, java(*two, ("c/Some", "class Some extends Base {}")), w)
    assert said()["Some"] == found
    before = w._pointer()["tables"]
    scan.scan_files(spark, java(two[0], ("c/Some", "class Some extends Base {}")), w)
    assert "ambiguous_resolution" not in said()["Some"] and said()["Some"]["superclass"] == "Base"
    assert w.table("resolved").where("kind = 'superclass_of'").count() == 1 and w.table("resolved").first().evidence[0].file
    w.replace(note=w.table("note"))
    assert w._pointer()["tables"]["entity"] == w._pointer()["before"]["entity"] != before["entity"]
