"""Extractors on small sources."""

import pytest

from weft.operators import files, java


def view(rows):
    names = {e["id"]: f"{e['kind']}:{e['name']}" for e in rows.entities}
    edges = {f"{names.get(g['source'], '?')} {g['kind']} {names.get(g['target'], '?')}" for g in rows.edges if g["kind"] != "contains"}
    return set(names.values()), edges


def of(text, path="A.java"):
    return java.extract(path, text, "h")


def metas(rows, kind):
    return {e["name"]: e["meta"] for e in rows.entities if e["kind"] == kind}


def test_controller():
    names, edges = view(of('@RestController @RequestMapping("/orders") class C { @GetMapping("/{id}") Dto get(){ return s.get(); } } class Dto { private String customerName; }'))
    assert {"class:C", "class:Dto", "http_endpoint:GET /orders/{}", "field:customerName"} <= names
    assert "method:get exposes http_endpoint:GET /orders/{}" in edges


def test_mapping_without_verb_and_custom_endpoints():
    assert "http_endpoint:ANY /foo" in view(of('class C { @RequestMapping("/foo") String handle(){return null;} }'))[0]
    assert "http_endpoint:queryOrder" in view(of('@RmbMap("queryOrder") class S {}'))[0]
    names, edges = view(of("class S1 implements ApiHandler<Req,Object> { Object handle(Req r){return null;} }"))
    assert "http_endpoint:S1" in names and "method:handle exposes http_endpoint:S1" in edges


@pytest.mark.parametrize(
    "source,bean",
    [
        ("class S { @Autowired private A a; }", True), ("class S { private final A a; @Autowired S(A a, B b){this.a=a;} }", True), ("class S { S(A a){ } }", True),
        ("class S { S(A a){} S(){ } }", False), ("@RequiredArgsConstructor class S { private final A a; private B b; }", True), ("class S { private final A a; }", False),
    ],
)
def test_injection(source, bean):
    names, edges = view(of(source))
    assert ("spring_bean:A" in names) == bean == ("class:S injects spring_bean:A" in edges)
    assert "method:S" not in names


def test_signals_jobs_tests_annotations():
    rows = of('@Transactional class Foo { @Scheduled(cron="0 0 * * *") public void cleanup() {} @Test void bar(){} @Override public String toString(){return "";} }')
    names, edges = view(rows)
    assert metas(rows, "class")["Foo"] == {"transactional": True, "scheduled": True}
    assert {"job:cleanup", "test_case:bar", "annotation:Transactional"} <= names and "annotation:Override" not in names
    assert {"job:cleanup schedules method:cleanup", "class:Foo annotated annotation:Transactional"} <= edges


def test_mapped_class():
    names, edges = view(of('@TableName("t_order") public class Order { @TableId("id") private Long id; @TableField("customer_name") private String customerName; private Integer orderStatus; @TableField(exist = false) private String transientField; }\ninterface OrderMapper extends BaseMapper<Order> {}'))
    assert {"table:t_order", "column:customer_name", "column:order_status", "mapper:OrderMapper"} <= names and "column:transient_field" not in names
    assert {"class:Order depends_on table:t_order", "mapper:OrderMapper depends_on table:t_order", "field:customerName mapped_from column:customer_name"} <= edges


def test_methods_calls_and_overloads():
    rows = of("class Svc { void a(){b();} void b(){c();} void c(){} void d(int x){} void d(int x, int y){\n} }")
    assert {"method:a calls method:b", "method:b calls method:c"} <= view(rows)[1]
    assert sum(e["kind"] == "method" and e["name"] == "d" for e in rows.entities) == 2
    assert metas(rows, "method")["d"]["body_end_line"] == 2


def test_receivers():
    rows = of("class A { void x(){ JsonUtil.str(x); new B().build(); get().put(); this.service.one(); service.two(); a.b.c(); this.me(); super.up(); bare(); } }")
    found = {i["name"]: i["receiver_kind"] for i in metas(rows, "method")["x"]["invokes"]}
    assert found == {"str": "name", "build": "chain", "get": "bare", "put": "chain", "one": "field", "two": "name", "c": "qualified", "me": "this", "up": "super", "bare": "bare"}


def test_heritage_wrappers_advice_and_masks():
    rows = of('abstract class Base{} class D extends Base implements I<A, B, C>, J { void f(){ w.eq("col_a", 1).eq(Order::getCustomerName,"x"); } /* class No {} */ String s = "class Nope { @Test }"; @Around("execution(* com.acme.Svc.run(..))") Object adv(){ return null; } }')
    names, _ = view(rows)
    assert metas(rows, "class")["D"]["implements"] == ["I", "J"] and metas(rows, "class")["D"]["superclass"] == "Base" and metas(rows, "class")["Base"]["abstract"]
    assert {"column:col_a", "column:customer_name"} <= names and not {"class:No", "class:Nope"} & names
    assert metas(rows, "method")["adv"]["pointcut"] == "com.acme.Svc.run"


def test_masks_keep_offsets():
    text = 'a /* b\n */ "c // d" // e\n\'x\' """t\n"q" """ f'
    assert all(len(m) == len(text) and m.count("\n") == text.count("\n") for m in java.masks(text))


def test_broken_source_lowers_confidence():
    assert {e["evidence"]["confidence"] for e in of("class A { void x( { ").entities if e["kind"] == "class"} == {0.8}


def test_statements():
    rows = files.extract_xml("M.xml", """<mapper namespace="a.b.UserDao"><select id="get">SELECT n AS alias FROM orders o JOIN u ON o.id = u.oid WHERE o.k = #{k,jdbcType=VARCHAR} AND date(x) > 1 <if test="z != null"> AND zz = #{z}</if></select>
<update id="up">UPDATE orders SET n = 'x', b=#{b,jdbcType=INTEGER}
 WHERE id IN (SELECT uid FROM t2)</update><insert id="add">INSERT INTO t (col_a, `col_b`) VALUES (#{a})</insert></mapper>""", "h", {})
    names, edges = view(rows)
    assert {f"sql_field:{c}" for c in ("alias", "k", "x", "zz", "id", "oid", "uid")} == {n for n in names if n.startswith("sql_field")}
    assert {"xml_statement:up writes_table table:orders", "xml_statement:up reads_table table:t2", "xml_statement:up writes_column column:b", "xml_statement:add writes_column column:col_b"} <= edges
    assert metas(rows, "xml_statement")["get"]["namespace"] == "a.b.UserDao"


def test_frontend_and_build_files():
    names, _ = view(files.extract_frontend("P.vue", '{{ order.customerName }} x.MAX_A a.length\naxios.get("/orders/1"); const U="/api/x"; axios.post(U); const V="no"; axios.put(V)', "h", {}))
    assert {"vue_page:P", "frontend_field:customerName", "http_client_call:GET /orders/{}", "http_client_call:POST /api/x"} <= names
    assert not {"frontend_field:MAX_A", "frontend_field:length"} & names
    assert "package:app depends_on package:com.foo:ccl" in view(files.extract_gradle("app/build.gradle.kts", 'implementation("com.foo:ccl:1.0")\nimplementation(libs.baz)', "h", {}))[1]
    assert "package:mos depends_on package:vite" in view(files.extract_json("w/package.json", '{"name":"mos","devDependencies":{"vite":"3"}}', "h", {}))[1]
    assert len(view(files.extract_json("w/package.json", "{", "h", {}))[0]) == 1
    assert "package:libs.baz" in view(files.extract_toml("gradle/libs.versions.toml", '[libraries.baz]\nmodule = "g:a"\n', "h", {}))[0]
