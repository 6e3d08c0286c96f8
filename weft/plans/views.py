"""Graphs and sources projected from the parquet tables, in SQL that Spark and the checking engine both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

SQL = {
    "pg_entity": """
SELECT concat('r:', r_regionkey) AS id, 'package' AS kind, r_name AS name, r_name AS qualified_name, 'region' AS file, CAST(r_regionkey AS BIGINT) AS start_line FROM region
UNION ALL SELECT concat('n:', n_nationkey), 'class', n_name, concat(r_name, '.', n_name), 'nation', CAST(n_nationkey AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat('c:', c_custkey), 'method', c_name, concat(n_name, '#', c_name), 'customer', CAST(c_custkey AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('s:', s_suppkey), 'spring_bean', s_name, s_name, 'supplier', CAST(s_suppkey AS BIGINT) FROM supplier
UNION ALL SELECT concat('o:', o_orderkey), 'xml_statement', concat('order_', o_orderkey), concat('orders#order_', o_orderkey), 'orders', CAST(o_orderkey AS BIGINT) FROM orders
UNION ALL SELECT concat('p:', p_partkey), CASE WHEN p_size % 4 = 0 THEN 'table' WHEN p_size % 4 = 1 THEN 'column' WHEN p_size % 4 = 2 THEN 'field' ELSE 'frontend_field' END, p_name, concat(p_brand, '.', p_name, '#', p_partkey), 'part', CAST(p_partkey AS BIGINT) FROM part
UNION ALL SELECT DISTINCT concat('t:', p_type), 'http_endpoint', concat('GET /', lower(p_type)), concat('GET /', lower(p_type)), 'part', CAST(0 AS BIGINT) FROM part""",
    "pg_edge": """
SELECT concat('r:', n_regionkey) AS source, concat('n:', n_nationkey) AS target, 'contains' AS kind, 'fact' AS classification, CAST(1.0 AS DOUBLE) AS confidence, 0 AS resolved FROM nation
UNION ALL SELECT concat('n:', c_nationkey), concat('c:', c_custkey), 'declares', 'fact', CAST(1.0 AS DOUBLE), 0 FROM customer
UNION ALL SELECT concat('n:', s_nationkey), concat('s:', s_suppkey), 'injects', 'fact', CAST(1.0 AS DOUBLE), 0 FROM supplier
UNION ALL SELECT concat('c:', c_custkey), concat('c:', (c_custkey * 31 + 7) % (SELECT count(*) FROM customer)), 'calls', 'inferred', CAST(CASE WHEN c_custkey % 3 = 0 THEN 0.7 WHEN c_custkey % 3 = 1 THEN 0.5 ELSE 0.57 END AS DOUBLE), 1 FROM customer
UNION ALL SELECT concat('c:', o_custkey), concat('o:', o_orderkey), 'binds_to_statement', 'resolved', CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0.6 ELSE 0.9 END AS DOUBLE), 1 FROM orders
UNION ALL SELECT DISTINCT concat('o:', l_orderkey), concat('p:', l_partkey), CASE WHEN l_returnflag = 'R' THEN 'writes_table' ELSE 'reads_table' END, 'fact', CAST(1.0 AS DOUBLE), 0 FROM lineitem
UNION ALL SELECT concat('p:', p_partkey), concat('t:', p_type), 'matches_endpoint', CASE WHEN p_size % 2 = 0 THEN 'resolved' ELSE 'inferred' END, CAST(CASE WHEN p_size % 2 = 0 THEN 0.95 ELSE 0.6 END AS DOUBLE), 1 FROM part""",
    "syn_type": """
SELECT concat('ty:', c_custkey) AS id, CASE WHEN c_custkey % 5 = 0 THEN 'interface' ELSE 'class' END AS kind,
       concat('T', c_custkey % (SELECT CAST(floor(0.9 * count(*)) AS BIGINT) FROM customer), CASE WHEN c_custkey % 7 = 0 THEN 'Test' ELSE '' END) AS name,
       concat('src/com/acme/n', c_nationkey, '/T', c_custkey, '.java') AS file,
       CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 = 0 THEN concat('T', (c_custkey * 7 + 1) % (SELECT count(*) FROM customer)) END AS superclass,
       CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 = 1 THEN concat('T', (c_custkey * 5) % (SELECT count(*) FROM customer)) END AS implements_name
FROM customer""",
    "syn_method": "SELECT concat('me:', o_orderkey) AS id, concat('ty:', o_custkey) AS owner_id, concat('m', o_orderkey % 7) AS name, o_orderkey AS seq FROM orders",
    "syn_injected": """
SELECT DISTINCT concat('ty:', o_custkey) AS owner_id, concat('f', o_orderkey % 3) AS field_name,
       concat('T', (o_custkey * 11 + o_orderkey % 3) % (SELECT count(*) FROM customer)) AS type_name FROM orders""",
    "syn_invoke": """
SELECT DISTINCT concat('me:', l_orderkey) AS caller_id, l_linenumber AS pos, concat('m', l_partkey % 7) AS callee_name,
       CASE WHEN l_linenumber % 4 = 0 THEN 'bare' WHEN l_linenumber % 4 = 1 THEN 'field' ELSE 'name' END AS receiver_kind,
       CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN concat('f', l_suppkey % 3)
            WHEN l_linenumber % 4 = 2 THEN concat('f', l_partkey % 3) ELSE concat('T', l_partkey % (SELECT count(*) FROM customer)) END AS receiver
FROM lineitem""",
    "syn_call": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, concat('/api', regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)) AS raw_path FROM pages",
    "syn_endpoint": """
SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN 'GET' ELSE 'POST' END AS method,
       CASE WHEN page_id % 4 = 0 THEN concat('/api', regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)) ELSE regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) END AS raw_path
FROM pages WHERE page_id % 5 <> 0""",
    "syn_sql": """
SELECT concat('st', o_orderkey) AS statement_id,
       CASE WHEN o_orderkey % 4 = 0 THEN 'select' WHEN o_orderkey % 4 = 1 THEN 'insert' WHEN o_orderkey % 4 = 2 THEN 'update' ELSE 'delete' END AS operation,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('SELECT col_', o_custkey % 9, ' AS aliasOf', o_custkey % 9, ' FROM t', o_custkey % 13, ' a JOIN t', o_orderkey % 11, ' b ON a.id = b.ref_', o_custkey % 5, ' WHERE a.k', o_orderkey % 3, ' = #{k,jdbcType=VARCHAR}')
            WHEN o_orderkey % 4 = 1 THEN concat('INSERT INTO t', o_custkey % 13, ' (c', o_custkey % 5, ', d', o_orderkey % 7, ') VALUES (#{a}, #{b})')
            WHEN o_orderkey % 4 = 2 THEN concat('UPDATE t', o_custkey % 13, ' SET c', o_custkey % 5, ' = #{x,jdbcType=INTEGER}, d = 1 WHERE id', o_orderkey % 3, ' = #{id}')
            ELSE concat('DELETE FROM t', o_custkey % 13, ' WHERE flag', o_orderkey % 3, ' = 0 AND date(ts) > 1 OR id IN (SELECT uid FROM t2)') END AS sql_text
FROM orders""",
    "syn_file_old": "SELECT concat('doc/', doc_id, '.txt') AS path, concat('f2:', md5(text)) AS hash FROM documents WHERE doc_id % 10 <> 0",
    "syn_file_new": "SELECT concat('doc/', doc_id, '.txt') AS path, concat('f2:', md5(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END)) AS hash FROM documents WHERE doc_id % 11 <> 0",
    "syn_page_source": """
SELECT concat('page', p_partkey, '.vue') AS path,
       concat('{{ order.', p_name, ' }} list.length row.MAX_', p_size, chr(10), 'axios.get("/api/', p_partkey, '/x")', chr(10), 'const URL', p_size, ' = "/v', p_size % 5, '/{id}"', chr(10), 'this.$http.', CASE WHEN p_size % 2 = 0 THEN 'post' ELSE 'put' END, '(URL', p_size, ')') AS content
FROM part""",
    "syn_build_source": """
SELECT concat('mod', s_suppkey, '/build.gradle.kts') AS path, concat('dependencies {', chr(10), ' implementation("com.acme', s_nationkey, ':lib', s_suppkey, ':1.', s_suppkey % 9, '")', chr(10), ' api(libs.tool.n', s_nationkey, ')', chr(10), '}') AS content
FROM supplier""",
    "syn_package_source": """
SELECT concat('web', s_suppkey, '/package.json') AS path, concat('{"name":"web', s_suppkey, '","dependencies":{"vue":"^3","lib-', s_nationkey, '":"1"},"devDependencies":{"tool-', s_suppkey % 3, '":"2"}}') AS content
FROM supplier""",
    "syn_java_source": """
SELECT concat('src/C', s_suppkey, '.java') AS path, s_suppkey AS k, s_nationkey AS n, concat('@TableName("t_', s_suppkey, '") @Transactional class C', s_suppkey, ' extends B', s_nationkey, ' implements I', s_nationkey, '<X, Y> {', chr(10),
 ' @Autowired private S', s_suppkey, ' svc; // class Hidden {}', chr(10), ' @TableField("named_', s_suppkey, '") private Long fieldA;', chr(10), ' @GetMapping("/p/', s_suppkey, '/{id}") Object get', s_suppkey, '() { return svc.load(); }', chr(10),
 ' @Scheduled(cron="x") void job() { help(); }', chr(10), ' void help() {}', chr(10), ' @Test void checks(int a, int b) {}', chr(10), '}') AS content
FROM supplier""",
    "syn_page_entity": """
SELECT concat('ff:', p_partkey) AS id, 'frontend_field' AS kind, concat('name', p_partkey % 20) AS name, concat('q', p_partkey) AS qualified_name FROM part
UNION ALL SELECT DISTINCT concat('fi:', p_size), 'file', concat('f', p_size), concat('f', p_size) FROM part
UNION ALL SELECT DISTINCT concat('hc:', p_size), 'http_client_call', concat('GET /', p_size), concat('f', p_size, '#GET /', p_size) FROM part
UNION ALL SELECT DISTINCT concat('en:', p_size % 3), 'http_endpoint', concat('GET /', p_size % 3), concat('GET /', p_size % 3) FROM part""",
    "syn_page_edge": """
SELECT concat('fi:', p_size) AS source, concat('ff:', p_partkey) AS target, 'contains' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM part
UNION ALL SELECT DISTINCT concat('fi:', p_size), concat('hc:', p_size), 'contains', CAST(1.0 AS DOUBLE) FROM part
UNION ALL SELECT DISTINCT concat('hc:', p_size), concat('en:', p_size % 3), 'matches_endpoint', CAST(0.6 AS DOUBLE) FROM part""",
    "syn_xml_source": """
SELECT concat('res/M', statement_id, '.xml') AS path, statement_id, operation, sql_text, concat('<mapper namespace="com.acme.M', statement_id, '"><', operation, ' id="', statement_id, '">', sql_text, '</', operation, '></mapper>') AS content FROM syn_sql""",
}


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables and projections over one data folder."""
    names = (*(("syn_sql",) if "syn_xml_source" in names and "syn_sql" not in names else ()), *names)
    for t in TABLES:
        if any(t in SQL.get(n, n) for n in names):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    out = []
    for n in names:
        out.append(spark.sql(SQL[n]) if n in SQL else spark.table(n))
        if n == "syn_sql":
            out[-1].createOrReplaceTempView(n)
    return out


def with_views(names: tuple[str, ...], body: str, recursive: str = "") -> str:
    """The body after definitions of the projections it names."""
    parts = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in names if n in SQL] + ([recursive] if recursive else [])
    return ("WITH " + ("RECURSIVE " if recursive else "") + ", ".join(parts) + " " if parts else "") + body
