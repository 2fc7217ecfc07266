"""Registered queries: statements given to the read-only SQL tool.

The statement text is the same for both engines.  The tool's row limit is its feature, so each
statement either orders its result completely or returns less than the limit.
"""

from __future__ import annotations

from lectern.plans import readonly_sql
from lectern.plans.registered.registry import register, table

STATEMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "sql_filter_order": (("customer",), """
        SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 100 AND 5000
        ORDER BY c_acctbal DESC, c_custkey LIMIT 50"""),
    "sql_like": (("part",), "SELECT p_brand, count(*) AS n FROM part WHERE p_name ILIKE '%RING%' OR p_name ILIKE 'Blue%' GROUP BY p_brand"),
    "sql_inner_join": (("orders", "customer", "nation"), """
        SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""),
    "sql_left_join": (("nation", "supplier"), """
        SELECT n_name, count(s_suppkey) AS n_suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY n_name"""),
    "sql_full_join": (("customer", "supplier"), """
        SELECT coalesce(c.k, s.k) AS nation_key, coalesce(c.n, 0) AS n_customers, coalesce(s.n, 0) AS n_suppliers
        FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey) c
        FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 3000 GROUP BY s_nationkey) s ON c.k = s.k"""),
    "sql_using_natural": (("nation", "region"), """
        SELECT r_name, count(*) AS n FROM (SELECT n_name, n_regionkey AS k FROM nation) a
        JOIN (SELECT r_name, r_regionkey AS k FROM region) b USING (k) GROUP BY r_name"""),
    "sql_exists": (("customer", "orders"), """
        SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
        AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000) GROUP BY c_mktsegment"""),
    "sql_having": (("lineitem",), """
        SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600
        ORDER BY n DESC, l_suppkey LIMIT 50"""),
    "sql_aggregates": (("lineitem",), """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
               round(avg(l_discount), 6) AS discount, min(l_tax) AS low, max(l_tax) AS high, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""),
    "sql_case": (("orders",), """
        SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority IS NULL THEN 'none' ELSE 'low' END AS priority,
               count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_done FROM orders GROUP BY 1"""),
    "sql_window": (("supplier",), """
        SELECT s_nationkey, s_suppkey, rk FROM (SELECT s_nationkey, s_suppkey,
          row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rk FROM supplier) t WHERE rk <= 2
        ORDER BY s_nationkey, rk LIMIT 50"""),
    "sql_union": (("customer", "supplier"), """
        SELECT 'customer' AS kind, c_nationkey AS nation_key, count(*) AS n FROM customer WHERE c_nationkey < 12 GROUP BY c_nationkey
        UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier WHERE s_nationkey < 12 GROUP BY s_nationkey"""),
    "sql_set_operations": (("customer", "supplier"), """
        (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier)
        EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0"""),
    "sql_with": (("orders", "lineitem"), """
        WITH totals AS (SELECT l_orderkey, sum(l_extendedprice) AS t FROM lineitem GROUP BY l_orderkey),
             years AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)
        SELECT y, count(*) AS n, round(max(t), 2) AS largest FROM totals JOIN years ON l_orderkey = o_orderkey GROUP BY y"""),
    "sql_scalar_subquery": (("part",), """
        SELECT p_brand, count(*) AS n FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) GROUP BY p_brand"""),
    "sql_string_functions": (("customer",), """
        SELECT upper(substr(c_mktsegment, 1, 3)) || '-' || lower(trim(c_mktsegment)) AS label, max(length(c_name)) AS longest,
               count(nullif(c_mktsegment, 'BUILDING')) AS n_other, round(abs(min(c_acctbal)), 1) AS low FROM customer GROUP BY c_mktsegment"""),
    "sql_self_join": (("nation",), """
        SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
        ORDER BY one, two LIMIT 50"""),
    "sql_top_rows": (("lineitem",), """
        SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25"""),
}


def _register(name: str, tables: tuple[str, ...], statement: str) -> None:
    if name == "sql_set_operations":
        statement = "SELECT k FROM (" + statement + ") t"

    @register(name, statement)
    def run(spark, sf_dir):
        session = readonly_sql.reader_session(spark, {t: table(spark, sf_dir, t) for t in tables})
        # LIKE without case is what the tool offers; ILIKE is its name in both engines here
        return readonly_sql.select(session, statement.replace("ILIKE", "LIKE"))


for _name, (_tables, _statement) in STATEMENTS.items():
    _register(_name, _tables, " ".join(_statement.split()))

#: What the tool's dialect adds: the statement as users write it, and the same in the other engine's words.
DIALECT: dict[str, tuple[tuple[str, ...], str, str]] = {
    "sql_integer_division": (("lineitem",), """
        SELECT l_suppkey / 10 AS g, count(*) / 3 AS third, sum(l_linenumber) / count(*) AS line, sum(l_linenumber) / count(*) / 2 AS half,
               round(sum(l_quantity) / 7, 4) AS qty, 7 / 2 * 1.5 AS c, max(l_linenumber) / 0 AS none FROM lineitem WHERE l_orderkey / 2 > 3 GROUP BY l_suppkey / 10
        ORDER BY g LIMIT 50""", """
        SELECT l_suppkey // 10 AS g, count(*) // 3 AS third, CAST(sum(l_linenumber) // count(*) AS BIGINT) AS line, CAST(sum(l_linenumber) // count(*) // 2 AS BIGINT) AS half,
               round(sum(l_quantity) / 7, 4) AS qty, 4.5::DOUBLE AS c, NULL::BIGINT AS none FROM lineitem WHERE l_orderkey // 2 > 3 GROUP BY l_suppkey // 10
        ORDER BY g LIMIT 50"""),
    "sql_group_concat": (("nation", "region"), """
        SELECT "r_name", group_concat(n_name) AS names, group_concat(DISTINCT substr(n_name, 1, 1)) AS letters, group_concat(n_nationkey / 2, ' + ') AS halves
        FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""", """
        SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(DISTINCT substr(n_name, 1, 1), ',' ORDER BY substr(n_name, 1, 1)) AS letters,
               string_agg(CAST(n_nationkey // 2 AS VARCHAR), ' + ' ORDER BY CAST(n_nationkey // 2 AS VARCHAR)) AS halves
        FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""),
    "sql_total": (("supplier",), """
        SELECT s_nationkey, round(total(s_acctbal), 2) AS t, total(CASE WHEN s_acctbal > 99999 THEN s_acctbal END) AS none, total(s_suppkey) / 2 AS half,
               total(DISTINCT s_nationkey) AS one FROM supplier GROUP BY s_nationkey HAVING total(s_suppkey) > 5 / 2""", """
        SELECT s_nationkey, round(sum(s_acctbal), 2) AS t, 0.0::DOUBLE AS none, sum(s_suppkey)::DOUBLE / 2 AS half,
               s_nationkey::DOUBLE AS one FROM supplier GROUP BY s_nationkey HAVING sum(s_suppkey) > 2"""),
    "sql_glob": (("part",), "SELECT p_type, count(*) AS n FROM part WHERE p_name GLOB '*[a-m]?' AND p_brand NOT GLOB '*#1[123]' GROUP BY p_type", """
        SELECT p_type, count(*) AS n FROM part WHERE p_name GLOB '*[a-m]?' AND NOT p_brand GLOB '*#1[123]' GROUP BY p_type"""),
    "sql_scalar_min_max": (("customer", "orders"), """
        SELECT c_mktsegment, max(min(c_acctbal, 500, c_custkey)) AS low, min(max(c_nationkey, 3)) AS high, count(max(c_custkey, o_orderkey)) AS n_both
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""", """
        SELECT c_mktsegment, max(least(c_acctbal, 500, c_custkey)) AS low, min(greatest(c_nationkey, 3)) AS high, count(CASE WHEN o_orderkey IS NOT NULL THEN 1 END) AS n_both
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"""),
    "sql_text_numbers": (("orders",), """
        SELECT o_orderpriority, CAST(o_orderpriority AS INTEGER) AS rank, CAST(o_orderstatus AS REAL) AS none, CAST(o_orderpriority AS INTEGER) / 2 AS half,
               CAST(count(*) AS TEXT) || '.' AS n, CAST(substr(o_orderpriority, 1, 1) || '.5e1x' AS REAL) AS r FROM orders GROUP BY o_orderpriority, CAST(o_orderstatus AS REAL)""", """
        SELECT o_orderpriority, CAST(coalesce(nullif(regexp_extract(o_orderpriority, '^[0-9]+'), ''), '0') AS BIGINT) AS rank, 0.0::DOUBLE AS none,
               CAST(coalesce(nullif(regexp_extract(o_orderpriority, '^[0-9]+'), ''), '0') AS BIGINT) // 2 AS half, CAST(count(*) AS VARCHAR) || '.' AS n,
               coalesce(try_cast(substr(o_orderpriority, 1, 1) || '.5e1' AS DOUBLE), 0.0) AS r FROM orders GROUP BY o_orderpriority"""),
    "sql_right_join": (("supplier", "nation"), *["""
        SELECT n_name, count(s_suppkey) AS n_suppliers FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey AND s_acctbal < 1000 GROUP BY n_name"""] * 2),
    "sql_cross_join": (("region",), *["""
        SELECT a.r_name AS one, b.r_name AS two FROM region a CROSS JOIN region b WHERE a.r_regionkey <> b.r_regionkey ORDER BY one, two LIMIT 50"""] * 2),
    "sql_natural_join": (("customer", "supplier"), *["""
        SELECT nation_key, n_customers, n_suppliers FROM (SELECT c_nationkey AS nation_key, count(*) AS n_customers FROM customer GROUP BY c_nationkey) a
        NATURAL JOIN (SELECT s_nationkey AS nation_key, count(*) AS n_suppliers FROM supplier GROUP BY s_nationkey) b"""] * 2),
    "sql_row_limit": (("customer",), "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 50"),
}


def _register_dialect(name: str, tables: tuple[str, ...], statement: str, sql: str) -> None:
    @register(name, sql)
    def run(spark, sf_dir):
        return readonly_sql.select(readonly_sql.reader_session(spark, {t: table(spark, sf_dir, t) for t in tables}), statement)


for _name, (_tables, _statement, _sql) in DIALECT.items():
    _register_dialect(_name, _tables, *(" ".join(x.split()) for x in (_statement, _sql)))


@register("sql_no_row_limit", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def sql_no_row_limit(spark, sf_dir):
    """The row limit is an argument; without it the tool returns every row."""
    session = readonly_sql.reader_session(spark, {"customer": table(spark, sf_dir, "customer")})
    return readonly_sql.select(session, "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0", max_rows=None)
