"""Statements in the words of the embedded database, and what the SQL tool does not let through."""

import re
import sqlite3

import pytest

from lectern.plans import dialect, readonly_sql

ROWS = [("a", 7, 2, 1.5, "12x"), ("b*c", -7, 0, None, "x"), (None, 3, None, 2.5, None), ("abc", 4, 2, 0.5, " -3.5e1kg"), ("A?", -9, 4, -2.0, "1.")]


@pytest.fixture(scope="module")
def session(spark):
    return readonly_sql.reader_session(spark, {"t": spark.createDataFrame(ROWS, "x string, i int, j long, d double, s string")})


@pytest.fixture(scope="module")
def embedded():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (x TEXT, i INTEGER, j INTEGER, d REAL, s TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", ROWS)
    return con


@pytest.mark.parametrize("query", [
    "SELECT i / j AS a, (i / j) / 2 AS b, i / 2 / 2 AS c, i / d AS e, i / (j / 2) AS f, 3/2 AS g, 7 / 2.0 AS h, -7 / 2 AS k FROM t",
    "SELECT sum(i) / count(*) AS a, avg(i) / 2 AS b, count(*) / 2 AS c, max(i) / min(j) AS e FROM t WHERE i / 2 > -4 HAVING sum(i) / 2 < 100",
    "SELECT total(d) AS a, total(i) / 2 AS b, (SELECT total(i) FROM t WHERE i > 99) AS c, sum(i) AS e FROM t",
    "SELECT j, total(i) AS a FROM t GROUP BY j ORDER BY total(i), j",
    "SELECT x, total(i) OVER (PARTITION BY j) AS a FROM t",
    "SELECT min(i, j) AS a, max(i, 3, j) AS b, min(min(d, 9.5), 1.0) AS c, max(x) AS m, min(x, s) AS n FROM t GROUP BY i, j, d, x, s",
    "SELECT CAST(s AS INTEGER) AS a, CAST(s AS REAL) AS b, CAST(s AS INTEGER) / 2 AS c, CAST(i AS TEXT) || '/' AS e, CAST(d AS INTEGER) AS f FROM t",
    "SELECT x FROM t WHERE x GLOB 'a*' OR x GLOB 'b[*]?' OR x GLOB '[A-Z][?]'", "SELECT x FROM t WHERE x NOT GLOB '*b*'", "SELECT x, 'a.c' GLOB 'a.' AS g, 'abc' GLOB x AS h, s GLOB x || '*' AS k FROM t",
    "SELECT \"x\" AS \"Nom\", \"nope\" AS k, 'it''s' AS q, 'a\\b' AS bs, 'LIKE / total(' AS lit FROM t WHERE \"i\" > 0 -- a comment / with signs\n",
    "SELECT x FROM t WHERE x LIKE 'AB%' /* x GLOB 'q' */", "WITH c AS (SELECT i / 2 AS h FROM t) SELECT h / 2 AS q FROM c WHERE h IN (SELECT i / 2 FROM t)",
    "SELECT group_concat(x) AS a FROM (SELECT x FROM t ORDER BY x)", "SELECT i % 0 AS a, 1 / 0 AS b, 5 % 3 AS c FROM t",
    "SELECT a.x AS one, b.i / 2 AS two FROM t a LEFT JOIN t b ON a.i / 4 = b.j / 2 AND a.x <> b.x",
])
def test_answers_of_the_embedded_database(session, embedded, query):
    cursor = embedded.execute(query)
    names = [d[0] for d in cursor.description]
    said = lambda v: str(int(v)) if isinstance(v, bool) else str(v)
    want = sorted(tuple(map(said, r)) for r in cursor.fetchall())
    got = readonly_sql.select(session, query, None)
    assert got.columns == names and sorted(tuple(map(said, r)) for r in got.collect()) == want


def test_group_concat_is_in_ascending_order(session):
    rows = readonly_sql.search_tables(session, "SELECT group_concat(DISTINCT j) AS a, group_concat(x, ' + ') AS b, group_concat(x) FILTER (WHERE i > 0) AS c FROM t")
    assert rows == [{"a": "0,2,4", "b": "A? + a + abc + b*c", "c": "a,abc"}]


def test_only_the_given_views_are_read(spark, session):
    spark.range(3).createOrReplaceGlobalTempView("shared_rows")
    spark.range(3).write.mode("overwrite").saveAsTable("kept_rows")
    spark.range(3).createOrReplaceTempView("others_rows")
    try:
        for name in ("global_temp.shared_rows", "kept_rows", "default.kept_rows", "spark_catalog.default.kept_rows", "IDENTIFIER('global_temp.shared_rows')", "others_rows"):
            for query in (f"SELECT * FROM {name}", f"WITH c AS (SELECT * FROM {name}) SELECT 1 FROM c", f"SELECT x FROM t WHERE i IN (SELECT id FROM {name})", f"SELECT (SELECT max(id) FROM {name}) AS m FROM t"):
                assert list(readonly_sql.search_tables(session, query)[0]) == ["error"], query
        assert len(readonly_sql.search_tables(session, "SELECT * FROM t")) == len(ROWS)
    finally:
        spark.sql("DROP TABLE kept_rows")
        spark.catalog.dropGlobalTempView("shared_rows")


def test_glob_patterns():
    for glob, yes, no in (("a*", "a\nb", "ba"), ("[a-c]?", "bz", "dz"), ("[^a]", "b", "a"), ("a.c", "a.c", "abc"), ("[", "[", "a"), ("[]a]", "]", "b"), ("x[", "x[", "x")):
        pattern = re.compile(dialect.glob_pattern(glob).replace("[]a]", r"[\]a]"))
        assert pattern.match(yes) and not pattern.match(no), glob
