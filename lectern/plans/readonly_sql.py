"""Ad-hoc read-only SQL over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.config import DEFAULT
from lectern.functions.text import let, strip
from lectern.plans import dialect

TABLE_SCHEMA_TEXT = """Tables:
1. analytics(dop STRING, gi_type STRING, wine_type STRING, parameter STRING, value DOUBLE, unit STRING, relation STRING)
   parameter: grado_alcoholico, acidez_volatil, acidez_total, so2_total, azucares_residuales, azucares_totales
   wine_type: blanco, rosado, tinto, espumoso, generoso, general
   relation: min, max, target
2. varieties(dop STRING, gi_type STRING, variety STRING, color STRING, role STRING)
   color: blanca, tinta, unknown
   role: principal, secundaria, autorizada
3. yields(dop STRING, gi_type STRING, wine_type STRING, variety STRING, kg_ha DOUBLE, hl_ha DOUBLE)
4. municipalities(dop STRING, gi_type STRING, municipality STRING, zone STRING, province STRING)
"""

_INHERITED = (
    "spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled",
)
#: A division by zero is NULL; files are no tables.
_FIXED = {"spark.sql.ansi.enabled": "false", "spark.sql.parser.escapedStringLiterals": "false", "spark.sql.runSQLOnFiles": "false"}


def statement_body(query: Column) -> Column:
    """The statement without surrounding blanks and without one closing semicolon."""
    text = strip(query)
    return F.when(F.endswith(text, F.lit(";")), strip(F.left(text, F.length(text) - 1))).otherwise(text)


def guard(query: Column) -> Column:
    """NULL for an acceptable statement, otherwise why it is refused."""
    blocked = F.array(*[F.lit(w) for w in V.BLOCKED_SQL_WORDS])

    def verdict(body: Column) -> Column:
        low = F.lower(body)
        hit = F.array_sort(F.array_intersect(F.split(low, "[^a-z_]+"), blocked))
        return (
            F.when(F.contains(body, F.lit(";")), F.lit(V.SQL_ERROR_MULTI))
            .when(~(F.startswith(low, F.lit("select")) | F.startswith(low, F.lit("with"))), F.lit(V.SQL_ERROR_NOT_SELECT))
            .when(F.size(hit) > 0, F.concat(F.lit(V.SQL_ERROR_WORDS), F.array_join(hit, ", "), F.lit(".")))
        )

    empty = F.coalesce(F.length(strip(query)), F.lit(0)) == 0
    return F.when(empty, F.lit(V.SQL_ERROR_EMPTY)).otherwise(let(statement_body(query), verdict))


def reader_session(spark: SparkSession, views: dict[str, DataFrame]) -> SparkSession:
    """A session for statements over the given views; files are no tables in it, and ``select`` refuses all other relations."""
    session = spark.newSession()
    for key in _INHERITED:
        session.conf.set(key, spark.conf.get(key))
    for key, setting in _FIXED.items():
        session.conf.set(key, setting)
    for name, df in views.items():
        # same logical plan, bound to the reader session
        moved = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.logicalPlan())
        DataFrame(moved, session).createOrReplaceTempView(name)
    return session


#: Nodes of an analysed plan that only read and combine the given views.
ALLOWED_NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Tail Join SubqueryAlias View LocalRelation "
    "OneRowRelation Distinct Deduplicate Union Intersect Except Window WithCTE CTERelationDef CTERelationRef Expand Pivot Unpivot "
    "LateralJoin ResolvedHint UnresolvedHint Range Generate".split()
)
#: Expressions that run code, read files or look at the machine; all others of the engine's own packages compute on rows.
REFUSED_EXPRESSIONS = frozenset(
    "CallMethodViaReflection TryReflect ScalaUDF PythonUDF PythonUDAF HiveSimpleUDF HiveGenericUDF InputFileName InputFileBlockStart InputFileBlockLength "
    "CurrentUser CurrentDatabase CurrentCatalog SparkVersion".split()
)
OWN_EXPRESSIONS = "org.apache.spark.sql.catalyst."


def foreign_parts(result: DataFrame) -> list[str]:
    """Names of the plan's nodes and expressions that a read-only statement may not hold; the plan isn't run."""
    found: set[str] = set()

    def each(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def expression(e) -> None:
        cls = e.getClass()
        name = cls.getSimpleName().rstrip("$")
        if name in REFUSED_EXPRESSIONS or not cls.getName().startswith(OWN_EXPRESSIONS):
            found.add(name)
        if cls.getName().endswith(("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")):
            node(e.plan())
        for child in each(e.children()):
            expression(child)

    def node(plan) -> None:
        name = plan.getClass().getSimpleName()
        if name not in ALLOWED_NODES:
            found.add(name)
        if name == "View":
            # views of this session are the caller's; those shared by sessions or kept in a catalogue have a database
            if not plan.isTempView() or plan.desc().identifier().database().isDefined():
                found.add(plan.desc().identifier().unquotedString())
            return
        for e in each(plan.expressions()):
            expression(e)
        for child in each(plan.children()):
            node(child)

    node(result._jdf.queryExecution().analyzed())
    return sorted(found)


def check(spark: SparkSession, query: str) -> str | None:
    return spark.range(1).select(guard(F.lit(query).cast("string")).alias("e")).first()[0]


def select(session: SparkSession, query: str, max_rows: int | None = DEFAULT.sql_rows) -> DataFrame:
    """Result of an accepted statement (see ``dialect``), at most ``max_rows`` rows; ValueError when refused."""
    error = check(session, query)
    if error is not None:
        raise ValueError(error)
    body = query.strip()
    body = body[:-1] if body.endswith(";") else body
    columns = {c.lower() for t in session.catalog.listTables() if t.isTemporary and not t.namespace for c in session.table(t.name).columns}
    text = dialect.reworded(body, columns)
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(text)
    writing = session._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    command = session._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    if writing.isInstance(plan) or command.isInstance(plan):
        raise ValueError(V.SQL_ERROR_NOT_SELECT)
    result = session.sql(dialect.spark_sql(session, text))
    refused = foreign_parts(result)
    if refused:
        raise ValueError(V.SQL_ERROR_WORDS + ", ".join(refused) + ".")
    return result if max_rows is None else result.limit(max_rows)


def search_tables(session: SparkSession | None, query: str, max_rows: int = DEFAULT.sql_rows) -> list[dict]:
    """Rows as dictionaries; any failure is reported as one row with ``error``."""
    if session is None:
        return [{"error": "Tables not found. Build the tables first."}]
    try:
        return [row.asDict(recursive=True) for row in select(session, query, max_rows).collect()]
    except Exception as exc:
        return [{"error": str(exc)}]
