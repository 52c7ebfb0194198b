"""Registered queries over JSON documents: flattened, compared, and reports read back, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import documents as D
from tracewright.operators import intervals as I
from tracewright.plans import tasks
from tracewright.sinks.reports import run_documents
from tracewright.sources import saved_reports as R
from tracewright.sources import tables as T

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(func):
        QUERIES[func.__name__] = func
        if sql:
            ORACLES[func.__name__] = sql
        return func

    return add


def _orders(spark: SparkSession, d: str, later: bool) -> DataFrame:
    """An order and its lines as one JSON document; ``later`` orders differ in status, note, parts and number of lines."""
    k, nth = F.col("o_orderkey"), F.col("l_linenumber")
    # lines are numbered from one within their order
    lines = T.read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"))
    part = F.col("l_partkey") + F.when((F.col("l_orderkey") % 2 == 0) & (nth == 2) & F.lit(later), 1).otherwise(0)
    kept = lines.filter((F.col("l_orderkey") % 3 != 0) | (nth != 1)) if later else lines
    sets = kept.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(nth.alias("line"), part.alias("part"), F.struct(F.col("l_suppkey").alias("key"), "quantity").alias("from")))).alias("lines"))
    orders = T.read(spark, d, "orders")
    orders = orders.filter(k % 11 != 0) if later else orders
    status: Column = F.when((k % 5 == 0) & F.lit(later), "changed").otherwise(F.col("o_orderstatus"))
    text = F.to_json(F.struct(k.alias("order"), status.alias("status"), "lines", F.when((k % 7 != 0) | F.lit(not later), F.struct(F.col("o_orderpriority").alias("text"))).alias("note")), {"ignoreNullFields": "true"})
    return D.parsed(orders.join(sets, k == F.col("l_orderkey")).select(k.alias("doc_id"), text.alias("value")))


_DOCS = """WITH li AS (SELECT l_orderkey AS k, l_linenumber AS nth, l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS BIGINT) AS quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) - 1 AS i FROM lineitem),
    od AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT k FROM li)),
    l2 AS (SELECT k, nth, part + CASE WHEN k % 2 = 0 AND nth = 2 THEN 1 ELSE 0 END AS part, supp, quantity FROM li WHERE k % 3 <> 0 OR nth <> 1),
    la AS (SELECT k, nth, part, supp, quantity, row_number() OVER (PARTITION BY k ORDER BY nth, part, supp, quantity) - 1 AS i FROM l2),
    oz AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey IN (SELECT k FROM la))"""


@query(_DOCS + """ SELECT o_orderkey AS doc_id, 'order' AS path, 'number' AS kind, CAST(o_orderkey AS VARCHAR) AS text FROM od UNION ALL SELECT o_orderkey, 'status', 'string', o_orderstatus FROM od UNION ALL SELECT o_orderkey, 'note.text', 'string', o_orderpriority FROM od
    UNION ALL SELECT k, 'lines[' || i || ']' || p, 'number', CAST(v AS VARCHAR) FROM li, LATERAL (VALUES ('.line', CAST(nth AS BIGINT)), ('.part', part), ('.from.key', supp), ('.from.quantity', quantity)) x(p, v)""")
def doc_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every order's document by its path."""
    return D.flattened(_orders(spark, d, later=False))


@query(_DOCS + """, na AS (SELECT k, count(*) AS n FROM li GROUP BY 1), nz AS (SELECT k, count(*) AS n FROM la GROUP BY 1), bo AS (SELECT od.* FROM od JOIN oz USING (o_orderkey)),
    lines AS (SELECT a.k, a.i, p, CAST(x AS VARCHAR) AS x, CAST(y AS VARCHAR) AS y FROM li a JOIN la z ON z.k = a.k AND z.i = a.i JOIN na ON na.k = a.k JOIN nz ON nz.k = a.k AND nz.n = na.n,
        LATERAL (VALUES ('.line', CAST(a.nth AS BIGINT), CAST(z.nth AS BIGINT)), ('.part', a.part, z.part), ('.from.key', a.supp, z.supp), ('.from.quantity', a.quantity, z.quantity)) v(p, x, y) WHERE x <> y)
    SELECT o_orderkey AS doc_id, '' AS path, 'missing in second' AS what FROM od WHERE o_orderkey NOT IN (SELECT o_orderkey FROM oz)
    UNION ALL SELECT o_orderkey, 'status', 'value' FROM bo WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'note', 'missing in second' FROM bo WHERE o_orderkey % 7 = 0
    UNION ALL SELECT o_orderkey, 'lines', 'length' FROM bo JOIN na ON na.k = o_orderkey JOIN nz ON nz.k = o_orderkey AND nz.n <> na.n
    UNION ALL SELECT k, 'lines[' || i || ']' || p, 'value' FROM lines WHERE k IN (SELECT o_orderkey FROM bo)""")
def doc_difference(spark: SparkSession, d: str) -> DataFrame:
    """Where the later documents of all orders begin to differ from the earlier ones."""
    return D.difference(_orders(spark, d, later=False), _orders(spark, d, later=True)).select("doc_id", "path", "what")


@query(tasks.ORACLES["iv_occupancy"])
def rep_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Occupancy of all runs written into reports and read back from them."""
    occupancy = I.occupancy(T.spans(spark, d))
    written = run_documents({"occupancy": occupancy})
    read = R.reports(D.parsed(written.withColumnRenamed("document", "value").withColumnRenamed("run_id", "doc_id")), ("schema", "occupancy"))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in occupancy.schema if f.name != "run_id")
    return R.report_block(read, "occupancy", columns).withColumnRenamed("doc_id", "run_id")
