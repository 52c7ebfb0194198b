"""Registered queries over capacity use, shared sources and calibration, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import prep as P
from tracewright.operators import utilisation as U
from tracewright.plans.graphs import _CLOSURE, RUN
from tracewright.plans.tasks import TASKS
from tracewright.sources import tables as T
from tracewright.sources.tables import with_frames as frames

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(func):
        QUERIES[func.__name__] = func
        if sql:
            ORACLES[func.__name__] = sql
        return func

    return add


@query(frames("spans") + """, x AS (SELECT *, attempt < max(attempt) OVER (PARTITION BY run_id, element_uid, task_kind) - 10 AS retried FROM spans)
    SELECT run_id, CASE WHEN retried THEN 'WASTED_RETRY' WHEN task_kind = 'BUILD' AND span_seq % 5 = 0 THEN 'WASTED_REBUILD' ELSE 'USEFUL' END AS bucket, CAST(sum(dur_us) AS BIGINT) AS dur_us FROM x GROUP BY 1, 2""")
def u_buckets(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("run_id", "element_uid", "task_kind")
    s = T.spans(spark, d).withColumns({"retried": F.col("attempt") < F.max("attempt").over(w) - 10, "rebuilt": (F.col("task_kind") == "BUILD") & (F.col("span_seq") % 5 == 0)})
    return U.buckets(s)


@query(TASKS + """, cl AS (SELECT *, finish_us - start_us AS len FROM (SELECT run_id, task_key, ready_us, greatest(start_us, ready_us) AS start_us, finish_us FROM ready_tasks) WHERE start_us <= finish_us),
    b AS (SELECT run_id, start_us AS t, 1 AS r, 0 AS p FROM cl WHERE finish_us > start_us UNION ALL SELECT run_id, finish_us, -1, 0 FROM cl WHERE finish_us > start_us
          UNION ALL SELECT run_id, ready_us, 0, 1 FROM cl WHERE start_us > ready_us UNION ALL SELECT run_id, start_us, 0, -1 FROM cl WHERE start_us > ready_us),
    st AS (SELECT run_id, t, sum(r) AS r, sum(p) AS p FROM b GROUP BY 1, 2),
    sw AS (SELECT run_id, lead(t) OVER w - t AS width, sum(r) OVER w AS r, sum(p) OVER w AS p FROM st WINDOW w AS (PARTITION BY run_id ORDER BY t)),
    wa AS (SELECT run_id, coalesce(sum(greatest(0, 4 - r) * width) FILTER (p > 0), 0) AS waited FROM sw GROUP BY 1),
    o AS (SELECT run_id, 4 * (max(finish_us) - min(start_us)) AS cap, sum(len) AS used FROM cl GROUP BY 1), q AS (SELECT o.run_id, cap, used, greatest(0, cap - used) AS idle, waited FROM o JOIN wa ON wa.run_id = o.run_id)
    SELECT run_id, CAST(cap AS BIGINT) AS capacity_us, CAST(used AS BIGINT) AS used_us, CAST(idle AS BIGINT) AS idle_us, CAST(least(waited, idle) AS BIGINT) AS underparallel_us, CAST(idle - least(waited, idle) AS BIGINT) AS no_tasks_us FROM q""")
def u_accounting(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = P.clamped(P.ready_times(P.quantised(T.spans(spark, d)), T.run_edges(spark, d)))
    return U.accounting(kept.withColumn("dur_us", F.col("finish_us") - F.col("start_us")), 4)


def _sources(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("uid", 2, 20).cast("long")
    return T.run_elements(spark, d).select("run_id", "uid", F.lit("git").alias("kind"), F.concat(F.lit("host.org/repo"), n % 6).alias("identity"), F.lit("ref").alias("keying"))


_BLAST = RUN + _CLOSURE + """, src AS (SELECT run_id, uid, 'git' AS kind, 'host.org/repo' || (CAST(substr(uid, 2) AS BIGINT) % 6) AS identity FROM run_elements),
    hit AS (SELECT run_id, kind, identity, uid FROM src UNION SELECT s.run_id, s.kind, s.identity, r.uid FROM src s JOIN reach r ON r.run_id = s.run_id AND r.ancestor = s.uid),
    bl AS (SELECT h.run_id, h.kind, h.identity, count(*) AS n_hit, CAST(sum(n.dur_us) AS BIGINT) AS hit_us, (SELECT count(*) FROM src s WHERE s.run_id = h.run_id AND s.identity = h.identity) AS n_own
           FROM hit h JOIN run_elements n ON n.run_id = h.run_id AND n.uid = h.uid GROUP BY h.run_id, h.kind, h.identity)"""


@query(_BLAST + " SELECT run_id, kind, identity, n_own, n_hit, hit_us FROM bl")
def u_resource_blast(spark: SparkSession, d: str) -> DataFrame:
    return U.resource_blast(T.run_elements(spark, d), T.run_edges(spark, d), _sources(spark, d))


@query(_BLAST + """, t AS (SELECT run_id, count(*) AS total FROM run_elements GROUP BY 1), r AS (SELECT bl.*, row_number() OVER (PARTITION BY bl.run_id ORDER BY hit_us DESC, n_hit DESC, identity) AS nth FROM bl JOIN t ON t.run_id = bl.run_id WHERE n_hit >= 0.5 * total)
    SELECT run_id, kind, identity, n_own, n_hit, hit_us FROM r WHERE nth = 1""")
def u_shared_source(spark: SparkSession, d: str) -> DataFrame:
    return U.shared_source_headline(u_resource_blast(spark, d), T.run_elements(spark, d))


@query(RUN + " SELECT run_id, uid FROM run_elements WHERE CAST(substr(uid, 2) AS BIGINT) % 6 = 3")
def u_elements_of_source(spark: SparkSession, d: str) -> DataFrame:
    return U.elements_of(_sources(spark, d), "https://git@Host.org/repo3.git")


@query(frames("spans") + """, p AS (SELECT element_uid, run_id % 4 * 2 + attempt % 4 AS c, CAST(floor(avg(dur_us)) AS BIGINT) AS m FROM spans GROUP BY 1, 2),
    g AS (SELECT element_uid, max(c) FILTER (c <= 3) AS lc, arg_max(m, c) FILTER (c <= 3) AS lm, min(c) FILTER (c >= 3) AS hc, arg_min(m, c) FILTER (c >= 3) AS hm FROM p GROUP BY 1)
    SELECT element_uid, CASE WHEN lc IS NULL OR hc IS NULL THEN coalesce(lm, hm) WHEN lc = hc THEN lm ELSE CAST(round_even(lm + (hm - lm) * (3 - lc) / (hc - lc), 0) AS BIGINT) END AS dur_us, lc IS NULL OR hc IS NULL AS extrapolated FROM g""")
def u_calibrated(spark: SparkSession, d: str) -> DataFrame:
    history = T.spans(spark, d).withColumn("capacity", F.col("run_id") % 4 * 2 + F.col("attempt") % 4)
    return U.calibrated(U.calibration(history), 3)


def _targets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets of every shape, and sources of both keyings: (targets, sources, elements)."""
    nodes = T.run_elements(spark, d)
    n = F.substring("uid", 2, 20).cast("long")
    at = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    files = nodes.filter(n % 4 == 1).select("run_id", "uid", F.lit("local").alias("kind"), at("files/d", n % 5, "/src").alias("identity"), F.lit("content").alias("keying"))
    sources = _sources(spark, d).filter(n % 4 != 1).unionByName(files)
    few = spark.range(24).select(F.col("id").alias("i"))
    i = F.col("i")
    shapes = F.array(at("https://git@Host.org/repo", i % 6, ".git"), at("./files/d", i % 7, "/src/lib/f", i, ".c"), at("files/d", i % 7, "/"), at("host.org/repo", i % 6), at("u", i), at("files/d", i % 7, "/srcs/x.c"))
    return few.select(F.explode(shapes).alias("target")), sources, nodes


_RESOLVED = RUN + """, sr AS (SELECT run_id, uid, CASE WHEN n % 4 = 1 THEN 'content' ELSE 'ref' END AS keying, CASE WHEN n % 4 = 1 THEN 'files/d' || (n % 5) || '/src' ELSE 'host.org/repo' || (n % 6) END AS identity FROM (SELECT *, CAST(substr(uid, 2) AS BIGINT) AS n FROM run_elements)),
    tg AS (SELECT DISTINCT unnest(['https://git@Host.org/repo' || (i % 6) || '.git', './files/d' || (i % 7) || '/src/lib/f' || i || '.c', 'files/d' || (i % 7) || '/', 'host.org/repo' || (i % 6), 'u' || i, 'files/d' || (i % 7) || '/srcs/x.c']) AS target FROM range(24) r(i)),
    tp AS (SELECT target, regexp_replace(regexp_replace(target, '^[.]/', ''), '/$', '') AS path FROM tg),
    rs AS (SELECT run_id, target, 'url' AS resolved_as, uid FROM tp JOIN sr ON keying = 'ref' AND (identity = target OR (target LIKE 'https://%' AND identity = 'host.org/' || regexp_extract(target, 'repo[0-9]+')))
        UNION SELECT run_id, target, 'path', uid FROM tp JOIN sr ON keying = 'content' AND contains(target, '/') AND (identity = path OR starts_with(identity, path || '/') OR starts_with(path, identity || '/'))
        UNION SELECT run_id, target, 'element', uid FROM tp JOIN run_elements ON uid = target)"""


@query(_RESOLVED + " SELECT run_id, target, resolved_as, uid FROM rs")
def u_resolve_targets(spark: SparkSession, d: str) -> DataFrame:
    """The elements that a table of addresses, paths and names means."""
    return U.resolve_targets(*_targets(spark, d))


@query(_RESOLVED + _CLOSURE + """, ht AS (SELECT run_id, target, resolved_as, uid FROM rs UNION SELECT rs.run_id, target, resolved_as, r.uid FROM rs JOIN reach r ON r.run_id = rs.run_id AND r.ancestor = rs.uid)
    SELECT h.run_id, h.target, h.resolved_as, any_value(n_direct) AS n_direct, count(*) AS n_hit, CAST(sum(dur_us) AS BIGINT) AS hit_us FROM ht h JOIN run_elements e ON e.run_id = h.run_id AND e.uid = h.uid
    JOIN (SELECT run_id, target, count(*) AS n_direct FROM rs GROUP BY 1, 2) d ON d.run_id = h.run_id AND d.target = h.target GROUP BY 1, 2, 3""")
def u_target_blast(spark: SparkSession, d: str) -> DataFrame:
    """What a change of each of them rebuilds."""
    targets, sources, nodes = _targets(spark, d)
    return U.target_blast(U.resolve_targets(targets, sources, nodes), nodes, T.run_edges(spark, d))
