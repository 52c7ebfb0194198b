"""Runs against runs: element and key differences, cold floors, noise bands, verdicts, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.aggregates import MAD_TO_SIGMA, _median


def element_differences(base: DataFrame, candidate: DataFrame, key: str = "uid", value: str = "cache_key") -> DataFrame:
    """(key, status): added, removed, changed or same; a null value on either side is unknown."""
    b, c = base.select(key, F.col(value).alias("b"), F.lit(1).alias("in_b")), candidate.select(key, F.col(value).alias("c"), F.lit(1).alias("in_c"))
    status = F.when(F.col("in_b").isNull(), "added").when(F.col("in_c").isNull(), "removed").when(F.col("b").isNull() | F.col("c").isNull(), "unknown").when(F.col("b") == F.col("c"), "same").otherwise("changed")
    return b.join(c, key, "full_outer").select(key, status.alias("status"))


def cache_churn(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Elements with an unchanged key that the candidate built and the baseline did not; (uid, cache_key, built)."""
    b = base.filter("cache_key IS NOT NULL").select("uid", F.col("cache_key").alias("base_key"), F.col("built").alias("base_built"))
    c = candidate.filter("cache_key IS NOT NULL").select("uid", "cache_key", "built")
    return b.join(c, "uid").withColumn("churned", (F.col("base_key") == F.col("cache_key")) & F.col("built") & ~F.col("base_built"))


def cold_durations(tasks: DataFrame, history: DataFrame) -> DataFrame:
    """``tasks`` with a duration from history: same key, else same element, else same kind; (…, cold_us, tier).

    Both need element_uid, cache_key, task_kind; history also dur_us. Medians are whole microseconds.
    """
    out = tasks
    for tier, keys in (("key", ["cache_key", "task_kind"]), ("element", ["element_uid", "task_kind"]), ("kind", ["task_kind"])):
        known = history.groupBy(*keys).agg(F.floor(F.median("dur_us")).alias(f"{tier}_us"))
        out = out.join(known, keys, "left")
    tier = F.when(F.col("key_us").isNotNull(), "key").when(F.col("element_us").isNotNull(), "element").when(F.col("kind_us").isNotNull(), "kind")
    return out.withColumns({"cold_us": F.coalesce("key_us", "element_us", "kind_us"), "tier": tier}).drop("key_us", "element_us", "kind_us")


def verdicts(pairs: DataFrame, k: float = 3.0, floor: float = 0.01, least: int = 3) -> DataFrame:
    """Verdict on (base_us, candidate_us, history array<long>, incomplete string), smaller being better.

    Without enough history a difference of ``floor`` counts; inside the observed range of a
    band that is narrower than its own history, a difference is within the observed range.
    """
    n, mid = F.size("history"), _median(F.col("history"))
    mad = _median(F.transform("history", lambda x: F.abs(x - F.col("middle"))))
    out = pairs.withColumn("middle", F.when(n >= least, mid)).withColumn("half", F.when(n >= least, F.greatest(F.lit(k * MAD_TO_SIGMA) * mad, F.lit(floor) * F.col("base_us"))))
    delta = F.col("candidate_us") - F.col("base_us")
    center = F.coalesce("middle", F.col("base_us").cast("double"))
    limit = F.coalesce("half", F.lit(floor) * F.col("base_us"))
    off = F.col("candidate_us") - center
    lo, hi = F.array_min("history"), F.array_max("history")
    inside_observed = F.col("half").isNotNull() & (F.col("candidate_us") >= lo) & (F.col("candidate_us") <= hi) & ((lo < center - limit) | (hi > center + limit))
    verdict = (
        F.when(F.col("incomplete").isNotNull() | F.col("base_us").isNull() | F.col("candidate_us").isNull(), "not_comparable")
        .when(F.abs(off) <= limit, "unchanged")
        .when(inside_observed, "within_observed_range")
        .when(off < 0, "improved")
        .otherwise("regressed")
    )
    return out.withColumns({"delta_us": delta, "verdict": verdict}).drop("middle", "half")


def category_deltas(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(category, base_us, candidate_us, points): change of each category's share in percentage points."""
    share = lambda df, n: df.groupBy("category").agg(F.sum("dur_us").alias(n))
    j = share(base, "base_us").join(share(candidate, "candidate_us"), "category", "full_outer").na.fill(0)
    total = j.agg(F.sum("base_us").alias("tb"), F.sum("candidate_us").alias("tc"))
    return j.join(F.broadcast(total)).select("category", "base_us", "candidate_us", F.when((F.col("tb") > 0) & (F.col("tc") > 0), 100 * F.col("candidate_us") / F.col("tc") - 100 * F.col("base_us") / F.col("tb")).alias("points"))


def marginal_efficiency(added: DataFrame) -> DataFrame:
    """Share of the added elements' time that is on the path; null without any. added: (dur_us, on_path)."""
    total = F.sum("dur_us")
    return added.agg(F.when(total > 0, F.sum(F.when(F.col("on_path"), F.col("dur_us")).otherwise(0)) / total).alias("marginal_efficiency"))


def gate_rows(runs: DataFrame, max_regression_pct: float | None, least_efficiency: float | None) -> DataFrame:
    """(run_id, gate, state): pass, FAIL, not applied (no figure) or not requested."""
    def state(asked: bool, figure, fails):
        return F.when(F.lit(not asked), "not requested").when(figure.isNull(), "not applied").when(fails, "FAIL").otherwise("pass")

    change = F.when(F.col("base_us") > 0, 100 * (F.col("candidate_us") - F.col("base_us")) / F.col("base_us"))
    gates = F.array(
        F.struct(F.lit("regression").alias("gate"), state(max_regression_pct is not None, change, change > (max_regression_pct or 0)).alias("state")),
        F.struct(F.lit("efficiency").alias("gate"), state(least_efficiency is not None, F.col("efficiency"), F.col("efficiency") < (least_efficiency or 0)).alias("state")),
    )
    return runs.select("run_id", F.explode(gates).alias("g")).select("run_id", "g.gate", "g.state")


def homogeneity(runs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_values) of the fields in which the runs of a baseline differ."""
    counts = runs.agg(*[F.count_distinct(f).alias(f) for f in fields])
    return counts.unpivot([], fields, "field", "n_values").filter("n_values > 1")
