"""Totals that keep unknown apart from zero, histograms, percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_sum(c: Column | str) -> Column:
    """The sum, or null if any value is unknown; 0 without rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count("*"), F.coalesce(F.sum(c), F.lit(0)))


def reduction_percent(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise((before - after) / before * 100)


def run_summary(records: DataFrame, status: str = "status", reason: str = "decision_reason") -> DataFrame:
    """level, status, reason, n, total_in, total_out, total_saved: over all, by status, and by reason of the unchanged ones, in one pass.

    An output size of 0 or null counts as the source's size, a reason that is null or empty as not_recorded.
    """
    rows = records.select(
        F.col(status).alias("status"),
        F.when(F.col(status) == "UNCHANGED", F.coalesce(F.nullif(reason, F.lit("")), F.lit("not_recorded"))).alias("reason"),
        F.coalesce("source_size", F.lit(0)).alias("size"),
        F.coalesce(F.nullif("output_size", F.lit(0)), "source_size", F.lit(0)).alias("out"),
        F.coalesce("saved_bytes", F.lit(0)).alias("saved"),
    )
    sums = [F.count("*").alias("n"), F.sum("size").alias("total_in"), F.sum("out").alias("total_out"), F.sum("saved").alias("total_saved")]
    sets = rows.groupingSets([[], ["status"], ["status", "reason"]], "status", "reason").agg(F.grouping_id().alias("g"), *sums)
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "status").otherwise("reason")
    return sets.where("g > 0 or reason is not null").select(level.alias("level"), "status", "reason", "n", "total_in", "total_out", "total_saved")


def report_totals(report: DataFrame, by: Sequence[str] = (), error: Column | None = None, count_errors: bool = True) -> DataFrame:
    """Totals of a report: count, errors, orig_size, new_size and saved, the last two null if a size is unknown."""
    error = F.col("status") == "ERROR" if error is None else error
    n = F.count("*") if count_errors else F.count_if(~F.coalesce(error, F.lit(False)))
    new = known_sum("output_size")
    return report.groupBy(*by).agg(n.alias("count"), F.count_if(error).alias("errors"), F.sum("source_size").alias("orig_size"), new.alias("new_size"), F.when(new.isNotNull(), F.sum("source_size") - new).alias("saved"))


def rollup(totals: Sequence[DataFrame]) -> DataFrame:
    """One row over several reports' totals: unknown if any is unknown; no reduction if nothing came in."""
    rows = totals[0]
    for t in totals[1:]:
        rows = rows.unionByName(t)
    out = rows.agg(*(known_sum(c).alias(c) for c in ("count", "errors", "orig_size", "new_size")))
    return out.withColumn("saved", F.col("orig_size") - F.col("new_size")).withColumn("reduction", reduction_percent(F.col("orig_size"), F.col("new_size")))


def status_histogram(rows: DataFrame, by: Sequence[str], status: str) -> DataFrame:
    """by and a map from status to count, in order of status."""
    counts = rows.groupBy(*by, status).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("statuses"))


def reason_text(rows: DataFrame, by: Sequence[str], reason: str) -> DataFrame:
    """by and 'reason=count; ...' in order of reasons."""
    counts = rows.groupBy(*by, reason).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(reason).alias("reason"), "n")))
    return counts.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda s: F.concat(s["reason"], F.lit("="), s["n"].cast("string"))), "; ").alias("text"))


def quality(frames: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """by, frames, mean and p5 (nearest rank) of finite scores."""
    fine = frames.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) < float("inf")))
    p5 = F.expr(f"percentile_disc(0.05) within group (order by {score})")
    return fine.groupBy(*by).agg(F.count("*").alias("frames"), F.avg(score).alias("mean"), p5.alias("p5"))


def bounded_collect(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], size: str, limit: int) -> DataFrame:
    """The first rows of each group while their sizes so far are at most limit."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= limit)


def outcome_counts(results: DataFrame) -> DataFrame:
    """success, errors, warnings, input_bytes, output_bytes; bytes of failed rows don't count. results: action, warnings (array), source_size, output_size."""
    ok = F.col("action") != "ERROR"
    return results.agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("errors"), F.sum(F.size("warnings")).alias("warnings"), F.sum(F.when(ok, F.col("source_size"))).alias("input_bytes"), F.sum(F.when(ok, F.col("output_size"))).alias("output_bytes"))


def unchanged(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row, same: whether both have the same keys with the same columns."""
    pairs = before.alias("a").join(after.alias("b"), key, "full_outer")
    equal = F.lit(True)
    for c in columns:
        equal = equal & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return pairs.agg(F.coalesce(F.bool_and(equal & F.col(f"a.{columns[0]}").isNotNull() & F.col(f"b.{columns[0]}").isNotNull()), F.lit(True)).alias("same"))


def used_codes(rows: DataFrame, by: Sequence[str], code: str) -> DataFrame:
    """by and the sorted distinct codes: a group holds at most as many as its alphabet has."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(code)).alias("codes"))


def within_budget(rows: DataFrame, by: Sequence[str], costs: dict[str, int]) -> DataFrame:
    """Rows of the groups whose summed costs all stay within their limits; groups beyond are left out as a whole, before any work is done on them."""
    over = F.lit(False)
    for c, most in costs.items():
        over = over | (F.sum(c) > most)
    return rows.join(rows.groupBy(*by).agg(over.alias("_over")).where("_over").select(*by), list(by), "left_anti")
