"""Incremental runs: which sources still need work, and how results go into the state table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import sizes
from tessera.operators.cascade import first_match, violations


def should_process(found: Column, same_source: Column, same_config: Column, digest: Column, status: Column, output_matches: Column, output_required: bool, retry_errors: bool) -> Column:
    """Whether a source needs work, given its record in the state."""
    missing = F.coalesce(digest, F.lit("")) == ""
    return first_match(
        [
            (~found, F.lit(True)),
            (~F.coalesce(same_source, F.lit(False)), F.lit(True)),
            (~F.coalesce(same_config, F.lit(False)), F.lit(True)),
            (F.lit(output_required) & missing, F.lit(True)),
            (status == "ERROR", F.lit(retry_errors) | (F.lit(output_required) & ~F.coalesce(output_matches, F.lit(False)))),
            (F.lit(output_required) & ~F.coalesce(output_matches, F.lit(False)), F.lit(True)),
        ],
        F.lit(False),
    )


def resume(snapshot: DataFrame, state: DataFrame, config_hash: str, output_required: bool = True, retry_errors: bool = False) -> DataFrame:
    """snapshot (source_path, source_sha256, output_matches) with todo: whether the source needs work."""
    old = state.select("source_path", F.col("source_sha256").alias("_sha"), F.col("config_hash").alias("_config"), F.col("output_sha256").alias("_out"), F.col("status").alias("_status"), F.lit(True).alias("_found"))
    todo = should_process(F.coalesce("_found", F.lit(False)), F.col("source_sha256") == F.col("_sha"), F.col("_config") == config_hash, F.col("_out"), F.col("_status"), F.col("output_matches"), output_required, retry_errors)
    return snapshot.join(old, "source_path", "left").select(*snapshot.columns, todo.alias("todo"))


def lookup(state: DataFrame, keys: DataFrame, key: str = "source_path") -> DataFrame:
    """State rows of the given keys; Spark broadcasts the keys if they are few."""
    return state.join(keys.select(key).distinct(), key, "left_semi")


def upsert(state: DataFrame, updates: DataFrame, key: str = "source_path", defaults: dict[str, object] | None = None, order: str | None = None) -> DataFrame:
    """state with its rows replaced by updates of the same key; columns that either lacks get a default or null. Of several updates
    of a key the one with the largest order stays, or without one the largest by its columns from left to right. Write it to a new
    place, never to the one that state reads."""
    rest = F.struct(*(c for c in updates.columns if c != key))
    last = updates.groupBy(key).agg(F.max(F.struct((F.col(order) if order else F.lit(0)).alias("by"), rest.alias("row"))).alias("last"))
    updates = last.select(*(F.col(key) if c == key else F.col(f"last.row.{c}") for c in updates.columns))
    out = updates.unionByName(state.join(updates.select(key), key, "left_anti"), allowMissingColumns=True)
    return out.fillna({k: v for k, v in (defaults or {}).items() if k in out.columns})


def reuse_problems(max_w: int = 1280, max_h: int = 720, max_fps: float = 30.0, min_mean: float = 85.0, min_p5: float = 70.0, min_saved: tuple[int, float] = (1 << 20, 0.10)) -> Column:
    """Codes of what stands against reusing a video's record, joined to its source (columns size and sha256) and config (config_hash, wanted_config)."""
    adopted = F.col("status") == "ADOPTED"
    if_adopted = lambda c: ~adopted | c
    saved = F.col("size") - F.col("output_size")
    percent = sizes.saved_percent(F.col("size"), F.col("output_size"))
    positive = lambda c: F.col(c).isNull() | ((F.col(c) > 0) & (F.col(c) < float("inf")))
    score = lambda c: F.col(c).isNull() | F.col(c).between(0, 100)
    return violations(
        [
            ("status", F.col("status").isin("ADOPTED", "UNCHANGED", "SKIPPED_STANDARD", "SKIPPED_COMPLEX", "SKIPPED_UNSUPPORTED")),
            ("preset", (F.col("status") == "SKIPPED_STANDARD") == (F.col("preset") == "standard")),
            ("source", (F.col("source_sha256") == F.col("sha256")) & (F.col("source_size") == F.col("size"))),
            ("config", F.col("config_hash") == F.col("wanted_config")),
            ("output_size", F.col("output_size") >= 0),
            ("saved_bytes", (F.col("saved_bytes") == saved) & (saved >= 0)),
            ("savings", F.when(adopted, sizes.enough_saved(F.col("size"), F.col("output_size"), *min_saved)).otherwise(saved == 0)),
            ("saved_percent", sizes.is_close(F.col("saved_percent"), percent, 1e-12, 1e-9)),
            ("digest", F.col("output_sha256").rlike(r"^[0-9a-fA-F]{64}\z")),
            ("copy", adopted | (F.lower("output_sha256") == F.lower("sha256"))),
            ("error", F.coalesce("error_message", F.lit("")) == ""),
            ("numbers", positive("width") & positive("height") & positive("fps") & positive("duration") & score("vmaf_mean") & score("vmaf_p5")),
            ("shape", if_adopted((F.col("width") <= max_w) & (F.col("height") <= max_h) & (F.col("width") % 2 == 0) & (F.col("height") % 2 == 0) & (F.col("fps") <= max_fps) & (F.col("duration") > 0))),
            ("quality", if_adopted((F.col("vmaf_mean") >= min_mean) & (F.col("vmaf_p5") >= min_p5))),
            ("codec", if_adopted(F.lower("video_codec") == "av1")),
        ]
    )


def reuse(plan: DataFrame, previous: DataFrame) -> DataFrame:
    """plan (source_path, sha256, size) with the previous run's output where the source is the same and its record was a success; previous: source_path, source_sha256, source_size, output_sha256, action. A key that occurs twice voids all of previous."""
    bad = previous.groupBy(F.lower("source_path")).agg(F.count("*").alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_most"))
    good = previous.crossJoin(F.broadcast(bad)).where("_most <= 1 and action in ('CONVERTED', 'SKIPPED_COMPLETE')")  # bad is one row
    old = good.select("source_path", F.col("source_sha256").alias("sha256"), F.col("source_size").alias("size"), "output_sha256")
    return plan.join(old, ["source_path", "sha256", "size"], "left").withColumn("reused", F.col("output_sha256").isNotNull())
