"""Choosing among candidates: the best eligible one, or the first step of a ladder that is good enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cascade import first_match

#: Order of kinds of the same size (fixed values); an unknown kind is 3.
PRIORITY = {"lossless": 0, "text_subset": 1, "jpeg_baseline": 1, "jpeg_progressive": 2, "text_gray": 3, "scan_92": 4, "scan_85": 5, "scan_80": 6, "bilevel": 7}


def priority(kind: Column) -> Column:
    return first_match([(kind == k, F.lit(p)) for k, p in PRIORITY.items()], F.lit(3))


def best_candidate(candidates: DataFrame, by: list[str], size: str = "size", order: list[Column | str] | None = None, eligible: Column | None = None) -> DataFrame:
    """For each document its eligible candidate that is least by size, then order. One aggregation, so hot documents are combined in the map tasks."""
    rows = candidates if eligible is None else candidates.where(eligible)
    rest = [c for c in candidates.columns if c not in by]
    least = F.struct(F.col(size).alias("_0"), *((F.col(c) if isinstance(c, str) else c).alias(f"_{i}") for i, c in enumerate(order or [], 1)))
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), least).alias("_best")).select(*by, *(F.col(f"_best.{c}").alias(c) for c in rest))


def decide(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, status, chosen kind, candidate_size and reason for each of docs (doc, lossy).

    candidates: doc, idx, kind, size, reason ('eligible' or why not), in order of idx. A processing error fails the document; the
    best eligible candidate is adopted; else the first candidate's reason is told. candidate_size is always the first one's.
    """
    good = F.col("reason") == "eligible"
    facts = candidates.groupBy("doc").agg(
        F.bool_or(F.col("reason") == "processing_error").alias("failed"),
        F.min_by("kind", F.when(good, F.struct("size", priority(F.col("kind")), "idx"))).alias("kind"),
        F.min_by("size", "idx").alias("candidate_size"),
        F.min_by("reason", "idx").alias("first_reason"),
        F.bool_or(good).alias("any"),
    )
    status = first_match([(F.col("failed"), F.lit("ERROR")), (F.col("any") & F.col("lossy"), F.lit("ADOPTED_LOSSY")), (F.col("any"), F.lit("ADOPTED_LOSSLESS")), (F.col("first_reason").isNotNull(), F.lit("UNCHANGED"))], F.lit("PRESERVED_ORIGINAL"))
    adopted = F.col("status").startswith("ADOPTED")
    return docs.join(facts, "doc", "left").withColumn("status", status).select("doc", "status", F.when(adopted, F.col("kind")).alias("kind"), "candidate_size", F.when(F.col("status") == "UNCHANGED", F.col("first_reason")).when(F.col("status") == "ERROR", "processing_error").otherwise("").alias("reason"))


def candidate_reason(valid: Column, failed: Column, images_changed: Column, original: Column, size: Column, enough: Column) -> Column:
    """Why a candidate isn't eligible, or that it is."""
    return first_match(
        [(failed, "processing_error"), (images_changed == 0, "no_image_savings"), (size >= original, "candidate_not_smaller"), (~valid, "quality_rejected"), (~enough, "reduction_below_threshold")], "eligible"
    )


def ladder(steps: DataFrame, by: list[str], good: Column, enough: Column) -> DataFrame:
    """by, step and outcome: the first step that is good decides, ADOPTED if it also saves enough, else UNCHANGED; without a good step the last one's row is UNCHANGED. steps has a column step."""
    rest = [c for c in steps.columns if c not in by]
    row = F.struct(*rest, good.alias("_good"), enough.alias("_enough"))
    got = steps.groupBy(*by).agg(F.min_by(row, F.when(good, F.col("step"))).alias("first"), F.max_by(row, "step").alias("last")).withColumn("r", F.coalesce("first", "last"))
    outcome = F.when(F.col("r._good") & F.col("r._enough"), "ADOPTED").otherwise("UNCHANGED")
    return got.select(*by, *(F.col(f"r.{c}").alias(c) for c in rest), outcome.alias("outcome"))


def validation(page_counts: Column, geometry: Column, text: Column, rendered: Column, detail: Column, tool_ok: Column) -> Column:
    """The first check that a candidate fails, '' if none; each argument tells whether one holds."""
    return first_match([(~tool_ok, "tool_check"), (~page_counts, "page_count"), (~geometry, "geometry"), (~text, "text"), (~rendered, "render"), (~detail, "detail")], "")


def structure_problem(tolerance: float = 0.5) -> Column:
    """The first way in which a video candidate (c_...) differs from its plan (p_...), '' if none."""
    return first_match(
        [
            (F.col("c_codec") != "av1", "codec"),
            ((F.col("c_width") != F.col("p_width")) | (F.col("c_height") != F.col("p_height")), "dimensions"),
            (F.col("c_fps") > F.col("p_fps") + 0.01, "frame rate"),
            (F.abs(F.col("c_duration") - F.col("p_duration")) > tolerance, "duration"),
            (F.col("c_audio") != F.col("p_audio"), "audio"),
        ],
        "",
    )
