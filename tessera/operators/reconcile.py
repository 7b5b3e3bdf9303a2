"""Reports held against inventories: every difference is a row with a code, an empty result means they agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import sizes
from tessera.operators.cascade import violations

TEXT_CLASSES = ("text", "text_table", "text_scan", "font_replace", "raster_scan")
COPIES = ("PRESERVED_ORIGINAL", "UNCHANGED", "SKIPPED_SMALL", "SKIPPED_ENCRYPTED", "SKIPPED_SIGNED", "SKIPPED_COMPLEX")
DRY = ("DRY_RUN_PRESERVED", "DRY_RUN_LOSSLESS", "DRY_RUN_LOSSY")


def keys_differ(inventory: DataFrame, report: DataFrame, key: Column) -> DataFrame:
    """key and code of keys that are missing, unexpected or repeated. key: an expression over both, compared as it is."""
    left = inventory.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("have"))
    right = report.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("told"))
    code = F.when(F.col("told").isNull(), "missing").when(F.col("have").isNull(), "unexpected").when((F.col("told") > 1) | (F.col("have") > 1), "repeated")
    return left.join(right, "key", "full_outer").select("key", code.alias("code")).where("code is not null")


def reconcile(inventory: DataFrame, report: DataFrame, rules: Sequence[tuple[str, Column]], key: str = "source_path") -> DataFrame:
    """key and code of everything in which a report differs from the inventory (key, sha256, size): keys first, then the rules for each row that both have."""
    fold = F.lower(key)
    keys = keys_differ(inventory, report, fold)
    both = report.withColumn("_key", fold).join(inventory.select(fold.alias("_key"), F.col("sha256").alias("i_sha256"), F.col("size").alias("i_size")), "_key")
    rows = both.select(F.col("_key").alias("key"), F.explode(violations(rules)).alias("code"))
    return keys.unionByName(rows)


def source_rules() -> list[tuple[str, Column]]:
    return [("source_sha256", F.col("source_sha256") == F.col("i_sha256")), ("source_size", F.col("source_size") == F.col("i_size"))]


def pdf_rules(preset: str, dry_run: bool) -> list[tuple[str, Column]]:
    """What each row of a PDF report must keep, by its status."""
    status, out, saved = F.col("status"), F.col("output_size"), F.col("saved_bytes")
    same = (out == F.col("source_size")) & (F.col("output_sha256") == F.col("source_sha256"))
    text = F.col("classification").isin(*TEXT_CLASSES)
    gate = lambda low, share: text | ((saved >= low) & (saved / F.col("source_size") >= share))
    lossy_low = F.when(F.col("profile") == "photo", 64 << 10).otherwise(256 << 10)
    none = out.isNull() & (F.coalesce("output_sha256", F.lit("")) == "") & (saved == 0)
    protected = F.coalesce("preservation_reason", F.lit("")) != ""
    basis = F.when(F.col("profile").isin("standard", "compact"), F.col("permission_basis").isin("automatic_text_only", "automatic_scan_raster")).otherwise(F.col("permission_basis") == F.concat(F.lit("explicit_"), F.col("profile")))
    return [
        *source_rules(),
        ("preset", F.col("preset") == preset),
        ("policy", F.col("requested_policy") == F.col("profile")),
        ("dry_run", (status.isin(*DRY) & none) if dry_run else ~status.isin(*DRY)),
        ("no_output", F.lit(dry_run) | out.isNotNull() | ((status == "ERROR") & none)),
        ("copy", ~(status.isin(*COPIES) | ((status == "ERROR") & out.isNotNull())) | same),
        ("saved_bytes", out.isNull() | (saved == F.col("source_size") - out)),
        ("saved_percent", out.isNull() | sizes.is_close(F.col("saved_percent"), sizes.saved_ratio(F.col("source_size"), out), 1e-9, 1e-9)),
        ("lossless_gate", (status != "ADOPTED_LOSSLESS") | ((saved > 0) & gate(16 << 10, 0.02))),
        ("lossy_gate", (status != "ADOPTED_LOSSY") | ((saved > 0) & gate(lossy_low, 0.05))),
        ("basis", (status == "ERROR") | basis),
        ("protection", (status == "ERROR") | (protected == (F.col("classification") == "protected"))),
    ]


def image_rules(max_long: int, max_short: int, dry_run: bool, output_format: str = "jpeg", strip: bool = False) -> list[tuple[str, Column]]:
    action, out = F.col("action"), F.col("output_size")
    error = action == "ERROR"
    copies = action.isin("COPIED_ORIGINAL", "COPIED_ENCODE_FAILED", "SKIPPED_COPY")
    long, short = F.greatest("new_width", "new_height"), F.least("new_width", "new_height")
    dims = [F.col(c) for c in ("orig_width", "orig_height", "new_width", "new_height")]
    no_dims = F.coalesce(*dims).isNull()
    return [
        *source_rules(),
        ("format", (F.col("output_format") == output_format) & (F.col("strip_exif") == strip)),
        ("error", ~error | ((F.col("error") != "") & out.isNull() & no_dims)),
        ("dimensions", error | (F.least(*dims) > 0) & (long <= max_long) & (short <= max_short)),
        ("dry_run", error | (out.isNull() & action.startswith("DRY_RUN") if dry_run else out.isNotNull() & ~action.startswith("DRY_RUN"))),
        ("copy", ~copies | (F.lit(not strip and output_format == "jpeg") & (out == F.col("source_size")) & (F.col("output_sha256") == F.col("source_sha256")))),
    ]


def video_rules(dry_run: bool) -> list[tuple[str, Column]]:
    status, out, saved = F.col("status"), F.col("output_size"), F.col("saved_bytes")
    copy = (out == F.col("source_size")) & (F.col("output_sha256") == F.col("source_sha256")) & (F.coalesce("error_message", F.lit("")) == "")
    shape = (F.col("width") <= 1280) & (F.col("height") <= 720) & (F.col("width") % 2 == 0) & (F.col("height") % 2 == 0) & (F.col("vmaf_mean") >= 85) & (F.col("vmaf_p5") >= 70) & (saved > 0)
    return [
        *source_rules(),
        ("saved_bytes", saved == F.when(out.isNull(), 0).otherwise(F.col("source_size") - out)),
        ("saved_percent", out.isNull() | sizes.is_close(F.col("saved_percent"), sizes.saved_percent(F.col("source_size"), out), 1e-9, 1e-6)),
        ("dry_run", (status == "DRY_RUN") & out.isNull() if dry_run else status != "DRY_RUN"),
        ("no_output", F.lit(dry_run) | out.isNotNull() | ((status == "ERROR") & (F.coalesce("error_message", F.lit("")) != ""))),
        ("copy", ~status.isin("UNCHANGED", "SKIPPED_STANDARD", "SKIPPED_COMPLEX", "SKIPPED_UNSUPPORTED") | copy),
        ("adopted", (status != "ADOPTED") | shape),
        ("reused", (status != "SKIPPED_COMPLETE") | shape | copy),
    ]


def workbook_rules() -> list[tuple[str, Column]]:
    status, out, parts = F.col("status"), F.col("output_size"), F.col("changed_parts")
    return [
        *source_rules(),
        ("changed_count", F.col("images_changed") == F.size(parts)),
        ("changed_once", F.size(F.array_distinct(parts)) == F.size(parts)),
        ("no_output", ~status.isin("DRY_RUN", "DRY_RUN_PRESERVED", "ERROR") | (out.isNull() & (F.size(parts) == 0))),
        ("preserved", (status != "PRESERVED_ORIGINAL") | ((F.size(parts) == 0) & (out == F.col("source_size")) & (F.col("output_sha256") == F.col("source_sha256")))),
        ("adopted", (status != "ADOPTED_LOSSY") | ((F.size(parts) > 0) & (out > 0) & (out < F.col("source_size")))),
        ("diagnostics", diagnostics_valid(F.col("image_diagnostics"), parts, F.col("diagnostics_complete"), status)),
    ]


def diagnostics_valid(diagnostics: Column, changed: Column, complete: Column, status: Column) -> Column:
    """Parts once each, outcomes known, adopted ones among the changed; if complete and adopted, the same set."""
    parts = F.transform(diagnostics, lambda d: d["part"])
    adopted = F.transform(F.filter(diagnostics, lambda d: d["outcome"] == "adopted"), lambda d: d["part"])
    known = F.forall(diagnostics, lambda d: d["outcome"].isin("planned", "preserved", "adopted", "rejected"))
    same = (F.size(F.array_except(changed, adopted)) == 0) | ~complete | (status != "ADOPTED_LOSSY")
    return known & (F.size(F.array_distinct(parts)) == F.size(parts)) & (F.size(F.array_except(adopted, changed)) == 0) & same


def ordinal_differences(left: DataFrame, right: DataFrame, by: Sequence[str], order: Sequence[str], columns: dict[str, float | None]) -> DataFrame:
    """by, ordinal and code where two ordered lists differ: lengths, or a column beyond its tolerance (None: exactly)."""
    numbered = lambda df, p: df.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("ordinal"), *(F.col(c).alias(f"{p}_{c}") for c in columns), F.lit(True).alias(p))
    both = numbered(left, "l").join(numbered(right, "r"), [*by, "ordinal"], "full_outer")
    codes = [F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left")]
    for c, tolerance in columns.items():
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        near = a.eqNullSafe(b) if tolerance is None else (F.abs(a - b) <= tolerance)
        codes.append(F.when(F.col("l") & F.col("r") & ~F.coalesce(near, F.lit(False)), c))
    return both.select(*by, "ordinal", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def parts_diff(source: DataFrame, output: DataFrame, by: Sequence[str], part: str, digest: str) -> DataFrame:
    """by, part and change (added, removed, changed) between two sets of parts."""
    a = source.select(*by, part, F.col(digest).alias("_a"))
    b = output.select(*by, part, F.col(digest).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, [*by, part], "full_outer").select(*by, part, change.alias("change")).where("change is not null")


def undeclared(changes: DataFrame, declared: DataFrame, on: Sequence[str]) -> DataFrame:
    """Changes that weren't declared, and declared ones that didn't happen."""
    return changes.select(*on).join(declared, list(on), "left_anti").withColumn("code", F.lit("undeclared")).unionByName(declared.select(*on).join(changes, list(on), "left_anti").withColumn("code", F.lit("not_changed")))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, counted as often as they stand there."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.select(*a.columns).withColumn("_n", F.lit(-1)))
    left = both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return left.withColumn("side", F.explode(F.array_repeat(F.when(F.col("_n") > 0, "left").otherwise("right"), F.abs("_n").cast("int")))).drop("_n")
