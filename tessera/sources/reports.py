"""Reports as tables: CSV and JSON read as text, checked row by row, and accepted as a whole or not at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tessera.operators.cascade import violations

#: Columns of the PDF report and the image manifest, in order (fixed values).
PDF_COLUMNS = ("source_path", "source_size", "source_sha256", "output_path", "output_size", "output_sha256", "saved_bytes", "saved_percent", "preset", "mode", "status", "page_count", "images_changed", "scan_page_ratio", "error_message", "profile", "requested_policy", "decision_reason", "classification", "permission_basis", "preservation_reason", "candidate_size", "candidate_saved_bytes", "candidate_saved_percent", "candidate_details", "lossless_jpeg_requested", "photo_dpi", "processing_schema", "font_replacement_requested", "replacement_font", "replacement_font_sha256", "text_extraction_changed")
IMAGE_COLUMNS = ("source_path", "source_size", "source_sha256", "output_path", "output_size", "output_sha256", "action", "error", "preset", "recipe_hash", "output_format", "strip_exif", "orig_width", "orig_height", "new_width", "new_height")
VIDEO_COLUMNS = ("source_path", "source_size", "output_path", "output_size", "saved_bytes", "saved_percent", "status", "error_message", "preset", "source_sha256", "output_sha256", "reason", "video_codec", "audio_codec", "width", "height", "fps", "duration", "vmaf_mean", "vmaf_p5", "ffmpeg_version", "safe", "remove_audio")
EXCEL_COLUMNS = ("schema_version", "source_path", "relative_path", "output_path", "source_size", "output_size", "source_sha256", "output_sha256", "status", "dpi", "images_total", "images_changed", "changed_parts", "reason", "max_side", "jpeg_quality", "recipe_version", "analysis_complete", "diagnostics_complete", "image_diagnostics")
#: Words that the columns may hold (fixed values).
PDF_STATUSES = ("PRESERVED_ORIGINAL", "DRY_RUN_PRESERVED", "ADOPTED_LOSSLESS", "ADOPTED_LOSSY", "UNCHANGED", "SKIPPED_SMALL", "SKIPPED_ENCRYPTED", "SKIPPED_SIGNED", "SKIPPED_COMPLEX", "DRY_RUN_LOSSLESS", "DRY_RUN_LOSSY", "ERROR")
PDF_PROFILES = ("standard", "compact", "photo", "preserve", "text", "text_scan", "text_scan_bilevel", "font_replace")
IMAGE_ACTIONS = ("CONVERTED", "SKIPPED_GENERATED", "SKIPPED_COMPLETE", "SKIPPED_COPY", "COPIED_ORIGINAL", "COPIED_ENCODE_FAILED", "DRY_RUN", "DRY_RUN_SKIPPED_GENERATED", "ERROR")
VIDEO_STATUSES = ("ADOPTED", "UNCHANGED", "SKIPPED_STANDARD", "SKIPPED_COMPLEX", "SKIPPED_UNSUPPORTED", "SKIPPED_COMPLETE", "DRY_RUN", "ERROR")
EXCEL_STATUSES = ("ADOPTED_LOSSY", "PRESERVED_ORIGINAL", "ERROR", "DRY_RUN", "DRY_RUN_PRESERVED")
#: Fonts that may replace others, video containers with their audio codec, and the box, rate and scores of an adopted video (fixed values).
FONTS = ("Yu Gothic Regular", "Meiryo Regular")
AUDIO = {".mp4": "aac", ".m4v": "aac", ".mkv": "opus", ".webm": "opus"}
MAX_WIDTH, MAX_HEIGHT, MAX_FPS, MIN_MEAN, MIN_P5 = 1280, 720, 30.0, 85.0, 70.0
#: Structure of the nested columns.
CANDIDATES = "array<struct<kind:string,size:bigint,images_changed:bigint,reason:string,validation_reason:string,selected:boolean,text_extraction_changed:boolean>>"
DIAGNOSTICS = "array<struct<part:string,format:string,size:array<int>,placements:int,required_pixels:array<int>,geometry_basis:string,reasons:array<string>,outcome:string>>"

#: A bound on a window over a whole report: reports hold a row a file, and a duplicate key makes all of it void.
_DEPTH = 8


def read_csv(spark: SparkSession, path: str, required: Sequence[str], optional: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """All columns as text. Fields may hold line breaks and doubled quotes. A row with too few or too many fields has them in _corrupt;
    a report that lacks a column, or has an unknown one (if exact), is one such row."""
    header = spark.read.option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path, header=True)
    names = header.columns
    missing, extra = set(required) - set(names), set(names) - set(required) - set(optional)
    if missing or (exact and extra):
        every = [*required, *optional]
        return spark.range(1).select(*(F.lit(None).cast("string").alias(c) for c in every), F.lit(f"missing {sorted(missing)}, unknown {sorted(extra)}").alias("_corrupt"))
    schema = StructType([StructField(n, StringType()) for n in [*names, "_corrupt"]])
    rows = spark.read.option("multiLine", "true").option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(schema).csv(path, header=True)
    return rows.select(*names, "_corrupt", *(F.lit(None).cast("string").alias(c) for c in optional if c not in names))


def whole(count: str, low: int = 0, required: bool = True) -> Column:
    """Whether a text is a whole number from low on; empty is fine unless required."""
    value = F.col(count).try_cast("bigint")
    ok = F.coalesce(value >= low, F.lit(False))
    return ok if required else F.coalesce(F.col(count), F.lit("")).isin("") | ok


def real(column: str, low: float, high: float, open_low: bool = False, required: bool = False) -> Column:
    value = F.col(column).try_cast("double")
    inside = ((value > low) if open_low else (value >= low)) & (value <= high) & ~F.isnan(value)
    ok = F.coalesce(inside, F.lit(False))
    return ok if required else F.coalesce(F.col(column), F.lit("")).isin("") | ok


def digest(column: str, required: bool = True) -> Column:
    ok = F.coalesce(F.lower(column).rlike(r"^[0-9a-f]{64}\z"), F.lit(False))
    return ok if required else F.coalesce(F.col(column), F.lit("")).isin("") | ok


def flag(column: str) -> Column:
    return F.coalesce(F.col(column).isin("true", "false"), F.lit(False))


def some(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def one_of(column: str, words: Sequence[str]) -> Column:
    return F.coalesce(F.col(column).isin(*words), F.lit(False))


def accepted(rows: DataFrame, checks: Sequence[tuple[str, Column]], key: str | None = None) -> DataFrame:
    """rows if every row is whole, passes every check and no key occurs twice; else none of them."""
    if "_corrupt" in rows.columns:
        checks = [*checks, ("fields", F.col("_corrupt").isNull())]
    bad = violations(checks)
    found = rows.agg(F.coalesce(F.max(F.size(bad)), F.lit(0)).alias("_bad"))
    if key:
        twice = rows.groupBy(F.lower(key).alias("_key")).agg(F.count("*").alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_most"))
        found = found.crossJoin(twice)  # both are one row
    else:
        found = found.withColumn("_most", F.lit(1))
    return rows.crossJoin(F.broadcast(found)).where("_bad = 0 and _most <= 1").drop("_bad", "_most", "_corrupt")  # found is one row


def font_consistent() -> Column:
    """Fonts are named, with a digest, only where the profile asks for them; only an adopted one of those may change the text's extraction."""
    asked, changed = F.col("profile") == "font_replace", F.col("text_extraction_changed") == "true"
    named = F.when(asked, one_of("replacement_font", FONTS) & F.coalesce(F.col("replacement_font_sha256").rlike(r"^[0-9a-f]{64}\z"), F.lit(False))).otherwise(~some("replacement_font") & ~some("replacement_font_sha256"))
    return (F.col("font_replacement_requested") == asked.cast("string")) & (~changed | (asked & (F.col("status") == "ADOPTED_LOSSY"))) & named


def adopted_video() -> Column:
    """Whether a row of text fields has all that an adopted video must have: shape, rate, scores, codecs and the encoder's version."""
    n = lambda c: F.col(c).try_cast("double")
    codec = F.try_element_at(F.create_map(*(F.lit(x) for pair in AUDIO.items() for x in pair)), F.lower(F.regexp_extract("output_path", r"(\.[^./\\]+)$", 1)))
    even = (n("width") % 2 == 0) & (n("height") % 2 == 0) & (n("width") <= MAX_WIDTH) & (n("height") <= MAX_HEIGHT)
    sound = F.coalesce(F.lower("audio_codec"), F.lit("")).isin("") | (F.lower("audio_codec") == codec)
    whole_row = even & (n("fps") <= MAX_FPS) & n("duration").isNotNull() & (n("vmaf_mean") >= MIN_MEAN) & (n("vmaf_p5") >= MIN_P5) & (F.lower("video_codec") == "av1") & codec.isNotNull() & sound & (F.trim("ffmpeg_version") != "")
    return F.coalesce(whole_row, F.lit(False))


def pdf_checks() -> list[tuple[str, Column]]:
    return [
        ("source_path", some("source_path")), ("output_path", some("output_path")), ("source_size", whole("source_size")), ("output_size", whole("output_size", 0, False)), ("saved_bytes", whole("saved_bytes", 0, False)),
        ("saved_percent", real("saved_percent", 0, float("inf"))), ("status", one_of("status", PDF_STATUSES)), ("preset", one_of("preset", ("standard", "compact"))), ("profile", one_of("profile", PDF_PROFILES)),
        ("policy", (F.col("processing_schema") == "6") & (F.col("requested_policy") == F.col("profile"))), ("flags", flag("lossless_jpeg_requested") & flag("font_replacement_requested") & flag("text_extraction_changed")),
        ("photo_dpi", F.when(F.col("profile") == "photo", whole("photo_dpi", 150) & (F.col("photo_dpi").try_cast("int") <= 300)).otherwise(~some("photo_dpi"))), ("source_sha256", digest("source_sha256")), ("output_sha256", digest("output_sha256", False)),
        ("font", font_consistent()),
    ]


def _typed(rows: DataFrame, bigints: Sequence[str] = (), doubles: Sequence[str] = (), booleans: Sequence[str] = (), lower: Sequence[str] = (), json: dict[str, str] | None = None) -> DataFrame:
    def column(name: str) -> Column:
        value = F.nullif(name, F.lit(""))
        if name in bigints:
            return value.try_cast("bigint").alias(name)
        if name in doubles:
            return value.try_cast("double").alias(name)
        if name in booleans:
            return (F.col(name) == "true").alias(name)
        if json and name in json:
            return F.from_json(name, json[name]).alias(name)
        return (F.lower(F.coalesce(name, F.lit(""))) if name in lower else F.coalesce(name, F.lit(""))).alias(name)

    return rows.select(*map(column, rows.columns))


def pdf_report(spark: SparkSession, path: str) -> DataFrame:
    rows = accepted(read_csv(spark, path, PDF_COLUMNS), pdf_checks())
    return _typed(rows, ("source_size", "output_size", "saved_bytes", "page_count", "images_changed", "candidate_size", "candidate_saved_bytes", "photo_dpi"), ("saved_percent", "scan_page_ratio", "candidate_saved_percent"), ("lossless_jpeg_requested", "font_replacement_requested", "text_extraction_changed"), ("source_sha256", "output_sha256"), {"candidate_details": CANDIDATES})


def image_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Older manifests lack output_format and strip_exif: jpeg and false."""
    raw = read_csv(spark, path, [c for c in IMAGE_COLUMNS if c not in ("output_format", "strip_exif")], ("output_format", "strip_exif"))
    raw = raw.withColumn("output_format", F.coalesce("output_format", F.lit("jpeg"))).withColumn("strip_exif", F.coalesce("strip_exif", F.lit("false")))
    checks = [
        ("paths", some("source_path") & some("output_path")), ("source_size", whole("source_size")), ("output_size", whole("output_size", 1, False)), ("policy", one_of("output_format", ("jpeg", "png", "webp")) & flag("strip_exif")),
        ("digests", digest("source_sha256") & digest("output_sha256", False) & digest("recipe_hash")), ("preset", one_of("preset", ("standard", "compact"))), ("action", one_of("action", IMAGE_ACTIONS)),
        *((c, whole(c, 1, False)) for c in ("orig_width", "orig_height", "new_width", "new_height")),
    ]
    rows = accepted(raw, checks).select(*IMAGE_COLUMNS)
    return _typed(rows, ("source_size", "output_size", "orig_width", "orig_height", "new_width", "new_height"), (), ("strip_exif",), ("source_sha256", "output_sha256", "recipe_hash"))


def video_report(spark: SparkSession, path: str) -> DataFrame:
    checks = [
        ("paths", some("source_path") & some("output_path")), ("reason", some("reason")), ("sizes", whole("source_size") & whole("output_size", 0, False) & whole("saved_bytes")), ("saved_percent", real("saved_percent", 0, 100, required=True)),
        ("status", one_of("status", VIDEO_STATUSES)), ("preset", one_of("preset", ("standard", "compact"))), ("digests", digest("source_sha256") & digest("output_sha256", False)), ("flags", flag("safe") & flag("remove_audio")),
        ("dimensions", whole("width", 1, False) & whole("height", 1, False)), ("times", real("fps", 0, 1e9, True) & real("duration", 0, 1e12, True)), ("scores", real("vmaf_mean", 0, 100) & real("vmaf_p5", 0, 100)),
        ("adopted", (F.col("status") != "ADOPTED") | adopted_video()),
    ]
    rows = accepted(read_csv(spark, path, VIDEO_COLUMNS), checks)
    return _typed(rows, ("source_size", "output_size", "saved_bytes", "width", "height"), ("saved_percent", "fps", "duration", "vmaf_mean", "vmaf_p5"), ("safe", "remove_audio"), ("source_sha256", "output_sha256"))


@F.udf(BooleanType(), useArrow=True)
def strict_json(text: str) -> bool:
    """Whether a text is JSON without repeated keys and not nested deeper than eight levels; Spark's parser keeps the last of two keys."""
    import json

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError
        return dict(pairs)

    def depth(x) -> int:
        inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else None
        return 0 if inner is None else 1 + max(map(depth, inner), default=0)

    try:
        return depth(json.loads(text, object_pairs_hook=once)) <= _DEPTH
    except (ValueError, TypeError, RecursionError):
        return False


def excel_report(spark: SparkSession, path: str) -> DataFrame:
    natural = lambda c, required=True: F.coalesce(F.col(c).rlike(r"^(0|[1-9][0-9]*)\z"), F.lit(False)) | (F.lit(not required) & ~some(c))
    checks = [
        ("schema", F.col("schema_version") == "3"), ("paths", some("source_path") & some("relative_path") & some("output_path")), ("sizes", natural("source_size") & natural("output_size", False)), ("digests", digest("source_sha256") & digest("output_sha256", False)),
        ("status", one_of("status", EXCEL_STATUSES)), ("counts", natural("images_total", False) & natural("images_changed")), ("recipe", natural("dpi", False) & natural("max_side", False) & natural("jpeg_quality") & F.col("jpeg_quality").try_cast("int").between(40, 95)),
        ("flags", flag("analysis_complete") & flag("diagnostics_complete")), ("json", strict_json(F.col("changed_parts")) & strict_json(F.col("image_diagnostics"))),
    ]
    rows = accepted(read_csv(spark, path, EXCEL_COLUMNS, exact=True), checks)
    return _typed(rows, ("source_size", "output_size", "dpi", "images_total", "images_changed", "max_side", "jpeg_quality"), (), ("analysis_complete", "diagnostics_complete"), ("source_sha256", "output_sha256"), {"changed_parts": "array<string>", "image_diagnostics": DIAGNOSTICS})


def previous_manifest(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """Successful rows of an earlier run's JSON manifest if its head is the expected one; a key that occurs twice voids all."""
    schema = "schema_version string, recipe_hash string, input_root string, output_root string, results array<struct<source:string,source_size:bigint,source_sha256:string,output:string,output_size:bigint,output_sha256:string,action:string>>"
    head = spark.read.schema(schema).option("multiLine", "true").json(path)
    for name, value in expected.items():
        head = head.where(F.col(name) == value)
    rows = head.select(F.explode("results").alias("r")).select("r.*")
    most = rows.groupBy(F.lower("source")).agg(F.count("*").alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_most"))
    return rows.crossJoin(F.broadcast(most)).where("_most <= 1 and action in ('CONVERTED', 'SKIPPED_COMPLETE')").drop("_most")  # most is one row


def preview_manifest(spark: SparkSession, path: str, report: DataFrame) -> DataFrame:
    """Items of a preview manifest that don't stand one to one with the report's rows: source_path and code."""
    items = spark.read.schema("items array<struct<source_path:string,source_sha256:string,status:string>>").option("multiLine", "true").json(path).select(F.explode("items").alias("i")).select("i.*")
    both = items.alias("i").join(report.alias("r"), "source_path", "full_outer")
    code = F.when(F.col("r.status").isNull(), "unexpected").when(F.col("i.status").isNull(), "missing").when((F.col("i.source_sha256") != F.col("r.source_sha256")) | (F.col("i.status") != F.col("r.status")), "differs")
    return both.select("source_path", code.alias("code")).where("code is not null")
