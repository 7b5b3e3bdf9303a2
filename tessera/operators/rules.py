"""What may be done with a document, an image, a video or a workbook: ordered rules over facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import sizes
from tessera.operators.cascade import first_match

#: Reason words and their statuses, in the order in which they are looked for (fixed values).
SKIP_REASONS = (
    ("encrypted", "SKIPPED_ENCRYPTED"),
    ("signed", "SKIPPED_SIGNED"),
    ("form", "SKIPPED_COMPLEX"),
    ("attachments", "SKIPPED_COMPLEX"),
    ("repaired", "SKIPPED_COMPLEX"),
    ("no_pages", "SKIPPED_COMPLEX"),
    ("open_failed", "SKIPPED_COMPLEX"),
    ("page_load_failed", "SKIPPED_COMPLEX"),
    ("inspect_error", "SKIPPED_COMPLEX"),
)
#: Least savings in bytes and as a share, by mode and profile (fixed values).
LOSSY, LOSSLESS, PHOTO, IMAGE, VIDEO = (256 << 10, 0.05), (16 << 10, 0.02), (64 << 10, 0.05), (32 << 10, 0.10), (1 << 20, 0.10)
#: Profiles for which strictly smaller is enough (fixed values).
ANY_SAVING = ("text", "text_scan", "text_scan_bilevel", "font_replace", "raster_scan")
#: Suffix: container token, muxer, audio encoder, audio codec (fixed values).
CONTAINERS = {
    ".mp4": ("mp4", "mp4", "aac", "aac"),
    ".m4v": ("mp4", "mp4", "aac", "aac"),
    ".mov": ("mov", "mov", "libopus", "opus"),
    ".mkv": ("matroska", "matroska", "libopus", "opus"),
    ".webm": ("webm", "webm", "libopus", "opus"),
}
#: Signs of high dynamic range (fixed values).
HDR_TRANSFERS, HDR_PRIMARIES = ("smpte2084", "arib-std-b67"), ("bt2020",)
HDR_MARKS = ("dovi", "dolby vision", "mastering display metadata", "content light level metadata")


def skip_status(reason: Column, default: str = "SKIPPED_COMPLEX") -> Column:
    """Status of the first word of SKIP_REASONS that the reason holds."""
    return first_match([(F.contains(reason, F.lit(word)), status) for word, status in SKIP_REASONS], default)


def meets_reduction(before: Column, after: Column, lossy: Column, profile: Column | None = None) -> Column:
    """Whether a candidate saves enough for its mode and, if given, profile."""
    loose = F.lit(False) if profile is None else profile.isin(*ANY_SAVING)
    photo = F.lit(False) if profile is None else profile == "photo"
    least = F.when(loose, 0).when(lossy & photo, PHOTO[0]).when(lossy, LOSSY[0]).otherwise(LOSSLESS[0])
    share = F.when(loose, 0.0).when(lossy & photo, PHOTO[1]).when(lossy, LOSSY[1]).otherwise(LOSSLESS[1])
    return sizes.enough_saved(before, after, least, share)


def rewrites_image(mask: Column, bits: Column, colour: Column, jpeg: Column, bitonal: bool = False, gray: bool = True, color: bool = True, lossy: bool = True, lossless: bool = True) -> Column:
    """Whether an image may be written anew under the options."""
    is_gray = colour.isin("DeviceGray", "CalGray", "G")
    wanted = F.when(is_gray, F.lit(gray)).otherwise(F.lit(color)) & F.when(jpeg, F.lit(lossy)).otherwise(F.lit(lossless))
    return (F.coalesce(mask, F.lit(0)) == 0) & ~((bits == 1) & F.lit(not bitonal)) & wanted


def simple_rules(drawings: Column) -> Column:
    """Whether all drawings are plain table lines. drawings: array of struct(type, filled, layer, opacity, items array of struct(op, x0, y0, x1, y1))."""
    line = lambda i: (i["op"] == "re") | ((i["op"] == "l") & ((i["x0"] == i["x1"]) | (i["y0"] == i["y1"])))
    return F.forall(drawings, lambda d: (d["type"] == "s") & ~d["filled"] & (F.coalesce(d["layer"], F.lit("")) == "") & (F.coalesce(d["opacity"], F.lit(1.0)) == 1.0) & F.forall(d["items"], line))


def page_failure(profile: Column, scan: Column, annotated: Column, simple: Column, drawn: Column, image: Column, kinds: Column, allowed: Column) -> Column:
    """The first rule that a page breaks, or null."""
    return first_match(
        [
            (annotated, F.lit("annotations")),
            ((profile == "text") & ~simple, F.lit("non_table_drawing")),
            ((profile != "text") & drawn, F.lit("drawing")),
            (~scan & image, F.lit("unpermitted_image")),
            (F.size(F.array_except(kinds, allowed)) > 0, F.lit("non_text_paint")),
        ]
    )


def document_permission(docs: DataFrame, pages: DataFrame, page_limit: int = 100) -> DataFrame:
    """docs with classification, basis and reason.

    docs: doc, profile, safe, encrypted, repaired, signature_flags, has_form, has_attachments, has_layers, scan_problem.
    pages: doc, page, annotated, simple, drawn, image, has_text, kinds (array), raster (only image paint).
    Rules are tried in order; of page rules the first page that breaks one decides.
    """
    scans = ["text_scan", "text_scan_bilevel"]
    allowed = F.when(F.col("profile") == "text", F.array(*map(F.lit, ("text", "path")))).when(F.col("profile").isin(*scans), F.array(*map(F.lit, ("text", "image")))).otherwise(F.array(F.lit("text")))
    judged = pages.join(docs.select("doc", "profile"), "doc").withColumn(
        "failure", page_failure(F.col("profile"), F.col("profile").isin(*scans), F.col("annotated"), F.col("simple"), F.col("drawn"), F.col("image"), F.col("kinds"), allowed)
    )
    facts = judged.groupBy("doc").agg(
        F.count("*").alias("pages"), F.bool_or("image").alias("any_image"), F.bool_or("has_text").alias("any_text"), F.bool_and("raster").alias("all_raster"),
        F.min(F.when(F.col("failure").isNotNull(), F.struct("page", "failure")))["failure"].alias("page_reason"),
    )
    profile, is_scan = F.col("profile"), F.col("profile").isin(*scans)
    protect = lambda reason: F.struct(F.lit("protected").alias("classification"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    allow = lambda kind: F.struct(F.lit(kind).alias("classification"), F.lit("").alias("reason"))
    automatic = profile.isin("standard", "compact") & ~F.col("safe") & F.col("all_raster") & F.col("any_image")
    problem = F.coalesce(F.col("scan_problem"), F.lit("")) != ""
    decision = first_match(
        [
            (profile == "preserve", protect("explicit_preserve")),
            (F.col("encrypted"), protect("encrypted")),
            (F.col("repaired"), protect("repaired")),
            (F.coalesce(F.col("pages"), F.lit(0)) == 0, protect("no_pages")),
            (F.col("signature_flags") > 0, protect("signed")),
            (F.col("has_form") | F.col("has_attachments"), protect("form_or_attachments")),
            (profile == "photo", allow("photo")),
            (F.col("pages") > page_limit, protect("page_limit")),
            (F.col("has_layers"), protect("optional_content")),
            (automatic & problem, protect(F.col("scan_problem"))),
            (automatic, allow("raster_scan")),
            (is_scan & problem, protect(F.col("scan_problem"))),
            (F.col("page_reason").isNotNull(), protect(F.col("page_reason"))),
            (is_scan & ~F.col("any_image"), protect("no_scan_image")),
            (is_scan, allow("text_scan")),
            (~F.col("any_text"), protect("no_confirmed_text")),
            (profile == "text", allow("text_table")),
        ],
        allow("text"),
    )
    basis = first_match([(automatic & F.col("decision.classification").isin("raster_scan"), F.lit("automatic_scan_raster")), (profile.isin("standard", "compact"), F.lit("automatic_text_only"))], F.concat(F.lit("explicit_"), profile))
    out = docs.join(facts, "doc", "left").withColumn("decision", decision)
    return out.select(*docs.columns, F.col("decision.classification").alias("classification"), basis.alias("basis"), F.col("decision.reason").alias("reason"))


def scan_problem(images: DataFrame) -> DataFrame:
    """doc and problem ('' if none) over images: doc, xref, digest, placed, jpeg, mask. The same pixels under two numbers can't be told apart."""
    twice = F.count("*").over(Window.partitionBy("doc", "digest")) > 1
    rows = images.withColumn("twice", twice).groupBy("doc").agg(
        F.bool_or("mask").alias("mask"), F.bool_or(~F.col("placed")).alias("unplaced"), F.bool_or("twice").alias("twice")
    )
    return rows.select("doc", first_match([(F.col("mask"), "image_mask"), (F.col("twice"), "ambiguous_image"), (F.col("unplaced"), "unplaced_image")], "").alias("problem"))


def has_hdr(transfer: Column, primaries: Column, side_data: Column) -> Column:
    text = F.lower(F.to_json(side_data))
    return F.coalesce(F.lower(transfer).isin(*HDR_TRANSFERS), F.lit(False)) | F.coalesce(F.lower(primaries).isin(*HDR_PRIMARIES), F.lit(False)) | F.coalesce(reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in HDR_MARKS)), F.lit(False))


def display_rotation(tags: Column, side_data: Column) -> Column:
    """0, 90, 180 or 270 from tags (map) and side data (array of maps); 0 without any, null if they disagree or aren't right angles."""
    named = F.map_values(F.map_filter(tags, lambda k, _: F.lower(k) == "rotate"))
    raw = F.concat(F.coalesce(named, F.array().cast("array<string>")), F.coalesce(F.array_compact(F.transform(side_data, lambda m: F.try_element_at(m, F.lit("rotation")))), F.array().cast("array<string>")))
    values = F.transform(raw, lambda v: v.try_cast("double"))
    near = F.filter(values, lambda v: F.abs(v - F.rint(v)) < 0.01)
    turns = F.array_distinct(F.transform(near, lambda v: F.pmod(F.rint(v).cast("bigint"), F.lit(360))))
    one = F.get(turns, F.lit(0))
    return F.when(F.size(raw) == 0, F.lit(0).cast("bigint")).when(~F.exists(values, lambda v: v.isNull()) & (F.size(turns) == 1) & one.isin(0, 90, 180, 270), one)


def video_eligibility(media: DataFrame, safe: bool = False, remove_audio: bool = False) -> DataFrame:
    """media with status (null: eligible), reason, out_width, out_height and fps.

    media: path, format_name, chapter_count, streams array of struct(kind, codec, width, height, pix_fmt, bit_depth, field_order,
    aspect, r_rate struct(num, den), avg_rate, channels, attached_pic, transfer, primaries, tags map, side_data array of maps).
    """
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    token = F.try_element_at(F.create_map(*(F.lit(x) for k, v in CONTAINERS.items() for x in (k, v[0]))), suffix)
    # What many rules ask for is a column of its own: Catalyst doesn't inline a costly expression that is used more than once.
    picked = media.withColumns({
        "_token": token, "_video": F.filter("streams", lambda s: s["kind"] == "video"), "_audio": F.filter("streams", lambda s: s["kind"] == "audio"),
        "_others": F.array_sort(F.array_distinct(F.transform(F.filter("streams", lambda s: ~s["kind"].isin("video", "audio")), lambda s: s["kind"]))),
    })
    token, video, audio, others, turn = (F.col(f"_{n}") for n in ("token", "video", "audio", "others", "turn"))
    v, a = F.get(video, F.lit(0)), F.get(audio, F.lit(0))
    picked = picked.withColumns({"_turn": display_rotation(v["tags"], v["side_data"]), "_hdr": has_hdr(v["transfer"], v["primaries"], v["side_data"])})
    unknown = lambda c: F.coalesce(c, F.lit("")).isin("", "unknown", "0:1")
    order, aspect, keep = v["field_order"], v["aspect"], F.lit(not remove_audio)
    strict = F.lit(safe)
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    complex_, unsupported = "SKIPPED_COMPLEX", "SKIPPED_UNSUPPORTED"
    differ = sizes.fraction_less(v["r_rate"], v["avg_rate"]) | sizes.fraction_less(v["avg_rate"], v["r_rate"])
    verdict = first_match(
        [
            (token.isNull() | ~F.array_contains(F.split("format_name", ","), token), say(unsupported, "container")),
            (F.col("chapter_count") > 0, say(complex_, "chapters")),
            (F.size(others) > 0, say(complex_, F.concat(F.lit("streams: "), F.array_join(others, ", ")))),
            (F.size(video) != 1, say(complex_, "video streams")),
            (F.coalesce(v["attached_pic"], F.lit(False)), say(complex_, "attached picture")),
            (keep & (F.size(audio) > 1), say(complex_, "audio streams")),
            (keep & (F.size(audio) == 1) & ~F.coalesce(a["channels"].isin(1, 2), F.lit(False)), say(complex_, "audio channels")),
            (~F.coalesce(v["pix_fmt"].isin("yuv420p", "yuvj420p"), F.lit(False)), say(unsupported, "pixel format")),
            (~F.coalesce(v["bit_depth"], F.lit(0)).isin(0, 8), say(unsupported, "bit depth")),
            (F.col("_hdr"), say(complex_, "high dynamic range")),
            (~((order == "progressive") | (~strict & unknown(order))) | (order.isNull() & strict), say(complex_, "field order")),
            (~((aspect == "1:1") | (~strict & unknown(aspect))) | (aspect.isNull() & strict), say(complex_, "aspect ratio")),
            (v["width"].isNull() | v["height"].isNull() | (v["width"] < 2) | (v["height"] < 2), say(unsupported, "dimensions")),
            (v["r_rate"].isNull() | v["avg_rate"].isNull(), say(complex_, "frame rate")),
            (strict & differ, say(complex_, "variable frame rate")),
            (turn.isNull(), say(complex_, "rotation")),
        ]
    )
    swap = turn.isin(90, 270)
    shown = sizes.video_box(F.when(swap, v["height"]).otherwise(v["width"]), F.when(swap, v["width"]).otherwise(v["height"]))
    rate = v["avg_rate"] if safe else F.when(sizes.fraction_less(v["r_rate"], v["avg_rate"]), v["avg_rate"]).otherwise(v["r_rate"])
    thirty = F.struct(F.lit(30).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den"))
    out = picked.withColumns({"_v": verdict, "_shown": shown, "_fps": F.when(sizes.fraction_less(thirty, rate), thirty).otherwise(rate)})
    ok, shown, fps = F.col("_v").isNull(), F.col("_shown"), F.col("_fps")
    return out.select(*media.columns, F.col("_v.status").alias("status"), F.coalesce("_v.reason", F.lit("")).alias("reason"), F.when(ok, shown["w"]).alias("out_width"), F.when(ok, shown["h"]).alias("out_height"), F.when(ok, sizes.fraction_text(fps)).alias("fps"))


def generated_again(marked: Column, known_preset: Column, preset: str) -> Column:
    """Whether an image that carries a marker must be processed anew: one of an unknown recipe, or a standard one for compact."""
    return marked & (known_preset.isNull() | ((known_preset == "standard") & F.lit(preset == "compact")))


def image_action(dry_run: bool, preset: str = "standard") -> Column:
    """The action for an image, over facts: generated_skip, output_complete, output_is_copy, jpeg, copy_allowed, resized,
    oriented, reprocess, encode_failed, source_size, candidate_size."""
    saved = F.col("source_size") - F.col("candidate_size")
    changed = ~F.col("copy_allowed") | ~F.col("jpeg") | F.col("resized") | F.col("oriented") | (F.col("reprocess") & (saved > 0)) | ((saved >= IMAGE[0]) & (saved >= F.col("source_size") * IMAGE[1]))
    copy = F.col("jpeg") & F.lit(preset == "standard") & F.col("copy_allowed") & ~F.col("oriented") & ~F.col("reprocess") & F.lit(not dry_run)
    return first_match(
        [
            (F.col("generated_skip"), "DRY_RUN_SKIPPED_GENERATED" if dry_run else "SKIPPED_GENERATED"),
            (F.col("output_complete") & F.lit(not dry_run), "SKIPPED_COMPLETE"),
            (copy & F.col("output_is_copy"), "SKIPPED_COPY"),
            (F.lit(dry_run), "DRY_RUN"),
            (F.col("encode_failed") & F.col("jpeg") & F.col("copy_allowed"), "COPIED_ENCODE_FAILED"),
            (F.col("encode_failed"), "ERROR"),
            (changed, "CONVERTED"),
        ],
        "COPIED_ORIGINAL",
    )


def workbook_protection(parts: DataFrame) -> DataFrame:
    """doc and reason ('' if none) over the parts of workbooks: doc, part, type, formula_text."""
    name = F.lower("part")
    rows = parts.groupBy("doc").agg(
        F.bool_or(name.endswith("vbaproject.bin")).alias("macro"),
        F.bool_or(name.startswith("_xmlsignatures/")).alias("signed"),
        F.bool_or(F.col("formula_text").rlike(r"(?i)\b(?:DISPIMG|IMAGE)\s*\(")).alias("cell_image"),
        F.bool_or(F.col("type").endswith("sheet.main+xml")).alias("workbook"),
    )
    return rows.select("doc", first_match([(~F.coalesce("workbook", F.lit(False)), "not_a_workbook"), (F.col("macro"), "macros"), (F.col("signed"), "signed"), (F.col("cell_image"), "cell_image_formula")], "").alias("reason"))


def output_recipe(path: Column, sample_rate: Column) -> Column:
    """struct(muxer, encoder, codec, sample_rate) for a video's suffix, null for an unknown one; sample rates are at most 48 kHz."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    look = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for k, v in CONTAINERS.items() for x in (k, v[i]))), suffix)
    return F.when(look(1).isNotNull(), F.struct(look(1).alias("muxer"), look(2).alias("encoder"), look(3).alias("codec"), F.least(sample_rate, F.lit(48000)).alias("sample_rate")))
