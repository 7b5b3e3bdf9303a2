"""Probe and log texts as nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import sizes, text

_PROBE = """struct<streams:array<struct<index:int,codec_type:string,codec_name:string,width:string,height:string,pix_fmt:string,bits_per_raw_sample:string,
field_order:string,sample_aspect_ratio:string,r_frame_rate:string,avg_frame_rate:string,channels:string,color_transfer:string,color_primaries:string,
disposition:map<string,int>,tags:map<string,string>,side_data_list:array<map<string,string>>>>,format:struct<format_name:string,duration:string>,chapters:array<struct<id:string>>>"""


def known(c: Column) -> Column:
    """Null for what a probe writes where it knows nothing."""
    return F.when(~c.isin("", "N/A", "0/0"), c)


def media(probes: DataFrame, payload: str = "payload") -> DataFrame:
    """probes with format_name, duration, chapter_count, streams and error: a payload that isn't JSON, or without a positive duration, is one."""
    p = probes.withColumn("_p", F.from_json(payload, _PROBE))

    def stream(s: Column) -> Column:
        return F.struct(
            s["codec_type"].alias("kind"), s["codec_name"].alias("codec"), known(s["width"]).try_cast("int").alias("width"), known(s["height"]).try_cast("int").alias("height"), known(s["pix_fmt"]).alias("pix_fmt"),
            known(s["bits_per_raw_sample"]).try_cast("int").alias("bit_depth"), s["field_order"].alias("field_order"), known(s["sample_aspect_ratio"]).alias("aspect"), sizes.fraction(known(s["r_frame_rate"])).alias("r_rate"),
            sizes.fraction(known(s["avg_frame_rate"])).alias("avg_rate"), known(s["channels"]).try_cast("int").alias("channels"), (F.coalesce(F.try_element_at(s["disposition"], F.lit("attached_pic")), F.lit(0)) == 1).alias("attached_pic"),
            F.coalesce(s["color_transfer"], F.lit("")).alias("transfer"), F.coalesce(s["color_primaries"], F.lit("")).alias("primaries"), F.coalesce(s["tags"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("tags"),
            F.coalesce(s["side_data_list"], F.array().cast("array<map<string,string>>")).alias("side_data"),
        )

    duration = known(F.col("_p.format.duration")).try_cast("double")
    error = F.when(F.col("_p.streams").isNull(), "not a probe").when(duration.isNull() | F.isnan(duration) | (duration <= 0), "no duration")
    return p.select(*probes.columns, F.col("_p.format.format_name").alias("format_name"), duration.alias("duration"), F.coalesce(F.size("_p.chapters"), F.lit(0)).alias("chapter_count"), F.transform("_p.streams", stream).alias("streams"), error.alias("error"))


def frame_scores(logs: DataFrame, payload: str = "payload") -> DataFrame:
    """logs' other columns and score for each frame with a finite one; a log without any is an error."""
    parsed = logs.withColumn("_s", F.transform(F.from_json(payload, "struct<frames:array<struct<metrics:struct<vmaf:string>>>>")["frames"], lambda f: f["metrics"]["vmaf"].try_cast("double")))
    fine = F.filter("_s", lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))
    some = F.when(F.coalesce(F.size(fine), F.lit(0)) > 0, fine).otherwise(F.raise_error(F.lit("a log has no scores")).cast("array<double>"))
    return parsed.select(*(c for c in logs.columns if c != payload), F.explode(some).alias("score"))


def summary_lines(lines: DataFrame) -> DataFrame:
    """One row, count, errors, orig_size and new_size, from the last line of each kind; lines: line_no, line. Without a count line no row."""
    counts, moved = r"Resized\s+(\d+)\s+images\s+\((\d+)\s+errors\)", r"(?i)([\d.]+)\s*(B|KB|MB|GB|TB)\s*->\s+([\d.]+)\s*(B|KB|MB|GB|TB)"
    last = lambda pattern, g: F.max_by(F.regexp_extract("line", pattern, g), F.when(F.col("line").rlike(pattern), F.col("line_no")))
    got = lines.agg(*(last(counts, g).alias(n) for g, n in ((1, "c"), (2, "e"))), *(last(moved, g).alias(f"m{g}") for g in (1, 2, 3, 4)))
    return got.where("c is not null").select(F.col("c").cast("bigint").alias("count"), F.col("e").cast("bigint").alias("errors"), text.parse_size(F.col("m1"), F.col("m2")).alias("orig_size"), text.parse_size(F.col("m3"), F.col("m4")).alias("new_size"))
