"""Queries that go through files: reports written and read back, logs, containers, headers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tessera.functions import binary
from tessera.plans.inventory import files, load
from tessera.sources import packages, probes, sinks


def _folder(spark) -> str:
    """A folder that all executors share: the cluster's, or a temporary one on a local master where none is named."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/report-{uuid.uuid4().hex}"


def report_roundtrip(spark, sf_dir):
    """A report with line breaks and quotes in its fields, whole texts among them, written, read back and compared.

    The digest is of 200 characters, as the SQL has it; a text that doesn't come back whole has none.
    """
    rows = files(spark, sf_dir).select("path", F.col("doc_id").alias("id"), F.col("text").alias("error_message"), F.sha2("text", 256).alias("whole"), (F.col("doc_id") % 2 == 0).alias("flag"), F.array(F.struct(F.lit("k").alias("kind"), F.lit(None).cast("bigint").alias("size"))).alias("candidates"))
    path = sinks.publish_csv(rows, _folder(spark), "path")
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path).select(F.col("id").cast("bigint").alias("id"), "flag", "candidates", F.when(F.sha2("error_message", 256) == F.col("whole"), F.sha2(F.substring("error_message", 1, 200), 256)).alias("digest"))


def frame_log(spark, sf_dir):
    """Scores of frames in JSON logs, one log a user."""
    frame = F.struct(F.struct(F.when(F.col("event_id") % 17 == 0, "nan?").otherwise(F.col("value").cast("string")).alias("vmaf")).alias("metrics"))
    logs = load(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(frame).alias("frames"))).alias("payload"))
    return probes.frame_scores(logs).groupBy("user_id").agg(F.count("*").alias("frames"), F.round(F.avg("score"), 6).alias("mean"))


def summary_lines(spark, sf_dir):
    lines = files(spark, sf_dir).select(F.col("doc_id").alias("line_no"), F.when(F.col("doc_id") % 100 == 3, F.concat(F.lit("Resized "), F.col("doc_id").cast("string"), F.lit(" images (2 errors)"))).when(F.col("doc_id") % 100 == 5, F.concat(F.col("doc_id").cast("string"), F.lit(".5 KB ->  2 MB"))).otherwise(F.col("text")).alias("line"))
    return probes.summary_lines(lines)


def zip_parts_udtf(spark, sf_dir):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Type="http://x/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
    one = spark.createDataFrame([("a.xlsx", bytearray(buffer.getvalue())), ("b.xlsx", bytearray(b"no"))], "path string, content binary")
    return packages.parts(one).select("path", "part", "size", "error")


def png_header_udf(spark, sf_dir):
    import struct

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 80, 60) + b"\x08\x02\x00\x00\x00" + b"\x00" * 4
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\x03" + b"\x00" * 9
    rows = spark.createDataFrame([("png", bytearray(png)), ("jpeg", bytearray(jpeg)), ("broken", bytearray(png[:20]))], "name string, data binary")
    return rows.select("name", binary.image_dimensions("data").alias("d")).select("name", "d.*")


def document_run(spark, sf_dir):
    """A whole run over documents as files, with deflate as its codec, after an earlier run over a third of them."""
    from tessera.plans.pipeline import RunSpec, run

    docs = files(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content"), "doc_id")
    spec = RunSpec(preserve=("src1/*",), min_bytes=1000)
    empty = spark.createDataFrame([], "source_path string, source_sha256 string, config_hash string, output_sha256 string, status string")
    earlier = docs.where("doc_id % 3 = 0").select(F.col("path").alias("source_path"), F.sha2("content", 256).alias("source_sha256"), F.lit(spec.config_hash()).alias("config_hash"), F.lit("x").alias("output_sha256"), F.lit("UNCHANGED").alias("status"))
    out = run(docs.select("path", "content"), empty.unionByName(earlier), spec)
    return out.groupBy("profile", F.col("status").isin("PRESERVED_ORIGINAL", "SKIPPED_SMALL").alias("left_alone")).agg(F.count("*").alias("n"), F.sum("source_size").alias("bytes"))


def hourly_totals(spark, sf_dir):
    from tessera.streaming.inbox import windowed_totals

    out = windowed_totals(load(spark, sf_dir, "events"), "ts", ["event_type"], "event_id")
    return out.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (report_roundtrip, frame_log, summary_lines, zip_parts_udtf, png_header_udf, document_run, hourly_totals)}
SQL = {
    "report_roundtrip": """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, '[{"kind":"k","size":null}]' AS candidates, sha256(substring(text, 1, 200)) AS digest FROM documents""",
    "frame_log": "SELECT user_id, count(*) AS frames, round(avg(value), 6) AS mean FROM events WHERE event_id % 17 <> 0 GROUP BY 1",
    "summary_lines": """
SELECT max(doc_id) FILTER (doc_id % 100 = 3) AS count, 2::BIGINT AS errors, CAST(floor((max(doc_id) FILTER (doc_id % 100 = 5) + 0.5) * 1024) AS BIGINT) AS orig_size, 2097152::BIGINT AS new_size FROM documents""",
    "zip_parts_udtf": """
SELECT * FROM (VALUES ('a.xlsx', '[Content_Types].xml', 8::BIGINT, NULL::VARCHAR), ('a.xlsx', 'xl/workbook.xml', 11::BIGINT, NULL), ('a.xlsx', 'xl/_rels/workbook.xml.rels', 111::BIGINT, NULL), ('b.xlsx', NULL, NULL, 'File is not a zip file')) t(path, part, size, error)""",
    "document_run": """
WITH d AS (SELECT strlen(text) AS n, source = 'src1' AS keep, doc_id FROM documents WHERE doc_id % 3 <> 0)
SELECT CASE WHEN keep THEN 'preserve' ELSE 'standard' END AS profile, keep OR n < 1000 AS left_alone, count(*) AS n, CAST(sum(n) AS BIGINT) AS bytes FROM d GROUP BY 1, 2""",
    "hourly_totals": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1, 2",
    "png_header_udf": "SELECT * FROM (VALUES ('png', 'png', 80, 60), ('jpeg', 'jpeg', 40, 30), ('broken', NULL, NULL, NULL)) t(name, format, width, height)",
}
