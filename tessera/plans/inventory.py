"""Queries about files: documents play the inventory, their path is source/lang/doc_id.txt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import globs, text
from tessera.operators import collisions, summary
from tessera.sources import inventory as inv

_PATH = "concat(source, '/', lang, '/', CAST(doc_id AS VARCHAR), '.txt')"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, source, lang, text of documents as files."""
    return load(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "source", "lang", "text")


def inventory_fingerprint(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("sha256"))


def inventory_by_group(spark, sf_dir):
    return files(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).cast("bigint").alias("largest"))


def duplicate_content_groups(spark, sf_dir):
    return files(spark, sf_dir).groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def profile_by_glob(spark, sf_dir):
    lists = {"photo": ["*/fr/*"], "text": ["*/de/*", "src1?/es/*"], "text_scan": ["src[2-4]/en/*[02468].txt"]}
    lists = {k: globs.normalize_patterns(v) for k, v in lists.items()}
    return files(spark, sf_dir).select("doc_id", globs.profile(F.col("path"), ["src1/*"], lists, "standard").alias("profile"))


def profile_conflicts(spark, sf_dir):
    lists = {"photo": ["*/de/*"], "text": ["src1*/*"]}
    p = globs.profile(F.col("path"), [], lists, "compact", strict=False)
    return files(spark, sf_dir).groupBy(p.alias("profile")).agg(F.count("*").alias("n"))


def selected_inputs(spark, sf_dir):
    names = load(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id"))
    chosen = files(spark, sf_dir).join(names, "doc_id", "left_semi").select("path")
    return inv.select_named(files(spark, sf_dir).select("path", "doc_id"), chosen).select("doc_id", "path")


def excel_opt_in(spark, sf_dir):
    return inv.opted_in(files(spark, sf_dir).select("doc_id", "path"), ["src1*/*/*[05].txt", "src2/*"]).select("doc_id")


def union_inventory(spark, sf_dir):
    docs = files(spark, sf_dir).select(F.lit("document").alias("kind"), "path", F.octet_length("text").cast("bigint").alias("size"))
    pages = load(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("size"))
    items = load(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").cast("string").alias("path"), F.octet_length("text").cast("bigint").alias("size"))
    return docs.unionByName(pages).unionByName(items).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(F.lower("path")).alias("first_path"))


def output_ordinals(spark, sf_dir):
    """The number of a file among all, in names: ranks within a source plus the files of the sources before, so no window holds all rows."""
    rows = files(spark, sf_dir)
    own = F.row_number().over(Window.partitionBy("source").orderBy(F.lower("path"), "path"))
    before = rows.groupBy("source").agg(F.count("*").alias("n")).select("source", (F.sum("n").over(Window.orderBy(F.concat(F.lower("source"), F.lit("/")))) - F.col("n")).alias("before"))
    number = rows.withColumn("own", own).join(F.broadcast(before), "source")  # a row a source
    return number.select("doc_id", F.format_string("img-run-%04d", F.col("own") + F.col("before")).alias("name"))


def pilot_sample_largest(spark, sf_dir):
    return inv.pilot(files(spark, sf_dir).select("doc_id", "path", F.octet_length("text").cast("bigint").alias("size")), 40, random_half=False).select("doc_id", "size")


def pilot_sample(spark, sf_dir):
    return inv.pilot(files(spark, sf_dir).select("doc_id", "path", F.octet_length("text").cast("bigint").alias("size")), 40).select("doc_id", "path", "size")


def collision_naming(spark, sf_dir):
    plan = files(spark, sf_dir).select("doc_id", F.col("path").alias("relative"), F.concat(F.col("source"), F.lit("/"), F.lower(F.substring("text", 1, 2)), F.lit("_"), (F.col("doc_id") % 50).cast("string"), F.lit(".jpg")).alias("output"))
    return collisions.resolve(plan).select("doc_id", "hashed", "final")


def output_suffix(spark, sf_dir):
    p = F.concat("path", F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.lit(".JPG")).otherwise(F.lit(".png")))
    return files(spark, sf_dir).select("doc_id", text.output_name(p, ".jpg", (".jpg", ".jpeg")).alias("output"))


def marker_roundtrip(spark, sf_dir):
    made = files(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n"))
    line = text.marker("tessera:1", F.sha2(F.lit("recipe"), 256), F.col("n"), F.col("doc_id") * 1000003, F.col("sha"))
    full = made.withColumn("comment", F.concat(F.lit("user line\n"), line, F.lit("\nlast line")))
    back = text.parse_marker("tessera:1", F.col("comment"))
    return full.select("doc_id", back["size"].alias("size"), back["mtime_ns"].alias("mtime_ns"), back["sha256"].alias("sha256"), text.without_marker("tessera:1", F.col("comment")).alias("rest"))


def size_units(spark, sf_dir):
    n = F.octet_length("text").cast("bigint") * F.pow(F.lit(7), F.col("doc_id") % 14).cast("bigint")
    parts = F.split("human", " ")
    return files(spark, sf_dir).select("doc_id", text.human_size(n).alias("human")).select("doc_id", "human", text.parse_size(parts[0], parts[1]).alias("bytes"))


def whitespace_equal_text(spark, sf_dir):
    squashed = F.sha2(text.without_space(F.col("text")), 256)
    return files(spark, sf_dir).groupBy(squashed.alias("squashed")).agg(F.count("*").alias("n"), F.countDistinct(F.sha2("text", 256)).alias("texts")).where("n > 1")


def bounded_collect(spark, sf_dir):
    rows = files(spark, sf_dir).select("source", "doc_id", F.octet_length("text").cast("bigint").alias("size"))
    return summary.bounded_collect(rows, ["source"], ["doc_id"], "size", 20000).select("source", "doc_id", "running")


QUERIES = {f.__name__: f for f in (inventory_fingerprint, inventory_by_group, duplicate_content_groups, profile_by_glob, profile_conflicts, selected_inputs, excel_opt_in, union_inventory, output_ordinals, pilot_sample_largest, pilot_sample, collision_naming, output_suffix, marker_roundtrip, size_units, whitespace_equal_text, bounded_collect)}

SQL = {
    "inventory_fingerprint": f"SELECT {_PATH} AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents",
    "inventory_by_group": "SELECT source, lang, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(strlen(text)) AS BIGINT) AS largest FROM documents GROUP BY 1, 2",
    "duplicate_content_groups": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "profile_by_glob": f"""
WITH f AS (SELECT doc_id, {_PATH} AS p FROM documents),
h AS (SELECT doc_id, p, p GLOB '*/fr/*' AS photo, (p GLOB '*/de/*' OR p GLOB 'src1?/es/*') AS txt, p GLOB 'src[2-4]/en/*[02468].txt' AS scan FROM f)
SELECT doc_id, CASE WHEN p GLOB 'src1/*' THEN 'preserve' WHEN photo THEN 'photo' WHEN txt THEN 'text' WHEN scan THEN 'text_scan' ELSE 'standard' END AS profile FROM h""",
    "profile_conflicts": f"""
WITH f AS (SELECT {_PATH} AS p FROM documents), h AS (SELECT p GLOB '*/de/*' AS a, p GLOB 'src1*/*' AS b FROM f)
SELECT CASE WHEN a AND b THEN 'conflict' WHEN a THEN 'photo' WHEN b THEN 'text' ELSE 'compact' END AS profile, count(*) AS n FROM h GROUP BY 1""",
    "selected_inputs": f"SELECT doc_id, {_PATH} AS path FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "excel_opt_in": f"SELECT doc_id FROM documents WHERE {_PATH} GLOB 'src1*/*/*[05].txt' OR {_PATH} GLOB 'src2/*'",
    "union_inventory": f"""
WITH u AS (SELECT 'document' AS kind, {_PATH} AS path, strlen(text) AS size FROM documents
UNION ALL SELECT 'page', url, strlen(html) FROM pages UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), strlen(text) FROM benchmark)
SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(lower(path)) AS first_path FROM u GROUP BY 1""",
    "output_ordinals": f"SELECT doc_id, format('img-run-{{:04d}}', row_number() OVER (ORDER BY lower({_PATH}), {_PATH})) AS name FROM documents",
    "pilot_sample_largest": f"SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents ORDER BY strlen(text) DESC, {_PATH} LIMIT 20",
    "collision_naming": f"""
WITH RECURSIVE p AS (SELECT doc_id, {_PATH} AS relative, concat(source, '/', lower(substring(text, 1, 2)), '_', CAST(doc_id % 50 AS VARCHAR), '.jpg') AS output FROM documents),
c AS (SELECT *, count(*) OVER (PARTITION BY lower(output)) > 1 AS hashed FROM p)
SELECT doc_id, hashed, CASE WHEN hashed THEN concat(left(output, len(output) - 4), '~', left(sha256(relative), 8), '.jpg') ELSE output END AS final FROM c""",
    "output_suffix": f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_PATH} || '.jpg' WHEN 1 THEN {_PATH} || '.JPG' ELSE {_PATH} || '.png.jpg' END AS output FROM documents",
    "marker_roundtrip": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, doc_id * 1000003 AS mtime_ns, sha256(text) AS sha256, 'user line' || chr(10) || 'last line' AS rest FROM documents",
    "size_units": """
WITH b AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) * CAST(pow(7, doc_id % 14) AS BIGINT) AS n FROM documents),
h AS (SELECT doc_id, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS u, n FROM b),
s AS (SELECT doc_id, printf('%.2f', n / pow(1024, u)) AS v, u FROM h)
SELECT doc_id, v || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][u + 1] AS human, CAST(floor(CAST(v AS DOUBLE) * pow(1024, u)) AS BIGINT) AS bytes FROM s""",
    "whitespace_equal_text": r"SELECT sha256(regexp_replace(text, '[\s\x{a0}]+', '', 'g')) AS squashed, count(*) AS n, count(DISTINCT sha256(text)) AS texts FROM documents GROUP BY 1 HAVING count(*) > 1",
    "bounded_collect": "SELECT source, doc_id, running FROM (SELECT source, doc_id, CAST(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents) WHERE running <= 20000",
}
