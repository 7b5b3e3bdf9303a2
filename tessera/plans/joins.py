"""Queries that hold one set of rows against another."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sizes
from tessera.operators import collisions, reconcile
from tessera.plans.inventory import files, load
from tessera.plans.rules import cents


def reconcile_1to1(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").cast("string").alias("k"))
    return reconcile.keys_differ(docs, load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("k")), F.col("k"))


def report_violations(spark, sf_dir):
    """Documents' report with some rows tampered, held against the inventory."""
    have = files(spark, sf_dir).select(F.col("path").alias("source_path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"), "doc_id")
    d = F.col("doc_id")
    status = F.when(d % 3 == 0, "ADOPTED_LOSSY").when(d % 3 == 1, "PRESERVED_ORIGINAL").otherwise("UNCHANGED")
    out = F.when(d % 3 == 0, F.call_function("div", F.col("size"), F.lit(2))).otherwise(F.col("size") - (d % 31 == 1).cast("int"))
    report = have.where("doc_id % 50 <> 7").select(
        F.when(d % 2 == 0, F.upper("source_path")).otherwise(F.col("source_path")).alias("source_path"), F.col("size").alias("source_size"), F.when(d % 41 == 0, "0").otherwise(F.col("sha256")).alias("source_sha256"), status.alias("status"), F.lit("compact").alias("preset"),
        F.lit("compact").alias("profile"), F.lit("compact").alias("requested_policy"), F.lit("raster_scan").alias("classification"), F.when(d % 37 == 0, "guess").otherwise("automatic_scan_raster").alias("permission_basis"), F.when(d % 29 == 0, "x").otherwise("").alias("preservation_reason"),
        out.alias("output_size"), F.when(d % 3 == 0, "f").otherwise(F.col("sha256")).alias("output_sha256"), (F.col("size") - out).alias("saved_bytes"), F.when(F.col("size") > 0, (F.col("size") - out) / F.col("size")).alias("saved_percent"),
    )
    return reconcile.reconcile(have, report, reconcile.pdf_rules("compact", False)).groupBy("code").agg(F.count("*").alias("n"))


def _sources(spark, sf_dir):
    return files(spark, sf_dir).select(F.col("path").alias("source_path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"), "doc_id")


def _codes(have, rows, rules):
    report = rows.withColumnsRenamed({"size": "source_size", "sha256": "source_sha256"}).drop("doc_id")
    return reconcile.reconcile(have, report, rules).groupBy("code").agg(F.count("*").alias("n"))


def image_manifest_violations(spark, sf_dir):
    """An image manifest with some rows tampered, held against the inventory."""
    have, d = _sources(spark, sf_dir), F.col("doc_id")
    error, copy = d % 3 == 2, d % 3 == 1
    rows = have.where("doc_id % 50 <> 7").select(
        "*", F.when(error, "ERROR").when(copy, "COPIED_ORIGINAL").otherwise("CONVERTED").alias("action"), F.when(error & (d % 26 != 2), "unreadable").otherwise("").alias("error"),
        F.when(copy, F.col("size") - (d % 31 == 1).cast("int")).when(~error, F.call_function("div", F.col("size"), F.lit(2))).alias("output_size"), F.when(copy, F.col("sha256")).when(~error, "f").alias("output_sha256"),
        F.when(d % 47 == 0, "png").otherwise("jpeg").alias("output_format"), F.lit(False).alias("strip_exif"), *(F.when(~error, F.lit(4000)).alias(c) for c in ("orig_width", "orig_height", "new_height")), F.when(~error, 50 + (d % 43 == 0).cast("int") * 9000).alias("new_width"),
    )
    return _codes(have, rows, reconcile.image_rules(4000, 4000, False))


def video_report_violations(spark, sf_dir):
    """A video report with some rows tampered, held against the inventory."""
    have, d, size = _sources(spark, sf_dir), F.col("doc_id"), F.col("size")
    kind = d % 4
    rows = have.where("doc_id % 50 <> 7").withColumn("output_size", F.when(kind == 0, F.call_function("div", size, F.lit(2))).when(kind == 1, size - (d % 31 == 1).cast("int")).when(kind == 2, size)).select(
        "*", F.when(kind == 0, "ADOPTED").when(kind == 1, "UNCHANGED").when(kind == 2, "SKIPPED_COMPLETE").otherwise("ERROR").alias("status"), F.when(kind == 0, "f").when(kind < 3, F.col("sha256")).alias("output_sha256"),
        (F.coalesce(size - F.col("output_size"), F.lit(0)) + (d % 41 == 0).cast("int")).alias("saved_bytes"), sizes.saved_percent(size, F.col("output_size")).alias("saved_percent"), F.when((kind == 3) & (d % 27 != 3), "broken").otherwise("").alias("error_message"),
        (640 + (d % 37 == 0).cast("int")).alias("width"), F.lit(360).alias("height"), (90.0 - (d % 29 == 0).cast("int") * 10).alias("vmaf_mean"), F.lit(75.0).alias("vmaf_p5"),
    )
    return _codes(have, rows, reconcile.video_rules(False))


def workbook_report_violations(spark, sf_dir):
    """A workbook report with some rows tampered, held against the inventory."""
    have, d, size = _sources(spark, sf_dir), F.col("doc_id"), F.col("size")
    adopted, error = d % 4 == 0, d % 4 == 2
    parts = lambda *names: F.array(*map(F.lit, names))
    told = F.array(*(F.struct(F.lit(p).alias("part"), F.lit("adopted").alias("outcome")) for p in ("p1", "p2")))
    rows = have.where("doc_id % 50 <> 7").withColumn("changed_parts", F.when(adopted & (d % 23 == 0), parts("p1", "p1")).when(adopted, parts("p1", "p2")).otherwise(F.array().cast("array<string>"))).select(
        "*", F.when(adopted, "ADOPTED_LOSSY").when(error, "ERROR").otherwise("PRESERVED_ORIGINAL").alias("status"), (F.size("changed_parts") + (d % 43 == 0).cast("int")).alias("images_changed"),
        F.when(adopted, F.when(d % 29 == 0, size).otherwise(F.call_function("div", size, F.lit(2)))).when(error, F.when(d % 53 == 2, 5)).otherwise(size - (d % 31 == 1).cast("int")).alias("output_size"), F.when(adopted, "f").when(~error, F.col("sha256")).alias("output_sha256"),
        F.when(adopted, told).otherwise(F.slice(told, 1, 0)).alias("image_diagnostics"), F.lit(True).alias("diagnostics_complete"),
    )
    return _codes(have, rows, reconcile.workbook_rules())


def reconcile_ordinal(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("double").alias("n"))
    other = turns.where("not (conv_id % 3 = 0 and turn = 1)").withColumn("n", F.when(F.col("turn") % 4 == 2, F.col("n") + 0.02).otherwise(F.col("n") + 0.005))
    return reconcile.ordinal_differences(turns, other, ["conv_id"], ["turn"], {"role": None, "n": 0.01}).withColumn("ordinal", F.col("ordinal").cast("bigint"))


def prefix_collisions(spark, sf_dir):
    paths = load(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://[^/]*/*", "").alias("path")).where("path <> ''")
    return collisions.prefix_collisions(paths).select("page_id", "path")


def same_path_collisions(spark, sf_dir):
    return collisions.same_paths(load(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^[a-z]+://[^/]*", "").alias("path")))


def identity_collisions(spark, sf_dir):
    names = files(spark, sf_dir).select((F.col("doc_id") % 3).alias("device"), F.length("text").cast("bigint").alias("inode"), "path")
    return collisions.identity_collisions(names).select("device", "inode", "n", F.array_join("paths", "|").alias("paths"))


def unexplained_edges(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    edges = pages.select(F.col("url").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("target")).distinct()
    explained = edges.where(F.length("target") % 2 == 0)
    return collisions.unexplained(edges.select(F.col("target").alias("node")).distinct(), edges, explained)


def parts_diff(spark, sf_dir):
    old = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", cents("o_totalprice").alias("d"))
    new = old.where("o_orderkey % 7 <> 0").withColumn("d", F.col("d") + (F.col("o_orderkey") % 5 == 0).cast("int"))
    return reconcile.parts_diff(old, new.unionByName(old.where("o_orderkey % 11 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1)), ["o_custkey"], "o_orderkey", "d")


def undeclared_parts(spark, sf_dir):
    changes = load(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select("o_orderkey")
    declared = load(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select("o_orderkey")
    return reconcile.undeclared(changes, declared, ["o_orderkey"])


def same_rows(spark, sf_dir):
    a = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber")
    return reconcile.same_rows(a.where("l_linenumber < 4"), a.where("l_linenumber > 1")).groupBy("side", "l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))


def reference_overlap(spark, sf_dir):
    """Documents that hold a protected text: an equi-join on the hash of five of its words finds candidates, contains() decides. The words 2 to 6 stand whole in a document only if a space follows them in the item; items of fewer than seven words are held against every document."""
    run = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(5)))  # noqa: E731 (words are a column: a split inside the lambda would cut the text anew for each run)
    cut = lambda t: load(spark, sf_dir, t).withColumn("words", F.split("text", " "))
    items = cut("benchmark").select("item_id", F.col("text").alias("item"), F.size("words").alias("n"), run(F.lit(1)).alias("anchor"))
    runs = F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(0), F.size("words") - 5), run))
    docs = load(spark, sf_dir, "documents")
    near = cut("documents").select("doc_id", F.explode(F.array_distinct(runs)).alias("anchor")).join(items.where("n >= 7"), "anchor").select("doc_id", "item_id", "item").distinct()  # texts don't go through the explosion
    long = near.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    short = docs.select("doc_id", "text").join(items.where("n < 7").select("item_id", "item"), F.contains("text", F.col("item"))).select("doc_id", "item_id")
    return long.unionByName(short).distinct()


def reference_digest(spark, sf_dir):
    refs = load(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256"))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    hit = docs.join(refs, "sha256", "left_semi").select("doc_id", F.lit(True).alias("known"))
    return hit.unionByName(docs.join(refs, "sha256", "left_anti").select("doc_id", F.lit(False).alias("known")))


def ambiguous_images(spark, sf_dir):
    from tessera.operators import rules

    d = F.col("doc_id")
    images = load(spark, sf_dir, "documents").select(F.col("source").alias("doc"), d.alias("xref"), F.concat("lang", F.length("text").cast("string")).alias("digest"), (d % 97 > 0).alias("placed"), F.lit(True).alias("jpeg"), (d % 211 == 0).alias("mask"))
    return rules.scan_problem(images)


QUERIES = {f.__name__: f for f in (reconcile_1to1, report_violations, image_manifest_violations, video_report_violations, workbook_report_violations, reconcile_ordinal, prefix_collisions, same_path_collisions, identity_collisions, unexplained_edges, parts_diff, undeclared_parts, same_rows, reference_overlap, reference_digest, ambiguous_images)}

_PATH = "concat(source, '/', lang, '/', CAST(doc_id AS VARCHAR), '.txt')"
SQL = {
    "reconcile_1to1": """
SELECT CAST(coalesce(d.doc_id, l.doc_id) AS VARCHAR) AS key, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS code
FROM (SELECT doc_id FROM documents WHERE lang = 'de') d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
    "report_violations": """
WITH d AS (SELECT doc_id AS d, strlen(text) AS size FROM documents), r AS (SELECT *, CASE WHEN d % 3 = 0 THEN size // 2 ELSE size - CASE WHEN d % 31 = 1 THEN 1 ELSE 0 END END AS out FROM d WHERE d % 50 <> 7),
c AS (SELECT unnest([CASE WHEN d % 41 = 0 THEN 'source_sha256' END, CASE WHEN d % 3 <> 0 AND (d % 41 = 0 OR out <> size) THEN 'copy' END, CASE WHEN d % 3 = 0 AND NOT size - out > 0 THEN 'lossy_gate' END,
 CASE WHEN d % 37 = 0 THEN 'basis' END, CASE WHEN d % 29 = 0 THEN 'protection' END]) AS code FROM r UNION ALL SELECT 'missing' FROM d WHERE d % 50 = 7)
SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1""",
    "image_manifest_violations": """
WITH c AS (SELECT unnest([CASE WHEN d % 47 = 0 THEN 'format' END, CASE WHEN d % 3 = 2 AND d % 26 = 2 THEN 'error' END, CASE WHEN d % 3 <> 2 AND d % 43 = 0 THEN 'dimensions' END, CASE WHEN d % 3 = 1 AND d % 31 = 1 THEN 'copy' END]) AS code
 FROM (SELECT doc_id AS d FROM documents) WHERE d % 50 <> 7 UNION ALL SELECT 'missing' FROM documents WHERE doc_id % 50 = 7)
SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1""",
    "video_report_violations": """
WITH c AS (SELECT unnest([CASE WHEN d % 41 = 0 THEN 'saved_bytes' END, CASE WHEN d % 4 = 3 AND d % 27 = 3 THEN 'no_output' END, CASE WHEN d % 4 = 1 AND d % 31 = 1 THEN 'copy' END, CASE WHEN d % 4 = 0 AND (d % 37 = 0 OR d % 29 = 0) THEN 'adopted' END]) AS code
 FROM (SELECT doc_id AS d FROM documents) WHERE d % 50 <> 7 UNION ALL SELECT 'missing' FROM documents WHERE doc_id % 50 = 7)
SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1""",
    "workbook_report_violations": """
WITH c AS (SELECT unnest([CASE WHEN d % 43 = 0 THEN 'changed_count' END, CASE WHEN d % 4 = 0 AND d % 23 = 0 THEN 'changed_once' END, CASE WHEN d % 4 = 2 AND d % 53 = 2 THEN 'no_output' END, CASE WHEN d % 2 = 1 AND d % 31 = 1 THEN 'preserved' END,
 CASE WHEN d % 4 = 0 AND d % 29 = 0 THEN 'adopted' END, CASE WHEN d % 4 = 0 AND d % 23 = 0 THEN 'diagnostics' END]) AS code FROM (SELECT doc_id AS d FROM documents) WHERE d % 50 <> 7 UNION ALL SELECT 'missing' FROM documents WHERE doc_id % 50 = 7)
SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1""",
    "reconcile_ordinal": """
WITH l AS (SELECT conv_id, role, length(text)::DOUBLE AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM conversations),
r AS (SELECT conv_id, role, length(text) + CASE WHEN turn % 4 = 2 THEN 0.02 ELSE 0.005 END::DOUBLE AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 1)),
b AS (SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.o, r.o) AS ordinal, CASE WHEN l.o IS NULL THEN ['only_right'] WHEN r.o IS NULL THEN ['only_left'] ELSE [CASE WHEN l.role <> r.role THEN 'role' END, CASE WHEN abs(l.n - r.n) > 0.01 THEN 'n' END] END AS codes
 FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.o = r.o)
SELECT * FROM (SELECT conv_id, ordinal, unnest(codes) AS code FROM b) WHERE code IS NOT NULL""",
    "prefix_collisions": r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/*', '') AS path FROM pages), q AS (SELECT * FROM p WHERE path <> '')
SELECT page_id, path FROM q WHERE EXISTS (SELECT 1 FROM q o WHERE starts_with(lower(o.path), lower(q.path) || '/'))""",
    "same_path_collisions": "SELECT lower(regexp_replace(url, '^[a-z]+://[^/]*', '')) AS key, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1",
    "identity_collisions": f"SELECT doc_id % 3 AS device, length(text) AS inode, count(*) AS n, string_agg({_PATH}, '|' ORDER BY {_PATH}) AS paths FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "unexplained_edges": """
WITH e AS (SELECT DISTINCT url AS source, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages)
SELECT DISTINCT target AS node, 'unexplained_reference' AS reason FROM e WHERE length(target) % 2 = 1""",
    "parts_diff": """
WITH a AS (SELECT o_custkey, o_orderkey, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS d FROM orders),
b AS (SELECT o_custkey, o_orderkey, d + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS d FROM a WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_custkey, -o_orderkey - 1, d FROM a WHERE o_orderkey % 11 = 0)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderkey = b.o_orderkey WHERE a.d IS DISTINCT FROM b.d""",
    "undeclared_parts": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'undeclared' ELSE 'not_changed' END AS code FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 3 = 0)",
    "same_rows": "SELECT CASE WHEN l_linenumber = 1 THEN 'left' ELSE 'right' END AS side, l_returnflag, l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber < 2 OR l_linenumber >= 4 GROUP BY 1, 2, 3",
    "reference_overlap": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "reference_digest": "SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AS known FROM documents",
    "ambiguous_images": """
WITH i AS (SELECT source AS doc, doc_id % 97 = 0 AS un, doc_id % 211 = 0 AS mask, count(*) OVER (PARTITION BY source, lang, length(text)) > 1 AS twice FROM documents)
SELECT doc, CASE WHEN bool_or(mask) THEN 'image_mask' WHEN bool_or(twice) THEN 'ambiguous_image' WHEN bool_or(un) THEN 'unplaced_image' ELSE '' END AS problem FROM i GROUP BY 1""",
}
