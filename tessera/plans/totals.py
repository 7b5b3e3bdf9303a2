"""Queries that add up, measure and lay out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import sizes, text
from tessera.operators import geometry, reconcile, summary
from tessera.plans.inventory import files, load
from tessera.plans.rules import cents


def run_summary(spark, sf_dir):
    size = cents("o_totalprice")
    d = F.col("o_orderkey")
    records = load(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "UNCHANGED").otherwise(F.col("o_orderstatus")).alias("status"), size.alias("source_size"),
        F.when(d % 3 == 0, 0).when(d % 3 == 1, F.lit(None)).otherwise(F.call_function("div", size, F.lit(2))).cast("bigint").alias("output_size"),
        F.when(d % 3 == 2, size - F.call_function("div", size, F.lit(2))).alias("saved_bytes"), F.when(d % 5 == 0, "").when(d % 5 == 1, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("decision_reason"),
    )
    return summary.run_summary(records)


def null_poisoned_totals(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = files(spark, sf_dir).join(labels, "doc_id", "left").select("source", "lang", F.octet_length("text").cast("bigint").alias("source_size"), F.when(F.col("quality").isNotNull() | (F.col("source") < "src15"), F.octet_length("text").cast("bigint") - 1).alias("output_size"), F.when(F.col("quality") == 0, "ERROR").otherwise("OK").alias("status"))
    return summary.report_totals(rows, ["source"])


def grand_total(spark, sf_dir):
    price = load(spark, sf_dir, "orders").select(cents("o_totalprice").alias("source_size"), F.call_function("div", cents("o_totalprice"), F.lit(3)).alias("output_size"), F.col("o_orderstatus").alias("status"))
    lines = load(spark, sf_dir, "lineitem").select(cents("l_extendedprice").alias("source_size"), cents("l_extendedprice").alias("output_size"), F.when(F.col("l_tax") == 0, "ERROR").otherwise("").alias("status"))
    out = summary.rollup([summary.report_totals(price), summary.report_totals(lines, count_errors=False)])
    return out.withColumn("reduction", F.round("reduction", 6))


def status_histogram(spark, sf_dir):
    out = summary.status_histogram(load(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus")
    return out.select("o_orderpriority", F.array_join(F.transform(F.array_sort(F.map_entries("statuses")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("statuses"))


def outcome_counts(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.when(F.col("l_quantity") > 45, "ERROR").otherwise("CONVERTED").alias("action"), F.when(F.col("l_tax") > 0.05, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"), cents("l_extendedprice").alias("source_size"), F.col("l_linenumber").cast("bigint").alias("output_size"))
    return summary.outcome_counts(rows)


def baseline_unchanged(spark, sf_dir):
    a = files(spark, sf_dir).select("path", F.sha2("text", 256).alias("sha256"))
    same = summary.unchanged(a, a, "path", ["sha256"]).withColumn("run", F.lit("same"))
    return same.unionByName(summary.unchanged(a, a.withColumn("sha256", F.when(F.col("path").endswith("/7.txt"), "x").otherwise(F.col("sha256"))), "path", ["sha256"]).withColumn("run", F.lit("changed")))


def quality_stats(spark, sf_dir):
    out = summary.quality(load(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "frames", F.round("mean", 6).alias("mean"), "p5")


def reason_histogram_text(spark, sf_dir):
    return summary.reason_text(load(spark, sf_dir, "events"), ["user_id"], "event_type")


def placement_max_min(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_quantity") * 72 / (F.col("l_linenumber") + 1)).alias("dpi_x"), (F.col("l_quantity") * 36 / F.col("l_linenumber")).alias("dpi_y"))
    hi, lo = geometry.image_dpis(rows, ["l_partkey"]), geometry.image_dpis(rows, ["l_partkey"], least=True)
    r = lambda c, n: F.round(c, 6).alias(n)
    return hi.select("l_partkey", r("dpi_x", "max_x"), r("dpi_y", "max_y")).join(lo.select("l_partkey", r("dpi_x", "min_x"), r("dpi_y", "min_y")), "l_partkey")


def scan_ratio(spark, sf_dir):
    out = geometry.scan_ratio(load(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_quantity") / 50, F.col("l_linenumber") * 5, F.col("l_discount") * 10000)
    return out.withColumn("scan_ratio", F.round("scan_ratio", 6))


def largest_placement(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumn("area", F.floor(F.col("l_quantity") / 10)).withColumn("ordinal", F.col("l_linenumber") * 100_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey"))
    return geometry.largest_placement(rows, ["l_orderkey"], F.col("area"), "ordinal", F.lit(4)).select("l_orderkey", "ordinal", "area", "area_ratio")


def visible_text(spark, sf_dir):
    span = F.struct((F.col("l_linenumber") % 4).alias("render_type"), F.col("l_discount").alias("opacity"), F.array_repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("chars"))
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(span).alias("spans"))
    return rows.select("l_orderkey", geometry.visible_text_length(F.col("spans")).cast("bigint").alias("n"))


def required_pixels(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    need = geometry.required_pixels(lines, ["p_partkey", "p_size"], F.ceil(F.col("l_quantity") * 3), F.ceil(F.col("l_quantity") * 2))
    w, h = F.col("p_size").cast("bigint") * 5 + 1, F.col("p_size").cast("bigint") * 4 + 1
    one = F.lit(1).cast("bigint")
    to = sizes.cap_required(w, h, (F.col("need_x"), one), (F.col("need_y"), one))
    cap = sizes.cap_longest(w, h, 100)
    return need.select("p_partkey", "need_x", "need_y", to["w"].alias("w"), to["h"].alias("h"), cap["w"].alias("cap_w"), cap["h"].alias("cap_h"))


def tile_difference(spark, sf_dir):
    nxt = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    pairs = load(spark, sf_dir, "embeddings").withColumn("other", nxt).where("other is not null")
    d = geometry.tile_differences(F.col("embedding"), F.col("other"), 8, 4)
    return pairs.select("vec_id", F.round(d["global"], 5).alias("global"), F.round(d["local"], 5).alias("local"))


def even_tiles(spark, sf_dir):
    tiles = sizes.even_tile(F.col("p_size").cast("bigint"), 7)
    return load(spark, sf_dir, "part").select("p_partkey", F.posexplode(tiles).alias("i", "t")).select("p_partkey", F.col("i").cast("bigint").alias("i"), F.col("t.start").alias("start"), F.col("t.size").alias("size"))


def grid_extent(spark, sf_dir):
    cells = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sheet"), F.call_function("div", F.col("p_size"), F.lit(2)).cast("int").alias("a"), (F.col("p_size") + 1).cast("int").alias("b"))
    widths = load(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), F.col("p_size").alias("idx")).distinct().withColumn("emu", sizes.column_pixels(F.col("idx").cast("bigint") * 100, 7) * 9525)
    return geometry.extent(cells, widths, "a", "b").select("p_partkey", F.col("extent").alias("emu"))


def fit_box_sizes(spark, sf_dir):
    w, h = F.col("l_quantity").cast("bigint") * 101 + F.col("l_linenumber"), F.col("l_linenumber").cast("bigint") * 777 + F.col("l_suppkey") % 1000
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", w.alias("w"), h.alias("h"))
    w, h = F.col("w"), F.col("h")
    out = {"box": sizes.fit_box(w, h, 2560, 1440), "width": sizes.cap_width(w, h), "longest": sizes.cap_longest(w, h, 1000), "video": sizes.video_box(w, h)}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(c[x].alias(f"{n}_{x}") for n, c in out.items() for x in ("w", "h")))


def effective_dpi(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    shown = F.col("l_discount") * 1000
    none = F.lit(None).cast("double")
    has = n % 2 == 0
    d = sizes.effective_dpis(q * 100, n * 150, shown, shown + q, F.when(has, q).otherwise(none), F.when(has, n.cast("double")).otherwise(none), F.when(has, -n.cast("double")).otherwise(none), F.when(has, q).otherwise(none))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("q"), d["x"].alias("x"), d["y"].alias("y"))
    photo = sizes.photo_dimensions((F.col("q") * 100).cast("bigint"), F.col("l_linenumber") * 150, F.col("x"), F.col("y"), 200)
    at = F.when(F.col("x") > 0, sizes.dimension_at_dpi((F.col("q") * 100).cast("bigint"), F.col("x"), 150))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), at.alias("at"), photo["w"].alias("w"), photo["h"].alias("h"))


def json_probe(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    clean = F.when(F.col("event_id") % 10 == 0, "N/A").when(F.col("event_id") % 10 == 1, "0/0").otherwise(F.concat(k.cast("string"), F.lit("/"), (F.col("event_id") % 12).cast("string")))
    rate = sizes.fraction(F.when(~clean.isin("", "N/A", "0/0"), clean))
    return load(spark, sf_dir, "events").select("event_id", k.cast("bigint").alias("k"), sizes.fraction_text(F.when(rate.isNotNull(), rate)).alias("rate"))


def isclose_check(spark, sf_dir):
    a = F.col("l_extendedprice")
    b = a * (1 + (F.col("l_linenumber") - 3) * 1e-6)
    return load(spark, sf_dir, "lineitem").groupBy(sizes.is_close(a, b, 1.5e-6, 1e-9).alias("near")).agg(F.count("*").alias("n"))


def distinct_desc(spark, sf_dir):
    sizes_ = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list("p_size").alias("s"))
    return sizes_.select("p_brand", F.array_join(F.slice(F.reverse(F.array_sort(F.array_distinct("s"))), 1, 5), ",").alias("largest"))


def path_safety(spark, sf_dir):
    p = F.regexp_replace("url", r"^[a-z]+://[^/]*/", "")
    odd = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("../"), p)).when(F.col("page_id") % 7 == 1, F.concat(F.lit("C:"), p)).otherwise(p)
    return load(spark, sf_dir, "pages").select("page_id", text.safe_relative(odd).alias("safe"), F.url_decode(F.regexp_replace(p, "%", "")).alias("decoded"))


def diagnostics_validity(spark, sf_dir):
    outcome = F.when(F.col("l_returnflag") == "R", "adopted").when(F.col("l_returnflag") == "A", "rejected").otherwise("planned")
    d = F.struct(F.concat(F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("part"), outcome.alias("outcome"))
    changed = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 45), F.concat(F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")))
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(d).alias("d"), F.collect_list(changed).alias("c"))
    return rows.select("l_orderkey", reconcile.diagnostics_valid(F.col("d"), F.col("c"), F.lit(True), F.lit("ADOPTED_LOSSY")).alias("valid"), F.size("c").cast("bigint").alias("changed"))


def elapsed_text(spark, sf_dir):
    s = F.col("o_orderkey") / 7
    return load(spark, sf_dir, "orders").select("o_orderkey", text.elapsed(F.floor(s * 10) / 10).alias("elapsed"))


def video_timeout(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", sizes.clamp(F.lit(60.0) + (F.col("o_orderkey") % 1000) * 20.0, 600.0, 14400.0).alias("seconds"), sizes.page_pixels(F.col("o_orderkey") % 600 + 0.5, F.lit(842.0), 200).cast("bigint").alias("pixels"))


def strict_numbers(spark, sf_dir):
    t = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "+").when(F.col("l_linenumber") % 3 == 1, "").otherwise("e"), F.col("l_quantity").cast("int").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(text.strict_number(t, 0, 40)).alias("valid"), F.sum(text.strict_number(t, 0, 40)).cast("double").alias("total"))


def used_codes(spark, sf_dir):
    out = summary.used_codes(load(spark, sf_dir, "events").withColumn("code", F.from_json("props", "k int")["k"] % 10), ["event_type"], "code")
    return out.select("event_type", F.array_join("codes", ",").alias("codes"))


def within_budget(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice").alias("bytes"), F.lit(1).alias("n"))
    return summary.within_budget(rows, ["l_orderkey"], {"bytes": 10_000_000, "n": 5}).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def bounded_views(spark, sf_dir):
    return geometry.bounded_views(load(spark, sf_dir, "conversations").withColumn("page", F.col("turn") + 1), "conv_id", "page", "role", 4, 3).select("conv_id", "turn", F.col("view").cast("bigint").alias("view"))


def output_recipe(spark, sf_dir):
    from tessera.operators import rules

    path = F.concat(F.lit("v"), F.get(F.array(*map(F.lit, (".MP4", ".mkv", ".avi"))), (F.col("event_id") % 3).cast("int")))
    r = rules.output_recipe(path, (F.col("event_id") * 10).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", r["encoder"].alias("encoder"), r["codec"].alias("codec"), r["sample_rate"].alias("sample_rate"))


def log_tail(spark, sf_dir):
    t = text.tail(F.col("text"), 500)
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(t["text"], 256).alias("tail"), t["truncated"].alias("truncated"))


QUERIES = {f.__name__: f for f in (run_summary, null_poisoned_totals, grand_total, status_histogram, outcome_counts, baseline_unchanged, quality_stats, reason_histogram_text, placement_max_min, scan_ratio, largest_placement, visible_text, required_pixels, tile_difference, even_tiles, grid_extent, fit_box_sizes, effective_dpi, json_probe, isclose_check, distinct_desc, path_safety, diagnostics_validity, elapsed_text, video_timeout, strict_numbers, used_codes, within_budget, bounded_views, output_recipe, log_tail)}

_C = "CAST(round_even({0} * 100, 0) AS BIGINT)"
SQL = {
    "run_summary": f"""
WITH b AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'UNCHANGED' ELSE o_orderstatus END AS status, {_C.format('o_totalprice')} AS size, o_orderkey AS d, o_orderpriority AS p FROM orders),
r AS (SELECT status, CASE WHEN status = 'UNCHANGED' THEN CASE WHEN d % 5 < 2 THEN 'not_recorded' ELSE p END END AS reason, size, CASE WHEN d % 3 = 2 AND size // 2 > 0 THEN size // 2 ELSE size END AS out, CASE WHEN d % 3 = 2 THEN size - size // 2 ELSE 0 END AS saved FROM b)
SELECT CASE WHEN grouping(status) = 1 THEN 'total' WHEN grouping(reason) = 1 THEN 'status' ELSE 'reason' END AS level, status, reason, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_in, CAST(sum(out) AS BIGINT) AS total_out, CAST(sum(saved) AS BIGINT) AS total_saved
FROM r GROUP BY GROUPING SETS ((), (status), (status, reason)) HAVING grouping(reason) = 1 OR reason IS NOT NULL""",
    "null_poisoned_totals": """
WITH r AS (SELECT source, strlen(text) AS s, CASE WHEN quality IS NOT NULL OR source < 'src15' THEN strlen(text) - 1 END AS o, coalesce(quality = 0, FALSE) AS e FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, count(*) AS count, CAST(count_if(e) AS BIGINT) AS errors, CAST(sum(s) AS BIGINT) AS orig_size, CASE WHEN count(o) = count(*) THEN CAST(sum(o) AS BIGINT) END AS new_size, CASE WHEN count(o) = count(*) THEN CAST(sum(s) - sum(o) AS BIGINT) END AS saved FROM r GROUP BY 1""",
    "grand_total": f"""
WITH t AS (SELECT count(*) AS c, 0 AS e, sum({_C.format('o_totalprice')}) AS i, sum({_C.format('o_totalprice')} // 3) AS o FROM orders
UNION ALL SELECT count_if(l_tax <> 0), count_if(l_tax = 0), sum({_C.format('l_extendedprice')}), sum({_C.format('l_extendedprice')}) FROM lineitem)
SELECT CAST(sum(c) AS BIGINT) AS count, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(i) AS BIGINT) AS orig_size, CAST(sum(o) AS BIGINT) AS new_size, CAST(sum(i) - sum(o) AS BIGINT) AS saved, round(CAST(sum(i) - sum(o) AS DOUBLE) / CAST(sum(i) AS DOUBLE) * 100, 6) AS reduction FROM t""",
    "status_histogram": "SELECT o_orderpriority, string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus) AS statuses FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1",
    "outcome_counts": f"SELECT CAST(count_if(l_quantity <= 45) AS BIGINT) AS success, CAST(count_if(l_quantity > 45) AS BIGINT) AS errors, CAST(count_if(l_tax > 0.05::DOUBLE) AS BIGINT) AS warnings, CAST(sum({_C.format('l_extendedprice')}) FILTER (l_quantity <= 45) AS BIGINT) AS input_bytes, CAST(sum(l_linenumber) FILTER (l_quantity <= 45) AS BIGINT) AS output_bytes FROM lineitem",
    "baseline_unchanged": "SELECT TRUE AS same, 'same' AS run UNION ALL SELECT FALSE, 'changed'",
    "quality_stats": "SELECT event_type, count(*) AS frames, round(avg(value), 6) AS mean, quantile_disc(value, 0.05) AS p5 FROM events GROUP BY 1",
    "reason_histogram_text": "SELECT user_id, string_agg(event_type || '=' || n, '; ' ORDER BY event_type) AS text FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
    "placement_max_min": """
WITH r AS (SELECT l_partkey, l_quantity * 72 / (l_linenumber + 1) AS x, l_quantity * 36 / l_linenumber AS y FROM lineitem)
SELECT l_partkey, round(max(x), 6) AS max_x, round(max(y), 6) AS max_y, round(min(x), 6) AS min_x, round(min(y), 6) AS min_y FROM r GROUP BY 1""",
    "scan_ratio": """
WITH r AS (SELECT l_orderkey, l_quantity / 50 >= 0.8::DOUBLE AND l_linenumber * 5 <= 20 AND l_discount * 10000 > 450 AS s FROM lineitem)
SELECT l_orderkey, count(*) AS pages, CAST(count_if(s) AS BIGINT) AS scan_pages, round(count_if(s) / count(*), 6) AS scan_ratio FROM r GROUP BY 1""",
    "largest_placement": """
WITH r AS (SELECT l_orderkey, CAST(floor(l_quantity / 10) AS BIGINT) AS area, CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 10000 + l_suppkey AS ordinal FROM lineitem)
SELECT l_orderkey, ordinal, area, least(area / 4, 1.0::DOUBLE) AS area_ratio FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC, ordinal) AS n FROM r) WHERE n = 1""",
    "visible_text": "SELECT l_orderkey, CAST(coalesce(sum(CAST(l_quantity AS INT)) FILTER (l_linenumber % 4 <> 3 AND l_discount > 0), 0) AS BIGINT) AS n FROM lineitem GROUP BY 1",
    "required_pixels": """
WITH n AS (SELECT p_partkey, p_size * 5 + 1 AS w, p_size * 4 + 1 AS h, max(CAST(ceil(l_quantity * 3) AS BIGINT)) AS x, max(CAST(ceil(l_quantity * 2) AS BIGINT)) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN x * h >= y * w THEN x ELSE y END AS num, CASE WHEN x * h >= y * w THEN w ELSE h END AS den, greatest(w, h) AS l FROM n)
SELECT p_partkey, x AS need_x, y AS need_y, CAST(greatest(1, least(w, (w * num + den - 1) // den)) AS BIGINT) AS w, CAST(greatest(1, least(h, (h * num + den - 1) // den)) AS BIGINT) AS h,
CAST(CASE WHEN l <= 100 THEN w ELSE greatest(1, (w * 100 + l // 2) // l) END AS BIGINT) AS cap_w, CAST(CASE WHEN l <= 100 THEN h ELSE greatest(1, (h * 100 + l // 2) // l) END AS BIGINT) AS cap_h FROM s""",
    "tile_difference": """
WITH p AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
d AS (SELECT vec_id, i, abs(a[i + 1]::DOUBLE - b[i + 1]::DOUBLE) AS v FROM p, unnest(range(64)) t(i) WHERE b IS NOT NULL),
t AS (SELECT vec_id, i // 8 // 4 AS y, i % 8 // 4 AS x, avg(v) AS m FROM d GROUP BY 1, 2, 3)
SELECT g.vec_id, round(g.m, 5) AS "global", round(l.m, 5) AS "local" FROM (SELECT vec_id, avg(v) AS m FROM d GROUP BY 1) g JOIN (SELECT vec_id, max(m) AS m FROM t GROUP BY 1) l USING (vec_id)""",
    "even_tiles": """
WITH u AS (SELECT p_partkey, j, ntile(7) OVER (PARTITION BY p_partkey ORDER BY j) AS z, CAST(ceil(p_size / 7.0) AS BIGINT) AS c, p_size AS n FROM part, unnest(range(p_size)) t(j)),
v AS (SELECT p_partkey, CASE WHEN j < (n % c) * (n // c + 1) THEN j // (n // c + 1) ELSE (n % c) + (j - (n % c) * (n // c + 1)) // (n // c) END AS i, j FROM u)
SELECT p_partkey, CAST(i AS BIGINT) AS i, CAST(min(j) AS BIGINT) AS start, count(*) AS size FROM v GROUP BY 1, 2""",
    "grid_extent": """
WITH w AS (SELECT DISTINCT p_brand AS sheet, p_size AS idx, ((CAST(p_size AS BIGINT) * 100 + 128 // 7) * 7) // 256 * 9525 AS emu FROM part)
SELECT p_partkey, CAST(coalesce(sum(emu), 0) AS BIGINT) AS emu FROM part LEFT JOIN w ON sheet = p_brand AND idx >= p_size // 2 AND idx < p_size + 1 GROUP BY 1""",
    "fit_box_sizes": """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) * 101 + l_linenumber AS w, CAST(l_linenumber AS BIGINT) * 777 + l_suppkey % 1000 AS h FROM lineitem),
s AS (SELECT *, least(1.0::DOUBLE, 2560::DOUBLE / greatest(w, h), 1440::DOUBLE / least(w, h)) AS b, least(1.0::DOUBLE, 1280::DOUBLE / w, 720::DOUBLE / h) AS v, greatest(w, h) AS l FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(1, CAST(round_even(w * b, 0) AS BIGINT)) AS box_w, greatest(1, CAST(round_even(h * b, 0) AS BIGINT)) AS box_h, least(w, 1400) AS width_w, CASE WHEN w <= 1400 THEN h ELSE greatest(1, (h * 2800 + w) // (2 * w)) END AS width_h,
CASE WHEN l <= 1000 THEN w ELSE greatest(1, (w * 1000 + l // 2) // l) END AS longest_w, CASE WHEN l <= 1000 THEN h ELSE greatest(1, (h * 1000 + l // 2) // l) END AS longest_h,
greatest(2, CAST(floor(w * v) AS BIGINT) // 2 * 2) AS video_w, greatest(2, CAST(floor(h * v) AS BIGINT) // 2 * 2) AS video_h FROM s""",
    "effective_dpi": """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_linenumber AS n, l_quantity * 100 AS w, l_linenumber * 150 AS h, l_discount * 1000 AS sw, l_discount * 1000 + l_quantity AS sh FROM lineitem),
s AS (SELECT *, sw > 0 AND sh > 0 AS fine, CASE WHEN sw > 0 THEN abs(ln((sh / sw) / (w / h))) < abs(ln((sw / sh) / (w / h))) END AS swapped FROM r),
d AS (SELECT *, CASE WHEN n % 2 = 0 THEN sqrt(q * q + n * n) WHEN swapped THEN sh ELSE sw END AS dx, CASE WHEN n % 2 = 0 THEN sqrt(q * q + n * n) WHEN swapped THEN sw ELSE sh END AS dy FROM s),
e AS (SELECT *, CASE WHEN fine THEN w * 72 / dx ELSE 0 END AS x, CASE WHEN fine THEN h * 72 / dy ELSE 0 END AS y, CAST(w AS BIGINT) AS wi FROM d),
f AS (SELECT *, CASE WHEN x <= 200 THEN wi ELSE greatest(1, least(wi, CAST(ceil(wi * 200 / x) AS BIGINT))) END AS pw, CASE WHEN y <= 200 THEN h ELSE greatest(1, least(h, CAST(ceil(h * 200 / y) AS BIGINT))) END AS ph FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x, 6) AS x, round(y, 6) AS y, CASE WHEN x > 0 THEN greatest(1, least(wi, CAST(floor(wi * 150.0::DOUBLE / x) AS BIGINT))) END AS at,
CASE WHEN fine AND (pw <> wi OR ph <> h) THEN pw END AS w, CASE WHEN fine AND (pw <> wi OR ph <> h) THEN ph END AS h FROM f""",
    "json_probe": """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 12 AS d FROM events)
SELECT event_id, k, CASE WHEN event_id % 10 > 1 AND k > 0 AND d > 0 THEN concat(k // gcd(k, d), '/', d // gcd(k, d)) END AS rate FROM e""",
    "isclose_check": "SELECT abs(l_extendedprice - b) <= greatest(1.5e-6::DOUBLE * greatest(abs(l_extendedprice), abs(b)), 1e-9::DOUBLE) AS near, count(*) AS n FROM (SELECT l_extendedprice, l_extendedprice * (1 + (l_linenumber - 3) * 1e-6::DOUBLE) AS b FROM lineitem) GROUP BY 1",
    "distinct_desc": "SELECT p_brand, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY p_size DESC) AS largest FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part)) WHERE n <= 5 GROUP BY 1",
    "path_safety": r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS p FROM pages), o AS (SELECT page_id, p, CASE page_id % 7 WHEN 0 THEN '../' || p WHEN 1 THEN 'C:' || p ELSE p END AS q FROM p)
SELECT page_id, len(list_filter(string_split(q, '/'), lambda s: s IN ('', '.', '..'))) = 0 AND NOT regexp_matches(q, '[\\\x00-\x1f:]') AS safe, url_decode(replace(p, '%', '')) AS decoded FROM o""",
    "diagnostics_validity": """
WITH r AS (SELECT l_orderkey, l_linenumber || '-' || l_partkey AS part, l_returnflag = 'R' AS adopted, l_returnflag = 'R' AND l_quantity < 45 AS changed FROM lineitem)
SELECT l_orderkey, count(DISTINCT part) = count(*) AND len(list_filter(coalesce(list(part) FILTER (adopted), []), lambda p: NOT list_contains(coalesce(list(part) FILTER (changed), []), p))) = 0 AS valid, CAST(count_if(changed) AS BIGINT) AS changed FROM r GROUP BY 1""",
    "elapsed_text": """
WITH s AS (SELECT o_orderkey, floor(o_orderkey / 7 * 10) / 10 AS s FROM orders)
SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%.1fs', s) ELSE printf('%dm %ds', CAST(floor(s) AS BIGINT) // 60, CAST(floor(s) AS BIGINT) % 60) END AS elapsed FROM s""",
    "video_timeout": "SELECT o_orderkey, least(14400.0::DOUBLE, greatest(600.0::DOUBLE, 60.0::DOUBLE + (o_orderkey % 1000) * 20.0::DOUBLE)) AS seconds, CAST(ceil((o_orderkey % 600 + 0.5::DOUBLE) * 200 / 72) * ceil(842.0::DOUBLE * 200 / 72) AS BIGINT) AS pixels FROM orders",
    "used_codes": """
WITH c AS (SELECT DISTINCT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k FROM events)
SELECT event_type, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS codes FROM c GROUP BY 1""",
    "within_budget": f"""
WITH g AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum({_C.format('l_extendedprice')}) <= 10000000 AND count(*) <= 5)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM g)""",
    "bounded_views": "SELECT conv_id, turn, view FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS view FROM conversations WHERE turn < 4) WHERE view <= 3",
    "output_recipe": """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'aac' WHEN 1 THEN 'libopus' END AS encoder, CASE event_id % 3 WHEN 0 THEN 'aac' WHEN 1 THEN 'opus' END AS codec, CASE WHEN event_id % 3 < 2 THEN CAST(least(event_id * 10, 48000) AS INTEGER) END AS sample_rate FROM events""",
    "log_tail": "SELECT doc_id, sha256(right(text, 500)) AS tail, length(text) > 500 AS truncated FROM documents",
    "strict_numbers": """
WITH r AS (SELECT l_returnflag, CASE WHEN l_linenumber % 3 < 2 THEN CAST(CAST(l_quantity AS INT) || '.' || l_linenumber AS DECIMAL(18, 6)) END AS v FROM lineitem)
SELECT l_returnflag, count(v) FILTER (v <= 40) AS valid, CAST(sum(v) FILTER (v <= 40) AS DOUBLE) AS total FROM r GROUP BY 1""",
}
