"""Queries that decide: cascades, gates, choices, resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import sizes
from tessera.operators import candidates, rules, state, summary
from tessera.plans.inventory import files, load


def cents(c: str):
    return F.rint(F.col(c) * 100).cast("bigint")


def skip_reason_status(spark, sf_dir):
    words = F.array(*map(F.lit, ("encrypted form", "form then signed", "repaired", "no_pages", "odd", "inspect_error", "signed", "attachments")))
    reason = F.concat(F.col("event_type"), F.lit(": "), F.get(words, (F.col("event_id") % 8).cast("int")))
    return load(spark, sf_dir, "events").groupBy("event_type", rules.skip_status(reason).alias("status")).agg(F.count("*").alias("n"))


def savings_gate(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    before, after = cents("o_totalprice"), cents("l_extendedprice")
    ok = rules.meets_reduction(before, after, F.col("l_linenumber") % 2 == 0)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (before - after).alias("saved"), F.round(sizes.saved_ratio(before, after), 6).alias("ratio"), ok.alias("meets"))


def _pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = load(spark, sf_dir, "pages").select("page_id", F.length("html").cast("bigint").alias("n"), F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))).cast("bigint").alias("a"), F.size(F.regexp_extract_all("html", F.lit("<li"), F.lit(0))).cast("bigint").alias("li"))
    profiles = F.array(*map(F.lit, ("standard", "text", "text_scan", "photo", "preserve", "compact", "text_scan_bilevel", "font_replace")))
    docs = p.select(
        F.col("page_id").alias("doc"), F.get(profiles, (F.col("page_id") % 8).cast("int")).alias("profile"), (F.col("n") % 2 == 0).alias("safe"), (F.col("n") % 13 == 0).alias("encrypted"), (F.col("n") % 17 == 0).alias("repaired"),
        (F.col("n") % 19 == 0).cast("int").alias("signature_flags"), (F.col("a") % 11 == 10).alias("has_form"), (F.col("li") % 9 == 8).alias("has_attachments"), (F.col("n") % 23 == 0).alias("has_layers"),
        F.when(F.col("n") % 5 == 0, "image_mask").otherwise("").alias("scan_problem"),
    )
    x = F.col("n") + F.col("page")
    pages = p.where("n % 29 > 0").withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(
        F.col("page_id").alias("doc"), "page", (x % 7 == 0).alias("annotated"), (x % 4 != 1).alias("simple"), (x % 5 == 2).alias("drawn"), (F.col("li") % 3 == 0).alias("image"), (F.col("a") % 4 > 0).alias("has_text"),
        F.when(x % 6 == 5, F.array(F.lit("text"), F.lit("shade"))).otherwise(F.array(F.lit("text"))).alias("kinds"), (F.col("li") % 6 == 0).alias("raster"),
    )
    return docs, pages


def permission_cascade(spark, sf_dir):
    docs, pages = _pages(spark, sf_dir)
    return rules.document_permission(docs, pages).select("doc", "profile", "classification", "basis", "reason")


def structural_forall(spark, sf_dir):
    item = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "re").otherwise("l").alias("op"), F.col("l_linenumber").alias("x0"), F.lit(0).alias("y0"), F.col("l_linenumber").alias("x1"), F.col("l_quantity").cast("int").alias("y1"))
    drawing = F.struct(F.when(F.col("l_returnflag") == "R", "f").otherwise("s").alias("type"), (F.col("l_quantity") > 48).alias("filled"), F.lit("").alias("layer"), F.lit(1.0).alias("opacity"), F.array(item).alias("items"))
    drawn = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(drawing).alias("drawings"))
    return drawn.select("l_orderkey", rules.simple_rules(F.col("drawings")).alias("simple"), F.size("drawings").cast("bigint").alias("n"))


def _media(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), (F.col("event_id") % n).cast("int"))
    rate = lambda n: F.struct(F.lit(n).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den"))
    none = F.lit(None)
    text_map = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def stream(kind, width, height, pix, order, aspect, channels, r, tags):
        return F.struct(
            kind.alias("kind"), F.lit("h264").alias("codec"), width.cast("int").alias("width"), height.cast("int").alias("height"), pix.cast("string").alias("pix_fmt"), F.lit(8).alias("bit_depth"), order.cast("string").alias("field_order"),
            aspect.cast("string").alias("aspect"), r.alias("r_rate"), rate(30).alias("avg_rate"), channels.cast("int").alias("channels"), F.lit(False).alias("attached_pic"), F.lit("bt709").alias("transfer"),
            F.lit("bt709").alias("primaries"), tags.alias("tags"), F.array().cast("array<map<string,string>>").alias("side_data"),
        )

    turned = F.when(F.col("event_id") % 4 == 3, F.create_map(F.lit("Rotate"), F.lit("90"))).otherwise(text_map)
    video = stream(F.lit("video"), k * 16 + 320, k * 9 + 180, pick(7, *["yuv420p"] * 6, "yuv444p"), pick(5, "progressive", "progressive", "tt", "progressive", "unknown"), pick(6, *["1:1"] * 5, "4:3"), none, F.when(F.col("event_id") % 9 == 0, rate(60)).otherwise(rate(25)), turned)
    audio = stream(pick(10, *["audio"] * 9, "data"), none, none, none, none, none, pick(8, 1, 2, 2, 2, 1, 2, 6, 2), rate(25), text_map)
    return load(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("v"), F.col("event_id").cast("string"), pick(3, ".mp4", ".mov", ".avi")).alias("path"), F.lit("mov,mp4,m4a").alias("format_name"),
        F.when(F.col("event_id") % 11 == 0, 2).otherwise(0).alias("chapter_count"), F.array(video, audio).alias("streams"),
    )


def eligibility_cascade(spark, sf_dir):
    return rules.video_eligibility(_media(spark, sf_dir)).select("event_id", "status", "reason", "out_width", "out_height", "fps")


def state_row_validity(spark, sf_dir):
    size = cents("o_totalprice")
    out = F.when(F.col("o_orderkey") % 3 == 0, size).otherwise(F.call_function("div", size, F.lit(2)))
    rows = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "UNCHANGED").otherwise("ADOPTED").alias("status"), F.lit("compact").alias("preset"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"), size.alias("size"),
        F.sha2(F.when(F.col("o_orderkey") % 7 == 0, F.lit("x")).otherwise(F.col("o_orderkey").cast("string")), 256).alias("source_sha256"), size.alias("source_size"), F.lit("c").alias("config_hash"), F.when(F.col("o_orderkey") % 5 == 0, "d").otherwise("c").alias("wanted_config"),
        out.alias("output_size"), (size - out + (F.col("o_orderkey") % 11 == 0).cast("int")).alias("saved_bytes"), sizes.saved_percent(size, out).alias("saved_percent"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("output_sha256"), F.lit("").alias("error_message"),
        F.lit(1280).alias("width"), F.when(F.col("o_orderkey") % 13 == 0, 721).otherwise(720).alias("height"), F.lit(30.0).alias("fps"), F.lit(10.0).alias("duration"), F.lit(90.0).alias("vmaf_mean"), (F.lit(60.0) + F.col("o_orderkey") % 40).alias("vmaf_p5"), F.lit("AV1").alias("video_codec"),
    )
    return rows.select("o_orderkey", F.array_join(state.reuse_problems(min_saved=(10_000_000, 0.1)), ",").alias("problems"))


def resume_decision(spark, sf_dir):
    snap = files(spark, sf_dir).select(F.col("doc_id").alias("source_path"), F.sha2("text", 256).alias("source_sha256"), (F.col("doc_id") % 4 != 1).alias("output_matches"))
    old = load(spark, sf_dir, "labels").join(snap.select("source_path", F.col("source_sha256").alias("sha")), F.col("doc_id") == F.col("source_path")).select(
        "source_path", F.when(F.col("quality") == 1, F.col("sha")).otherwise("0").alias("source_sha256"), F.when(F.col("toxic") == 1, "old").otherwise("new").alias("config_hash"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("sha")).alias("output_sha256"), F.when(F.col("doc_id") % 7 == 0, "ERROR").otherwise("ADOPTED").alias("status"),
    )
    return state.resume(snap, old, "new").select(F.col("source_path").alias("doc_id"), "todo")


def upsert_state(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_path"), F.col("o_orderstatus").alias("status"))
    fresh = orders.where("source_path % 5 = 0").select("source_path", F.lit("N").alias("status"), F.lit("b").alias("basis"))
    return state.upsert(orders.where("source_path % 10 <> 0"), fresh, defaults={"basis": ""})


def state_lookup(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_path"), "o_orderstatus")
    return state.lookup(orders, load(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_path")))


def reuse_previous(spark, sf_dir):
    plan = files(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"))
    old = plan.where("cast(source_path as bigint) % 3 > 0").select("source_path", F.col("sha256").alias("source_sha256"), (F.col("size") + (F.col("source_path").cast("bigint") % 4 == 0).cast("int")).alias("source_size"), F.lit("o").alias("output_sha256"), F.when(F.col("source_path").cast("bigint") % 5 == 0, "ERROR").otherwise("CONVERTED").alias("action"))
    return state.reuse(plan, old).select(F.col("source_path").cast("bigint").alias("doc_id"), "reused")


def best_candidate(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice").alias("size"), "l_quantity")
    best = candidates.best_candidate(lines, ["l_orderkey"], "size", ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_quantity") >= 10)
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "size")


def document_decision(spark, sf_dir):
    order, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    size, before = cents("l_extendedprice"), cents("o_totalprice")
    failed = F.col("l_quantity") == 50
    enough = rules.meets_reduction(before, size, F.col("o_orderkey") % 2 == 0)
    reason = candidates.candidate_reason(F.col("l_tax") < 0.07, failed, F.lit(1), before, size, enough)
    idx = F.col("l_linenumber") * 100_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    kinds = F.array(*map(F.lit, ("scan_80", "lossless", "text_gray", "bilevel", "other", "jpeg_baseline", "scan_92")))
    rows = lines.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("doc"), idx.alias("idx"), F.get(kinds, (F.col("l_linenumber") % 7).cast("int")).alias("kind"), size.alias("size"), reason.alias("reason"))
    return candidates.decide(rows, order.select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 2 == 0).alias("lossy")))


def quality_gate_ladder(spark, sf_dir):
    steps = summary.quality(load(spark, sf_dir, "events").withColumn("step", (F.col("event_id") % 3).cast("int")), ["user_id", "step"], "value")
    out = candidates.ladder(steps, ["user_id"], (F.col("mean") >= 49) & (F.col("p5") >= 2.5), F.col("frames") >= 25)
    return out.select("user_id", "step", "frames", F.round("mean", 6).alias("mean"), F.round("p5", 6).alias("p5"), "outcome")


def image_actions(spark, sf_dir):
    b = lambda n, r=0: F.col("l_partkey") % n == r
    facts = load(spark, sf_dir, "lineitem").select(
        b(19).alias("generated_skip"), b(17).alias("output_complete"), b(13).alias("output_is_copy"), b(3, 1).alias("jpeg"), b(2).alias("copy_allowed"), b(11).alias("resized"), b(7).alias("oriented"), b(5).alias("reprocess"), b(23).alias("encode_failed"),
        cents("l_extendedprice").alias("source_size"), F.call_function("div", cents("l_extendedprice") * (F.col("l_linenumber") + 4), F.lit(8)).alias("candidate_size"),
    )
    return facts.groupBy(rules.image_action(False).alias("action"), rules.image_action(True, "compact").alias("dry_action")).agg(F.count("*").alias("n"))


def rotation(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.create_map(F.when(F.col("event_id") % 2 == 0, "ROTATE").otherwise("title"), (k * 45).cast("string"))
    side = F.when(F.col("event_id") % 3 == 0, F.array(F.create_map(F.lit("rotation"), F.lit("-90")))).otherwise(F.array().cast("array<map<string,string>>"))
    return load(spark, sf_dir, "events").select("event_id", rules.display_rotation(tags, side).alias("rotation"))


def workbook_rules(spark, sf_dir):
    parts = load(spark, sf_dir, "pages").select(F.call_function("div", F.col("page_id"), F.lit(5)).alias("doc"), F.concat(F.when(F.col("page_id") % 23 == 0, "xl/vbaProject.bin").otherwise("xl/part"), F.lit("")).alias("part"), F.when(F.col("page_id") % 5 == 0, "application/sheet.main+xml").otherwise("x").alias("type"), F.when(F.col("page_id") % 31 == 0, "=IMAGE (A1)").otherwise("=A1").alias("formula_text"))
    return rules.workbook_protection(parts)


QUERIES = {f.__name__: f for f in (skip_reason_status, savings_gate, permission_cascade, structural_forall, eligibility_cascade, state_row_validity, resume_decision, upsert_state, state_lookup, reuse_previous, best_candidate, document_decision, quality_gate_ladder, image_actions, rotation, workbook_rules)}

_CENTS = "CAST(round_even({0} * 100, 0) AS BIGINT)"
_TOTAL, _PRICE = _CENTS.format("o_totalprice"), _CENTS.format("l_extendedprice")
SQL = {
    "skip_reason_status": """
WITH r AS (SELECT event_type, event_type || ': ' || ['encrypted form', 'form then signed', 'repaired', 'no_pages', 'odd', 'inspect_error', 'signed', 'attachments'][CAST(event_id % 8 AS INT) + 1] AS reason FROM events)
SELECT event_type, CASE WHEN contains(reason, 'encrypted') THEN 'SKIPPED_ENCRYPTED' WHEN contains(reason, 'signed') THEN 'SKIPPED_SIGNED' ELSE 'SKIPPED_COMPLEX' END AS status, count(*) AS n FROM r GROUP BY 1, 2""",
    "savings_gate": f"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_TOTAL} AS a, {_PRICE} AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a - z AS saved, round(CASE WHEN a > 0 THEN (a - z) / a ELSE 0 END, 6) AS ratio,
a - z > 0 AND a - z >= CASE WHEN l_linenumber % 2 = 0 THEN 262144 ELSE 16384 END AND (a - z) / a >= CASE WHEN l_linenumber % 2 = 0 THEN 0.05::DOUBLE ELSE 0.02::DOUBLE END AS meets FROM b""",
    "permission_cascade": """
WITH p AS (SELECT page_id, length(html) AS n, len(regexp_extract_all(html, '<a ')) AS a, len(regexp_extract_all(html, '<li')) AS li FROM pages),
d AS (SELECT page_id AS doc, ['standard', 'text', 'text_scan', 'photo', 'preserve', 'compact', 'text_scan_bilevel', 'font_replace'][CAST(page_id % 8 AS INT) + 1] AS profile, * FROM p),
g AS (SELECT d.doc, d.profile, d.n, d.a, d.li, i AS page, d.n + i AS x FROM d, unnest([1, 2, 3]) t(i) WHERE d.n % 29 > 0),
f AS (SELECT doc, page, CASE WHEN x % 7 = 0 THEN 'annotations' WHEN profile = 'text' AND x % 4 = 1 THEN 'non_table_drawing' WHEN profile <> 'text' AND x % 5 = 2 THEN 'drawing'
  WHEN profile NOT IN ('text_scan', 'text_scan_bilevel') AND li % 3 = 0 THEN 'unpermitted_image' WHEN x % 6 = 5 THEN 'non_text_paint' END AS failure FROM g),
q AS (SELECT doc, count(*) AS pages, arg_min(failure, page) FILTER (failure IS NOT NULL) AS page_reason FROM f GROUP BY 1),
j AS (SELECT d.*, coalesce(pages, 0) AS np, page_reason, profile IN ('text_scan', 'text_scan_bilevel') AS scan, n % 5 = 0 AS problem, pages IS NOT NULL AND li % 3 = 0 AS any_image, pages IS NOT NULL AND a % 4 > 0 AS any_text,
  profile IN ('standard', 'compact') AND n % 2 <> 0 AND pages IS NOT NULL AND li % 6 = 0 AS auto FROM d LEFT JOIN q USING (doc)),
r AS (SELECT doc, profile, auto, CASE WHEN profile = 'preserve' THEN 'explicit_preserve' WHEN n % 13 = 0 THEN 'encrypted' WHEN n % 17 = 0 THEN 'repaired' WHEN np = 0 THEN 'no_pages' WHEN n % 19 = 0 THEN 'signed' WHEN a % 11 = 10 OR li % 9 = 8 THEN 'form_or_attachments'
  WHEN profile = 'photo' THEN '+photo' WHEN n % 23 = 0 THEN 'optional_content' WHEN auto AND problem THEN 'image_mask' WHEN auto THEN '+raster_scan' WHEN scan AND problem THEN 'image_mask' WHEN page_reason IS NOT NULL THEN page_reason
  WHEN scan AND NOT any_image THEN 'no_scan_image' WHEN scan THEN '+text_scan' WHEN NOT any_text THEN 'no_confirmed_text' WHEN profile = 'text' THEN '+text_table' ELSE '+text' END AS v FROM j)
SELECT doc, profile, CASE WHEN v LIKE '+%' THEN substring(v, 2) ELSE 'protected' END AS classification, CASE WHEN auto AND v = '+raster_scan' THEN 'automatic_scan_raster' WHEN profile IN ('standard', 'compact') THEN 'automatic_text_only' ELSE 'explicit_' || profile END AS basis,
CASE WHEN v LIKE '+%' THEN '' ELSE v END AS reason FROM r""",
    "structural_forall": "SELECT l_orderkey, bool_and(l_returnflag <> 'R' AND NOT l_quantity > 48) AS simple, count(*) AS n FROM lineitem GROUP BY 1",
    "eligibility_cascade": """
WITH e AS (SELECT event_id AS i, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
w AS (SELECT i, i % 4 = 3 AS turn, k * 16 + 320 AS w, k * 9 + 180 AS h FROM e),
s AS (SELECT i, CASE WHEN turn THEN h ELSE w END AS w, CASE WHEN turn THEN w ELSE h END AS h,
 CASE WHEN i % 3 = 2 THEN 'SKIPPED_UNSUPPORTED|container' WHEN i % 11 = 0 THEN 'SKIPPED_COMPLEX|chapters' WHEN i % 10 = 9 THEN 'SKIPPED_COMPLEX|streams: data' WHEN i % 8 = 6 THEN 'SKIPPED_COMPLEX|audio channels'
 WHEN i % 7 = 6 THEN 'SKIPPED_UNSUPPORTED|pixel format' WHEN i % 5 = 2 THEN 'SKIPPED_COMPLEX|field order' WHEN i % 6 = 5 THEN 'SKIPPED_COMPLEX|aspect ratio' END AS v FROM w),
t AS (SELECT *, least(1.0::DOUBLE, 1280::DOUBLE / w, 720::DOUBLE / h) AS scale FROM s)
SELECT i AS event_id, split_part(v, '|', 1) AS status, coalesce(split_part(v, '|', 2), '') AS reason, CASE WHEN v IS NULL THEN greatest(2, CAST(floor(w * scale) AS BIGINT) // 2 * 2) END AS out_width,
CASE WHEN v IS NULL THEN greatest(2, CAST(floor(h * scale) AS BIGINT) // 2 * 2) END AS out_height, CASE WHEN v IS NULL THEN '30/1' END AS fps FROM t""",
    "state_row_validity": f"""
WITH o AS (SELECT o_orderkey AS k, {_TOTAL} AS size, o_orderkey % 3 <> 0 AS adopted FROM orders), r AS (SELECT *, CASE WHEN adopted THEN size // 2 ELSE size END AS out FROM o)
SELECT k AS o_orderkey, array_to_string(list_filter([CASE WHEN k % 7 = 0 THEN 'source' END, CASE WHEN k % 5 = 0 THEN 'config' END, CASE WHEN k % 11 = 0 THEN 'saved_bytes' END,
CASE WHEN adopted AND NOT (size - out >= 10000000 AND (size - out) / size >= 0.1) THEN 'savings' END, CASE WHEN adopted AND k % 13 = 0 THEN 'shape' END, CASE WHEN adopted AND 60 + k % 40 < 70 THEN 'quality' END], lambda x: x IS NOT NULL), ',') AS problems FROM r""",
    "resume_decision": """
SELECT d.doc_id, l.doc_id IS NULL OR quality <> 1 OR toxic = 1 OR d.doc_id % 5 = 0 OR d.doc_id % 4 = 1 AS todo FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "upsert_state": """
SELECT o_orderkey AS source_path, 'N' AS status, 'b' AS basis FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, o_orderstatus, '' FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 5 <> 0""",
    "state_lookup": "SELECT o_orderkey AS source_path, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT doc_id FROM labels)",
    "reuse_previous": "SELECT doc_id, doc_id % 3 > 0 AND doc_id % 4 > 0 AND doc_id % 5 > 0 AS reused FROM documents",
    "best_candidate": f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, size FROM (SELECT *, {_PRICE} AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_PRICE}, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem WHERE l_quantity >= 10) WHERE r = 1""",
    "document_decision": f"""
WITH c AS (SELECT o_orderkey AS doc, CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 10000 + l_suppkey AS idx, ['scan_80', 'lossless', 'text_gray', 'bilevel', 'other', 'jpeg_baseline', 'scan_92'][l_linenumber % 7 + 1] AS kind,
 [6, 0, 3, 7, 3, 1, 4][l_linenumber % 7 + 1] AS pri, {_PRICE} AS size, {_TOTAL} AS before, l_tax, l_quantity, o_orderkey % 2 = 0 AS lossy FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, CASE WHEN l_quantity = 50 THEN 'processing_error' WHEN size >= before THEN 'candidate_not_smaller' WHEN NOT l_tax < 0.07 THEN 'quality_rejected'
 WHEN NOT (before - size >= CASE WHEN lossy THEN 262144 ELSE 16384 END AND (before - size) / before >= CASE WHEN lossy THEN 0.05::DOUBLE ELSE 0.02::DOUBLE END) THEN 'reduction_below_threshold' ELSE 'eligible' END AS reason FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS i, row_number() OVER (PARTITION BY doc, reason = 'eligible' ORDER BY size, pri, idx) AS b FROM r),
g AS (SELECT doc, bool_or(reason = 'processing_error') AS failed, max(kind) FILTER (reason = 'eligible' AND b = 1) AS kind, max(size) FILTER (i = 1) AS candidate_size, max(reason) FILTER (i = 1) AS first_reason FROM n GROUP BY 1),
s AS (SELECT o_orderkey AS doc, g.* EXCLUDE (doc), CASE WHEN failed THEN 'ERROR' WHEN kind IS NOT NULL AND o_orderkey % 2 = 0 THEN 'ADOPTED_LOSSY' WHEN kind IS NOT NULL THEN 'ADOPTED_LOSSLESS' WHEN first_reason IS NOT NULL THEN 'UNCHANGED' ELSE 'PRESERVED_ORIGINAL' END AS status FROM orders LEFT JOIN g ON doc = o_orderkey)
SELECT doc, status, CASE WHEN status LIKE 'ADOPTED%' THEN kind END AS kind, candidate_size, CASE status WHEN 'UNCHANGED' THEN first_reason WHEN 'ERROR' THEN 'processing_error' ELSE '' END AS reason FROM s""",
    "quality_gate_ladder": """
WITH q AS (SELECT user_id, CAST(event_id % 3 AS INT) AS step, count(*) AS frames, avg(value) AS mean, quantile_disc(value, 0.05) AS p5 FROM events GROUP BY 1, 2),
g AS (SELECT *, mean >= 49 AND p5 >= 2.5 AS good FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY good DESC, CASE WHEN good THEN step ELSE -step END) AS n FROM g)
SELECT user_id, step, frames, round(mean, 6) AS mean, round(p5, 6) AS p5, CASE WHEN good AND frames >= 25 THEN 'ADOPTED' ELSE 'UNCHANGED' END AS outcome FROM r WHERE n = 1""",
    "image_actions": f"""
WITH f AS (SELECT l_partkey AS k, {_PRICE} AS s, {_PRICE} * (l_linenumber + 4) // 8 AS c FROM lineitem),
a AS (SELECT *, k % 3 = 1 AS jpeg, k % 2 = 0 AS cp, k % 2 <> 0 OR k % 3 <> 1 OR k % 11 = 0 OR k % 7 = 0 OR (k % 5 = 0 AND s > c) OR (s - c >= 32768 AND s - c >= s * 0.1::DOUBLE) AS changed FROM f)
SELECT CASE WHEN k % 19 = 0 THEN 'SKIPPED_GENERATED' WHEN k % 17 = 0 THEN 'SKIPPED_COMPLETE' WHEN jpeg AND cp AND k % 7 <> 0 AND k % 5 <> 0 AND k % 13 = 0 THEN 'SKIPPED_COPY' WHEN k % 23 = 0 AND jpeg AND cp THEN 'COPIED_ENCODE_FAILED' WHEN k % 23 = 0 THEN 'ERROR' WHEN changed THEN 'CONVERTED' ELSE 'COPIED_ORIGINAL' END AS action,
CASE WHEN k % 19 = 0 THEN 'DRY_RUN_SKIPPED_GENERATED' ELSE 'DRY_RUN' END AS dry_action, count(*) AS n FROM a GROUP BY 1, 2""",
    "rotation": """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 45 % 360 AS k, event_id % 2 = 0 AS t, event_id % 3 = 0 AS s FROM events)
SELECT event_id, CASE WHEN NOT t AND NOT s THEN 0 WHEN t AND s AND k <> 270 THEN NULL WHEN s THEN 270 WHEN k IN (0, 90, 180, 270) THEN k END AS rotation FROM e""",
    "workbook_rules": """
SELECT page_id // 5 AS doc, CASE WHEN NOT bool_or(page_id % 5 = 0) THEN 'not_a_workbook' WHEN bool_or(page_id % 23 = 0) THEN 'macros' WHEN bool_or(page_id % 31 = 0) THEN 'cell_image_formula' ELSE '' END AS reason FROM pages GROUP BY 1""",
}
