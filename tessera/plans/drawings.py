"""Queries over drawings, stable values and selected candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import drawings
from tessera.plans.inventory import load
from tessera.plans.rules import cents


def drawing_plan(spark, sf_dir):
    """Orders as drawings, their lines as pictures of parts; a few lines are unused, ambiguous, cropped or mentioned twice."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    lines = load(spark, sf_dir, "lineitem").select(
        text("d", "l_orderkey").alias("drawing"), F.concat_ws("_", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"), text("i", "l_partkey").alias("target"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("x")
    ).distinct()
    orders = load(spark, sf_dir, "orders").select(text("s", "o_custkey").alias("sheet"), text("d", "o_orderkey").alias("rid"), "o_orderkey")
    up = orders.select(F.col("sheet").alias("owner"), "rid", F.lit("drawing").alias("type"), F.col("rid").alias("target"), (F.col("o_orderkey") % 211 == 0).alias("external"))
    relations = up.unionByName(lines.select(F.col("drawing").alias("owner"), "rid", F.lit("image").alias("type"), "target", (F.col("x") % 301 == 1).alias("external")))
    pictures = lines.where("x % 307 <> 2").select("drawing", "rid", (F.col("x") % 311 != 3).alias("single"), F.when(F.col("x") % 313 == 4, "outward_crop").alias("reason"))
    mentions = lines.select(F.col("drawing").alias("owner"), "rid", F.when(F.col("x") % 317 == 5, 2).otherwise(1).alias("n"))
    images = load(spark, sf_dir, "part").select(text("i", "p_partkey").alias("image"))
    return drawings.drawing_plan(images, orders.where("o_orderkey % 227 <> 6").select("sheet", "rid"), relations, pictures, mentions)


def stable_values(spark, sf_dir):
    """Each order as a nested value against one with other object numbers and sometimes another price."""
    k = F.col("o_orderkey")
    value = lambda i, price: F.struct(
        (k + i).alias("id"), (F.col("o_custkey") + i).alias("xref"), F.struct(F.col("o_orderstatus").alias("s"), (k * i).alias("id")).alias("inner"), F.array(F.struct(price.alias("price"), (k - i).alias("xref"))).alias("items")
    )
    price = cents("o_totalprice")
    both = load(spark, sf_dir, "orders").select("o_orderkey", value(1, price).alias("a"), value(2, price + (k % 5 == 0).cast("bigint")).alias("b"))
    a, b = (drawings.stable(F.col(c), both.schema[c].dataType) for c in "ab")
    return both.select("o_orderkey", (a == b).alias("same"), F.to_json(b).alias("stable"))


def selected_candidate(spark, sf_dir):
    rank = F.col("l_linenumber").cast("bigint") * 100_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    one = F.struct(rank.alias("rank"), F.concat(F.lit("k"), (F.col("l_linenumber") % 5).cast("string")).alias("kind"), (F.col("l_quantity") >= 40).alias("selected"))
    records = load(spark, sf_dir, "lineitem").where("l_orderkey % 29 <> 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    return drawings.selected_kinds(load(spark, sf_dir, "orders").select("o_orderkey"), records, "o_orderkey")


QUERIES = {f.__name__: f for f in (drawing_plan, stable_values, selected_candidate)}

_PRICE = "CAST(round_even(o_totalprice * 100, 0) AS BIGINT)"
SQL = {
    "drawing_plan": """
WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber || '_' || l_partkey || '_' || l_suppkey AS rid, l_partkey AS p, l_orderkey * 7 + l_linenumber AS x FROM lineitem),
w AS (SELECT l.*, x % 307 <> 2 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = o AND o_orderkey % 211 <> 0 AND o_orderkey % 227 <> 6) AS shown FROM l WHERE x % 301 <> 1),
g AS (SELECT p, count(*) FILTER (shown AND x % 311 <> 3) AS uses, count(*) FILTER (shown AND x % 311 <> 3 AND x % 313 <> 4) AS placements, bool_or(shown AND x % 311 = 3) AS amb, bool_or(shown AND x % 311 <> 3 AND x % 313 = 4) AS crop,
  bool_or(NOT shown OR x % 311 = 3 OR x % 313 = 4) AS unused, bool_or(x % 317 = 5) AS shared FROM w GROUP BY 1)
SELECT 'i' || p_partkey AS image, coalesce(uses, 0) AS uses, coalesce(placements, 0) AS placements, CASE WHEN amb THEN 'ambiguous_picture' WHEN crop THEN 'outward_crop' WHEN unused THEN 'unknown_or_unused_image_relationship'
  WHEN shared THEN 'shared_with_unsupported_image_use' WHEN coalesce(placements, 0) = 0 THEN 'no_supported_floating_placement' ELSE '' END AS reason FROM (SELECT DISTINCT p_partkey FROM part) LEFT JOIN g ON p = p_partkey""",
    "stable_values": f"""
SELECT o_orderkey, o_orderkey % 5 <> 0 AS same, '{{"inner":{{"s":"' || o_orderstatus || '"}},"items":[{{"price":' || ({_PRICE} + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) || '}}]}}' AS stable FROM orders""",
    "selected_candidate": """
WITH c AS (SELECT l_orderkey, arg_min('k' || (l_linenumber % 5), CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 10000 + l_suppkey) FILTER (l_quantity >= 40) AS kind FROM lineitem WHERE l_orderkey % 29 <> 0 GROUP BY 1)
SELECT o_orderkey, CASE WHEN l_orderkey IS NOT NULL THEN coalesce(kind, 'original') END AS selected_kind FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""",
}
