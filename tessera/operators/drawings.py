"""The graph from sheets over drawings and pictures to images, and values compared without volatile keys."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Why an image stays as it is, the first that holds.
AMBIGUOUS, UNUSED, SHARED, UNPLACED = "ambiguous_picture", "unknown_or_unused_image_relationship", "shared_with_unsupported_image_use", "no_supported_floating_placement"


def drawing_plan(images: DataFrame, sheets: DataFrame, relations: DataFrame, pictures: DataFrame, mentions: DataFrame) -> DataFrame:
    """image, uses, placements and reason ('' where it may be rewritten) for every image.

    images: image. sheets: sheet, rid. relations: owner, rid, type, target, external. pictures: drawing, rid, single (alone in its
    anchor, one blip), reason (null: a supported placement). mentions: owner, rid, n: how often any attribute or text of the owner
    names the rid. A drawing counts if a sheet names it by an internal relationship of type drawing; a picture if its drawing
    does. Each way into an image must be explained: by a supported picture, and mentioned no more often than pictures consume it.
    A reason of a picture comes before those of relationships; of several the first by name. Rows with nulls explain nothing.
    """
    inner = relations.where(~F.coalesce("external", F.lit(True)))
    drawings = sheets.join(inner.where("type = 'drawing'").withColumnRenamed("owner", "sheet"), ["sheet", "rid"]).select(F.col("target").alias("owner")).distinct()
    into = inner.join(images.select(F.col("image").alias("target")).distinct(), "target").select("owner", "rid", "target", "type")
    shown = pictures.withColumnRenamed("drawing", "owner").join(drawings, "owner", "left_semi").join(into.where("type = 'image'"), ["owner", "rid"])
    good = F.col("single") & F.col("reason").isNull()
    used = shown.groupBy("owner", "rid", "target").agg(
        F.count_if("single").alias("uses"), F.count_if(good).alias("placements"), F.min(F.when(~F.coalesce("single", F.lit(False)), AMBIGUOUS).otherwise(F.col("reason"))).alias("why")
    )
    ways = into.join(used, ["owner", "rid", "target"], "left").join(mentions.groupBy("owner", "rid").agg(F.sum("n").alias("n")), ["owner", "rid"], "left")
    n = F.coalesce("placements", F.lit(0))
    ways = ways.withColumn("placements", n).groupBy(F.col("target").alias("image")).agg(
        F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"), F.sum("placements").alias("placements"), F.min("why").alias("why"),
        F.bool_or(F.col("placements") == 0).alias("unused"), F.bool_or(F.coalesce("n", F.lit(0)) > F.col("placements")).alias("shared"),
    )
    reason = F.coalesce("why", F.when(F.col("unused"), UNUSED), F.when(F.col("shared"), SHARED), F.when(F.coalesce("placements", F.lit(0)) == 0, UNPLACED), F.lit(""))
    return images.select("image").distinct().join(ways, "image", "left").select("image", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("placements", F.lit(0)).alias("placements"), reason.alias("reason"))


def stable(value: Column, kind: T.DataType, volatile: Collection[str] = ("xref", "id")) -> Column:
    """value of type kind without the volatile keys at any depth of structs, arrays and maps by text; nulls stay."""
    if isinstance(kind, T.StructType):
        kept = [stable(value[f.name], f.dataType, volatile).alias(f.name) for f in kind if f.name not in volatile]
        return F.when(value.isNotNull(), F.struct(*kept))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: stable(x, kind.elementType, volatile))
    if isinstance(kind, T.MapType):
        rest = F.map_filter(value, lambda k, _: ~k.isin(*volatile)) if isinstance(kind.keyType, T.StringType) else value
        return F.transform_values(rest, lambda _, x: stable(x, kind.valueType, volatile))
    return value


def selected_kinds(sources: DataFrame, records: DataFrame, on: str = "path") -> DataFrame:
    """sources with selected_kind: the kind of the first selected of the record's candidates (array of structs), else original; null without a record."""
    first = F.get(F.filter("candidates", lambda c: c["selected"]), F.lit(0))["kind"]
    return sources.join(records.select(on, F.coalesce(first, F.lit("original")).alias("selected_kind")), on, "left")
