"""The drawing graph on a hand-made workbook, stable values of every kind, selected candidates."""

from pyspark.sql import functions as F

from tessera.operators import drawings


def test_drawing_plan(spark):
    images = spark.createDataFrame([(x,) for x in ("ok", "twice", "crop", "amb", "extra", "told", "lost", "other", "ext")], "image string")
    sheets = spark.createDataFrame([("s1", "r1"), ("s1", "r9"), (None, "r1"), ("s2", "r1")], "sheet string, rid string")
    names = ("ok", "twice", "twice", "crop", "amb", "extra", "told")
    relations = [("s1", "r1", "drawing", "d1", False), ("s1", "r9", "image", "d2", False), ("s2", "r1", "drawing", "d3", True), ("x", "r1", "image", "extra", False), ("d2", "r1", "image", "other", False), ("d1", "r8", "image", "ext", True)]
    relations += [("d1", f"p{i}", "image", n, False) for i, n in enumerate(names)]
    relations = spark.createDataFrame(relations, "owner string, rid string, type string, target string, external boolean")
    pictures = [("d1", f"p{i}", n != "amb", "outward_crop" if n == "crop" else None) for i, n in enumerate(names)] + [("d2", "r1", True, None), ("d1", None, True, None)]
    pictures = spark.createDataFrame(pictures, "drawing string, rid string, single boolean, reason string")
    mentions = spark.createDataFrame([("d1", f"p{i}", 2 if n == "told" else 1) for i, n in enumerate(names)], "owner string, rid string, n int")
    got = {r.image: (r.uses, r.placements, r.reason) for r in drawings.drawing_plan(images, sheets, relations, pictures, mentions).collect()}
    assert got == {
        "ok": (1, 1, ""), "twice": (2, 2, ""), "crop": (1, 0, "outward_crop"), "amb": (0, 0, drawings.AMBIGUOUS), "extra": (1, 1, drawings.UNUSED),
        "told": (1, 1, drawings.SHARED), "lost": (0, 0, drawings.UNPLACED), "other": (0, 0, drawings.UNUSED), "ext": (0, 0, drawings.UNPLACED),
    }
    assert drawings.drawing_plan(images.where("false"), sheets, relations, pictures, mentions).count() == 0


def test_stable(spark):
    df = spark.sql("select map('id', 1, 'k', 2) as m, named_struct('id', 1, 'v', array(named_struct('xref', 5, 'w', 6), null)) as s, cast(null as struct<id:int,v:int>) as n, 7 as id")
    row = df.select(*(drawings.stable(F.col(f.name), f.dataType).alias(f.name) for f in df.schema)).first()
    assert row.m == {"k": 2} and row.s.asDict(True) == {"v": [{"w": 6}, None]} and row.n is None and row.id == 7


def test_selected_kinds(spark):
    sources = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    records = spark.createDataFrame([("a", [("x", False), ("y", True), ("z", True)]), ("b", []), ("c", None)], "path string, candidates array<struct<kind:string,selected:boolean>>")
    assert {r.path: r.selected_kind for r in drawings.selected_kinds(sources, records).collect()} == {"a": "y", "b": "original", "c": "original", "d": None}
