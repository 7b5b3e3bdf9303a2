"""Reports tampered with, runs resumed, sinks read back, containers, logs, streams."""

import csv
import hashlib
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import collisions, geometry, reconcile, state, summary
from tessera.plans import joins
from tessera.plans import reports as plans_reports
from tessera.plans.pipeline import RunSpec, run
from tessera.sources import inventory, packages, plugins, probes, reports, sinks

SHA = "a" * 64
PDF_ROW = dict(zip(reports.PDF_COLUMNS, ["in/a.pdf", "1000", SHA, "out/a.pdf", "1000", SHA, "0", "0.0", "standard", "", "UNCHANGED", "3", "0", "0.5", 'line\nwith "quotes"', "standard", "standard", "", "text", "automatic_text_only", "", "", "", "", '[{"kind":"lossless","size":5}]', "false", "", "6", "false", "", "", "false"], strict=True))
IMAGE_ROW = dict(zip(reports.IMAGE_COLUMNS, ["a.jpg", "10", SHA, "o/a.jpg", "5", SHA, "CONVERTED", "", "standard", SHA, "jpeg", "false", "10", "10", "5", "5"], strict=True))
VIDEO_ROW = dict(zip(reports.VIDEO_COLUMNS, ["a.mp4", "10", "o/a.mp4", "10", "0", "0.000000", "UNCHANGED", "", "compact", SHA, SHA, "kept", "h264", "aac", "640", "360", "30.0", "10.0", "", "", "7", "false", "false"], strict=True))
EXCEL_ROW = dict(zip(reports.EXCEL_COLUMNS, ["3", "a.xlsx", "a.xlsx", "o/a.xlsx", "10", "10", SHA, SHA, "PRESERVED_ORIGINAL", "200", "0", "0", "[]", "no_images", "", "85", "v1", "true", "true", "[]"], strict=True))


def write(path, rows):
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        w = csv.DictWriter(f, list(rows[0]))
        w.writeheader()
        w.writerows(rows)
    return str(path)


def test_reports_are_accepted_whole_or_not(spark, tmp_path):
    cases = [
        (reports.pdf_report, PDF_ROW, [("source_size", "-1"), ("status", "DONE"), ("processing_schema", "5"), ("requested_policy", "text"), ("photo_dpi", "200"), ("source_sha256", "xyz"), ("lossless_jpeg_requested", "yes"), ("source_path", ""), ("saved_percent", "nan")]),
        (reports.image_manifest, IMAGE_ROW, [("action", "DONE"), ("output_size", "0"), ("output_format", "gif"), ("recipe_hash", ""), ("new_width", "0"), ("preset", "big")]),
        (reports.video_report, VIDEO_ROW, [("saved_percent", "101"), ("fps", "0"), ("vmaf_p5", "-1"), ("reason", ""), ("width", "0"), ("safe", "")]),
        (reports.excel_report, EXCEL_ROW, [("schema_version", "2"), ("source_size", "010"), ("jpeg_quality", "39"), ("image_diagnostics", '[{"part":"a","part":"b"}]'), ("changed_parts", "[[[[[[[[[1]]]]]]]]]"), ("status", "DONE")]),
    ]
    for k, (parse, row, tampers) in enumerate(cases):
        other = row | {"source_path": "b"}
        assert parse(spark, write(tmp_path / f"{k}.csv", [row, other])).count() == 2
        assert parse(spark, write(tmp_path / f"{k}-twice.csv", [row, other])).select("source_path").distinct().count() == 2
        for i, (name, value) in enumerate(tampers):
            assert parse(spark, write(tmp_path / f"{k}-{i}.csv", [other, row | {name: value}])).count() == 0, (name, value)
    got = reports.pdf_report(spark, write(tmp_path / "x.csv", [PDF_ROW])).first()
    assert got.error_message == 'line\nwith "quotes"' and got.source_size == 1000 and got.candidate_details[0].kind == "lossless" and got.photo_dpi is None


def test_fonts_and_adopted_videos_are_consistent(spark, tmp_path):
    font = PDF_ROW | {"profile": "font_replace", "requested_policy": "font_replace", "status": "ADOPTED_LOSSY", "font_replacement_requested": "true", "replacement_font": "Meiryo Regular", "replacement_font_sha256": SHA, "text_extraction_changed": "true"}
    video = VIDEO_ROW | {"status": "ADOPTED", "video_codec": "AV1", "vmaf_mean": "90.0", "vmaf_p5": "75.0"}
    cases = [
        (reports.pdf_report, font, [{"replacement_font": "Arial"}, {"replacement_font_sha256": ""}, {"font_replacement_requested": "false"}, {"status": "UNCHANGED"}]),
        (reports.pdf_report, PDF_ROW, [{"replacement_font": "Meiryo Regular"}, {"text_extraction_changed": "true"}]),
        (reports.video_report, video, [{"video_codec": "h264"}, {"audio_codec": "opus"}, {"width": "641"}, {"width": "1282"}, {"fps": "60"}, {"vmaf_p5": "69"}, {"vmaf_mean": ""}, {"output_path": "o/a.avi"}, {"ffmpeg_version": " "}]),
    ]
    for k, (parse, row, tampers) in enumerate(cases):
        assert parse(spark, write(tmp_path / f"{k}.csv", [row])).count() == 1, k
        for i, tamper in enumerate(tampers):
            assert parse(spark, write(tmp_path / f"{k}-{i}.csv", [row | tamper])).count() == 0, tamper
    assert reports.video_report(spark, write(tmp_path / "silent.csv", [video | {"audio_codec": "", "output_path": "o/a.webm"}])).count() == 1


def test_older_manifest(spark, tmp_path):
    old = {k: v for k, v in IMAGE_ROW.items() if k not in ("output_format", "strip_exif")}
    got = reports.image_manifest(spark, write(tmp_path / "old.csv", [old])).first()
    assert got.output_format == "jpeg" and got.strip_exif is False
    assert reports.image_manifest(spark, write(tmp_path / "bad.csv", [{k: v for k, v in old.items() if k != "action"}])).count() == 0
    assert reports.excel_report(spark, write(tmp_path / "more.csv", [EXCEL_ROW | {"more": "1"}])).count() == 0


def test_a_row_with_too_few_or_too_many_fields_voids_its_report(spark, tmp_path):
    for k, (parse, row) in enumerate(((reports.pdf_report, PDF_ROW), (reports.image_manifest, IMAGE_ROW), (reports.video_report, VIDEO_ROW), (reports.excel_report, EXCEL_ROW))):
        path = write(tmp_path / f"{k}.csv", [row, row | {"source_path": "b"}])
        whole = open(path, encoding="utf-8-sig", newline="").read()
        assert parse(spark, path).count() == 2
        for name, line in (("more", whole.rstrip() + ",surplus\r\n"), ("less", whole + "only,two\r\n")):
            (tmp_path / f"{k}-{name}.csv").write_text(line, encoding="utf-8")
            assert parse(spark, str(tmp_path / f"{k}-{name}.csv")).count() == 0, (k, name)


def test_extent_of_empty_ranges_and_repeated_cells(spark):
    widths = spark.createDataFrame([("s", i, 10) for i in (0, 1, 2, 5)], "sheet string, idx int, emu bigint")
    cells = spark.createDataFrame([(1, "s", 1, 1), (2, "s", 0, 2), (2, "s", 0, 2), (3, "s", 1, 9), (4, "s", 3, 5), (5, "s", 2, 0), (6, "t", 0, 4), (7, None, 0, 4), (8, "s", None, 4)], "n int, sheet string, a int, b int")
    assert sorted((r.n, r.extent) for r in geometry.extent(cells, widths, "a", "b").collect()) == [(1, 0), (2, 20), (2, 20), (3, 30), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0)]


def test_updates_of_one_key_leave_one_row(spark):
    schema = "source_path string, at int, status string"
    old = spark.createDataFrame([("a", 1, "x"), ("c", 1, "x")], schema)
    new = spark.createDataFrame([("a", 2, "late"), ("a", 1, "z"), ("b", None, None)], schema)
    assert sorted(map(tuple, state.upsert(old, new, order="at").collect()), key=str) == [("a", 2, "late"), ("b", None, None), ("c", 1, "x")]
    assert sorted(map(tuple, state.upsert(old, new.drop("at")).collect()), key=str) == sorted([("a", "z", None), ("b", None, None), ("c", "x", 1)], key=str)


def test_pointer_is_replaced_and_rows_are_counted(spark, tmp_path):
    for v in ("one", "two"):
        sinks.point(spark, str(tmp_path), v)
        assert sinks.current(spark, str(tmp_path)) == v
    assert [p for p in os.listdir(tmp_path) if not p.startswith(".")] == ["CURRENT"]
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    assert sorted(map(tuple, reconcile.same_rows(df(1, 1, 2, None), df(1, None, 3, 3)).collect())) == [(1, "left"), (2, "left"), (3, "right"), (3, "right")]


def test_scan_below_a_folder_with_signs(spark, tmp_path):
    root = tmp_path / "a+(b).$"
    (root / "d").mkdir(parents=True)
    (root / "d" / "x.PDF").write_bytes(b"1")
    assert [r.relative for r in inventory.scan(spark, str(root), [".pdf"]).collect()] == ["d/x.PDF"]


def test_one_violation_for_each_tampered_column(spark):
    base = dict(source_path="A", source_size=1_000_000, source_sha256="s", status="ADOPTED_LOSSY", preset="compact", profile="compact", requested_policy="compact", classification="raster_scan", permission_basis="automatic_scan_raster", preservation_reason="", output_size=400_000, output_sha256="o", saved_bytes=600_000, saved_percent=0.6)
    schema = "source_path string, source_size bigint, source_sha256 string, status string, preset string, profile string, requested_policy string, classification string, permission_basis string, preservation_reason string, output_size bigint, output_sha256 string, saved_bytes bigint, saved_percent double"
    have = spark.createDataFrame([("a", "s", 1_000_000)], "source_path string, sha256 string, size bigint")
    codes = lambda row: {r.code for r in reconcile.reconcile(have, spark.createDataFrame([tuple(row.values())], schema), reconcile.pdf_rules("compact", False)).collect()}
    assert codes(base) == set()
    for name, value, code in (("source_sha256", "x", "source_sha256"), ("preset", "standard", "preset"), ("requested_policy", "text", "policy"), ("saved_percent", 0.5, "saved_percent"), ("permission_basis", "x", "basis"), ("preservation_reason", "x", "protection"), ("saved_bytes", 600_001, "saved_bytes")):
        assert codes(base | {name: value}) == {code}, name
    assert codes(base | {"source_path": "b"}) == {"missing", "unexpected"}


def test_second_run_has_nothing_to_do(spark):
    data = [(f"d/{i}.bin", bytearray(b"x" * 50_000 if i % 2 else bytes(range(256)) * 2)) for i in range(6)] + [("keep/a.bin", bytearray(b"y" * 50_000))]
    files = spark.createDataFrame(data, "path string, content binary")
    spec = RunSpec(preserve=("keep/*",))
    empty = spark.createDataFrame([], "source_path string, source_sha256 string, config_hash string, output_sha256 string, status string")
    first = run(files, empty, spec)
    got = {r.source_path: r.status for r in first.collect()}
    assert got == {f"d/{i}.bin": "ADOPTED_LOSSLESS" if i % 2 else "SKIPPED_SMALL" for i in range(6)} | {"keep/a.bin": "PRESERVED_ORIGINAL"}
    assert run(files.repartition(3), first, spec).count() == 0
    assert run(files, first, RunSpec(preserve=("keep/*",), min_bytes=1)).count() == 7
    dry = run(files, empty, RunSpec(dry_run=True)).collect()
    assert all(r.output_size is None and r.output_sha256 == "" for r in dry)


def test_codec_failure_is_a_row(spark):
    def codec(path, content):
        yield "lossless", b"1", 1, True, ""
        raise OSError("broken")

    got = sorted(tuple(r) for r in plugins.candidates(spark.createDataFrame([("a", bytearray(b"abc"))], "path string, content binary"), codec).select("idx", "kind", "failed", "validation_reason").collect())
    assert got == [(0, "lossless", False, ""), (1, "error", True, "OSError: broken")]


def documents_of(spark, path, texts):
    rows = [(i, "en", "s", t) for i, t in texts]
    spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_whole_texts_go_through_the_sink(spark, tmp_path, monkeypatch):
    text = "a" * 300 + ' b\r\nc "d", \\"e\n' + "f" * 300
    sf, publish, at = documents_of(spark, tmp_path, [(1, text), (2, text + "g")]), sinks.publish_csv, []
    monkeypatch.setattr(plans_reports.sinks, "publish_csv", lambda *args: at.append(publish(*args)) or at[-1])
    got = {r.id: r.digest for r in plans_reports.report_roundtrip(spark, sf).collect()}
    assert got == dict.fromkeys((1, 2), hashlib.sha256(b"a" * 200).hexdigest())
    files = [f for f in os.listdir(at[0]) if f.endswith(".csv")]
    with open(f"{at[0]}/{files[0]}", newline="", encoding="utf-8") as f:
        assert {r["id"]: r["error_message"] for r in csv.DictReader(f)} == {"1": text, "2": text + "g"}


def test_summary_lines_reads_whole_texts(spark, tmp_path):
    sf = documents_of(spark, tmp_path, [(3, ""), (5, ""), (7, "x" * 100 + "Resized 8 images (9 errors)")])
    assert [tuple(r) for r in plans_reports.summary_lines(spark, sf).select("count", "errors").collect()] == [(8, 9)]


def test_short_references_are_found(spark, tmp_path):
    items = ["one", "b c", "a b c d e f", "a b c d e f g", "", "z z"]
    texts = [(1, "x a b c d e f. y"), (2, "a b c d e fs"), (3, "one"), (4, "a b c d e f gh"), (5, "no"), (6, "")]
    sf = documents_of(spark, tmp_path, texts)
    spark.createDataFrame(list(enumerate(items)), "item_id int, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = sorted(tuple(r) for r in joins.reference_overlap(spark, sf).collect())
    assert got == sorted((i, k) for i, text in texts for k, item in enumerate(items) if item in text)


def test_unknown_is_not_zero(spark):
    t = spark.createDataFrame([(1, 10, 4, "OK"), (1, 5, None, "ERROR"), (2, 7, 7, "OK")], "g int, source_size bigint, output_size bigint, status string")
    got = {r.g: (r.orig_size, r.new_size, r.saved, r.errors) for r in summary.report_totals(t, ["g"]).collect()}
    assert got == {1: (15, None, None, 1), 2: (7, 7, 0, 0)}
    assert summary.rollup([summary.report_totals(t.where("g = 1")), summary.report_totals(t.where("g = 2"))]).first().new_size is None
    none = summary.rollup([summary.report_totals(t.where("g = 3")).fillna(0)]).first()
    assert none.reduction == 0.0


def test_collisions_resolve_and_give_up(spark):
    plan = spark.createDataFrame([("x/a", "O/a"), ("x/b", "o/A"), ("x/c", "q"), ("x/d", "q/r"), ("x/e", "z")], "relative string, output string")
    got = {r.relative: r for r in collisions.resolve(plan).collect()}
    assert [got[k].hashed for k in ("x/a", "x/b", "x/c", "x/d", "x/e")] == [True, True, True, False, False]
    assert len({r.final.lower() for r in got.values()}) == 5
    with pytest.raises(ValueError, match="clash"):
        collisions.resolve(spark.createDataFrame([("a", "o"), ("a", "o")], "relative string, output string"))


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "state")
    schema = "source_path string, n bigint, added string"
    assert sinks.current(spark, root) is None and sinks.read_state(spark, root, schema).count() == 0
    sinks.publish_state(spark.createDataFrame([("a", 1)], "source_path string, n bigint"), root)
    assert [tuple(r) for r in sinks.read_state(spark, root, schema, {"added": "-"}).collect()] == [("a", 1, "-")]
    sinks.publish_state(spark.createDataFrame([("b", 2, "x")], schema), root)
    assert [tuple(r) for r in sinks.read_state(spark, root, schema).collect()] == [("b", 2, "x")]
    page = sinks.comparison_page(spark.createDataFrame([("</script>",)], "a string"), "A & B")
    assert "</script>]" not in page and "A &amp; B" in page
    sinks.write_manifest(spark.createDataFrame([("a", 1, "s", "o", 1, "t", "CONVERTED"), ("b", 1, "s", "o", 1, "t", "ERROR")], "source string, source_size bigint, source_sha256 string, output string, output_size bigint, output_sha256 string, action string"), str(tmp_path / "m"), {"schema_version": "1", "recipe_hash": "r"})
    assert reports.previous_manifest(spark, str(tmp_path / "m"), {"recipe_hash": "r"}).select("source").collect() == [("a",)]
    assert reports.previous_manifest(spark, str(tmp_path / "m"), {"recipe_hash": "q"}).count() == 0


def test_scan(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in (("b.PDF", b"1"), ("sub/a.pdf", b"22"), ("c.txt", b"3")):
        (tmp_path / "in" / name).write_bytes(data)
    got = [(r.relative, r.size) for r in inventory.ordered(inventory.scan(spark, str(tmp_path / "in"), [".pdf"]), "relative").collect()]
    assert got == [("b.PDF", 1), ("sub/a.pdf", 2)]
    again = inventory.scan(spark, str(tmp_path / "in"), [".pdf"])
    assert inventory.stable(again, again).count() == 0
    with pytest.raises(ValueError):
        inventory.select_named(again, spark.createDataFrame([("no",)], "path string"))


def test_relationships(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", '<R><Relationship Id="i" Type="t/drawing" Target="../drawings/d1.xml"/><Relationship Id="j" Type="t/link" Target="http://x" TargetMode="External"/></R>')
    rows = packages.relationships(spark.createDataFrame([("a", bytearray(b.getvalue()))], "path string, content binary")).collect()
    assert sorted((r.source, r.type, r.target, r.external) for r in rows) == [("xl/worksheets/sheet1.xml", "drawing", "xl/drawings/d1.xml", False), ("xl/worksheets/sheet1.xml", "link", "http://x", True)]


def test_probe(spark):
    good = '{"streams":[{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"r_frame_rate":"30000/1001","avg_frame_rate":"0/0","bits_per_raw_sample":"N/A","disposition":{"attached_pic":1}}],"format":{"format_name":"mov,mp4","duration":"10.5"},"chapters":[]}'
    rows = probes.media(spark.createDataFrame([("a", good), ("b", '{"streams":[],"format":{"duration":"N/A"}}'), ("c", "no")], "path string, payload string")).collect()
    a, b, c = sorted(rows, key=lambda r: r.path)
    assert a.error is None and a.streams[0].width == 1920 and a.streams[0].avg_rate is None and a.streams[0].bit_depth is None and a.streams[0].attached_pic and a.streams[0].r_rate.den == 1001
    assert b.error == "no duration" and c.error is not None
    with pytest.raises(Exception, match="no scores"):
        probes.frame_scores(spark.createDataFrame([("a", '{"frames":[]}')], "path string, payload string")).collect()


def test_stream_of_arrivals(spark, tmp_path):
    from tessera.streaming.inbox import arrivals

    box = tmp_path / "box"
    box.mkdir()
    (box / "a").write_bytes(b"one")
    (box / "b").write_bytes(b"one")
    (box / "c").write_bytes(b"two")
    q = arrivals(spark, str(box)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("arrived").select("size", "sha256").distinct().count() == spark.table("arrived").count() == 2


def test_ordinal_differences(spark):
    a = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "doc int, o int, x double")
    b = spark.createDataFrame([(1, 1, 1.005), (1, 2, 2.5), (1, 3, 3.0)], "doc int, o int, x double")
    assert sorted((r.ordinal, r.code) for r in reconcile.ordinal_differences(a, b, ["doc"], ["o"], {"x": 0.01}).collect()) == [(2, "x"), (3, "only_right")]
    assert reconcile.same_rows(a, a.repartition(2)).count() == 0 and F is not None


def test_publish_file(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"content")
    sha = sinks.publish_file(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert (tmp_path / "b").read_bytes() == b"content" and len(sha) == 64
    (tmp_path / "a").write_bytes(b"other")
    with pytest.raises(ValueError, match="expected"):
        sinks.publish_file(spark, str(tmp_path / "a"), str(tmp_path / "b"), sha)
    assert (tmp_path / "b").read_bytes() == b"content" and not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]
