"""Truth tables of the scalar functions and rules."""

import fnmatch
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import binary, globs, sizes, text
from tessera.operators import candidates, rules, state
from tessera.plans.pipeline import RunSpec


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def many(spark, names, rows, column):
    return [r.x for r in spark.createDataFrame(rows, names).select(column.alias("x")).collect()]


def test_globs_match_as_fnmatch(spark):
    rng = random.Random(5)
    cases = [("".join(rng.choice("ab*?[]!-/.") for _ in range(rng.randint(1, 7))), "".join(rng.choice("ab-/.]!") for _ in range(rng.randint(0, 6)))) for _ in range(1500)]
    for pattern, name in cases:
        try:
            want = fnmatch.fnmatchcase(name, pattern)
            got = re.search(globs.glob_regex(pattern).replace(r"\z", r"\Z"), name) is not None
        except re.error:
            continue
        assert got == want, (pattern, name)
    assert not one(spark, globs.matches_any(F.lit("a.pdf\n"), ["*.pdf"]))
    assert one(spark, globs.matches_any(F.lit("A/b/C.PDF"), ["a/*.pdf"]))
    assert not one(spark, globs.matches_any(F.lit("a"), []))


def test_normalize_patterns():
    assert globs.normalize_patterns(["B\\x/*", "./a//b", "b/x/*"]) == ["a/b", "b/x/*"]
    for bad in ("/a", "C:/a", "../a", "", "./"):
        with pytest.raises(ValueError):
            globs.normalize_patterns([bad])


def test_profile(spark):
    p = globs.profile(F.col("p"), ["keep/*"], {"photo": ["*/x.pdf"], "text": ["a/*"]}, "standard", strict=False)
    assert many(spark, "p string", [("keep/x.pdf",), ("b/x.pdf",), ("a/y.pdf",), ("a/x.pdf",), ("q",)], p) == ["preserve", "photo", "text", "conflict", "standard"]
    with pytest.raises(Exception, match="several profiles"):
        many(spark, "p string", [("a/x.pdf",)], globs.profile(F.col("p"), [], {"photo": ["*/x.pdf"], "text": ["a/*"]}, "standard"))


def test_rounding_rules(spark):
    rng = random.Random(1)
    rows = [(rng.randint(1, 9000), rng.randint(1, 9000)) for _ in range(500)] + [(1, 1), (1400, 9), (1401, 1), (5, 5000)]
    w, h = F.col("w"), F.col("h")

    def box(a, b):
        s = min(1.0, 2560 / max(a, b), 1440 / min(a, b))
        return max(1, round(a * s)), max(1, round(b * s))

    def video(a, b):
        s = min(1.0, 1280 / a, 720 / b)
        return max(2, int(a * s) // 2 * 2), max(2, int(b * s) // 2 * 2)

    def longest(a, b):
        n = max(a, b)
        return (a, b) if n <= 1000 else tuple(max(1, (x * 1000 + n // 2) // n) for x in (a, b))

    def width(a, b):
        return (a, b) if a <= 1400 else (1400, max(1, (b * 2800 + a) // (2 * a)))

    for column, want in ((sizes.fit_box(w, h, 2560, 1440), box), (sizes.video_box(w, h), video), (sizes.cap_longest(w, h, 1000), longest), (sizes.cap_width(w, h), width)):
        assert [tuple(x) for x in many(spark, "w int, h int", rows, column)] == [want(a, b) for a, b in rows]


def test_exact_ratio(spark):
    got = many(spark, "w bigint, h bigint, a bigint, b bigint", [(100, 50, 33, 10), (10, 10, 100, 100), (3, 7, 1, 1)], sizes.cap_required(F.col("w"), F.col("h"), (F.col("a"), F.lit(1)), (F.col("b"), F.lit(1))))
    assert [tuple(x) for x in got] == [(33, 17), (10, 10), (1, 3)]


def test_fractions(spark):
    assert many(spark, "t string", [("30000/1001",), ("50/2",), ("0/0",), ("-1/2",), ("7",), ("x",), (None,)], sizes.fraction_text(sizes.fraction(F.col("t")))) == ["30000/1001", "25/1", None, None, "7/1", None, None]


def test_effective_dpi(spark):
    n = F.lit(None).cast("double")
    x = one(spark, sizes.effective_dpis(F.lit(300.0), F.lit(100.0), F.lit(72.0), F.lit(72.0), F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(10.0)))
    assert (x.x, x.y) == (300 * 72 / 5, 720.0)
    x = one(spark, sizes.effective_dpis(F.lit(300.0), F.lit(100.0), F.lit(24.0), F.lit(72.0), n, n, n, n))
    assert (x.x, x.y) == (300.0, 300.0)
    x = one(spark, sizes.effective_dpis(F.lit(300.0), F.lit(0.0), F.lit(24.0), F.lit(72.0), n, n, n, n))
    assert (x.x, x.y) == (0.0, 0.0)


def test_tiles(spark):
    for length, most in ((10, 3), (9, 3), (1, 5), (17, 4)):
        got = one(spark, sizes.even_tile(F.lit(length), most))
        count = math.ceil(length / most)
        assert [t.size for t in got] == [length // count + (i < length % count) for i in range(count)]
        assert [t.start for t in got] == [sum(t.size for t in got[:i]) for i in range(count)]
    assert one(spark, sizes.even_tile(F.lit(0), 3)) == []


def test_text_functions(spark):
    assert many(spark, "n bigint", [(0,), (1023,), (1024,), (1152,), (1 << 40,), (1 << 55,)], text.human_size(F.col("n"))) == ["0.00 B", "1023.00 B", "1.00 KB", "1.12 KB", "1.00 TB", "32768.00 TB"]
    assert many(spark, "s double", [(3.21,), (125.9,)], text.elapsed(F.col("s"))) == ["3.2s", "2m 5s"]
    assert many(spark, "p string", [("a/b.JPG",), ("a/b.png",), ("a/.jpg",), ("a.jpg/b",)], text.output_name(F.col("p"), ".jpg", (".jpg", ".jpeg"))) == ["a/b.JPG", "a/b.png.jpg", "a/.jpg.jpg", "a.jpg/b.jpg"]
    import hashlib

    d = hashlib.sha256(b"r").hexdigest()[:8]
    assert many(spark, "p string", [("a/b.jpg",), ("a/b",), ("a.x/b",), ("a/b.c.jpg",)], text.hashed_name(F.col("p"), F.lit("r"))) == [f"a/b~{d}.jpg", f"a/b~{d}", f"a.x/b~{d}", f"a/b.c~{d}.jpg"]
    assert many(spark, "p string", [("a/b",), ("../b",), ("/a",), ("a//b",), ("C:a",), (None,)], text.safe_relative(F.col("p"))) == [True, False, False, False, False, False]
    assert one(spark, text.safe_json(F.lit("<a>&"))) == "\\u003ca\\u003e\\u0026"


def test_skip_status_takes_the_first_word(spark):
    assert many(spark, "r string", [("form in a signed file",), ("encrypted and signed",), ("form",), ("?",)], rules.skip_status(F.col("r"))) == ["SKIPPED_SIGNED", "SKIPPED_ENCRYPTED", "SKIPPED_COMPLEX", "SKIPPED_COMPLEX"]


def test_savings_gate(spark):
    rows = [(1 << 20, (1 << 20) - (256 << 10), True, "compact", True), (1 << 20, (1 << 20) - (256 << 10) + 1, True, "compact", False), (1 << 20, (1 << 20) - (64 << 10), True, "photo", True), (100, 99, False, "text", True), (100, 100, False, "text", False), (1 << 20, (1 << 20) - (16 << 10), False, "standard", False), (800 << 10, (800 << 10) - (16 << 10), False, "standard", True)]
    got = many(spark, "a bigint, b bigint, l boolean, p string, w boolean", rows, rules.meets_reduction(F.col("a"), F.col("b"), F.col("l"), F.col("p")))
    assert got == [r[-1] for r in rows]


def test_resume_truth_table(spark):
    rows = [  # found, source, config, digest, status, output, required, retry, todo
        (False, None, None, None, None, None, True, False, True),
        (True, False, True, "d", "ADOPTED", True, True, False, True),
        (True, True, False, "d", "ADOPTED", True, True, False, True),
        (True, True, True, "", "ADOPTED", True, True, False, True),
        (True, True, True, "", "ADOPTED", None, False, False, False),
        (True, True, True, "d", "ERROR", False, True, False, True),
        (True, True, True, "d", "ERROR", True, True, False, False),
        (True, True, True, "d", "ERROR", True, True, True, True),
        (True, True, True, "d", "ADOPTED", False, True, False, True),
        (True, True, True, "d", "ADOPTED", True, True, False, False),
    ]
    for f, s, c, d, st, o, required, retry, want in rows:
        col = state.should_process(F.lit(f), F.lit(s).cast("boolean"), F.lit(c).cast("boolean"), F.lit(d).cast("string"), F.lit(st).cast("string"), F.lit(o).cast("boolean"), required, retry)
        assert one(spark, col) is want


def test_best_candidate_ties(spark):
    rows = spark.createDataFrame([("a", 1, "text_gray", 10), ("a", 2, "lossless", 10), ("a", 3, "lossless", 10), ("a", 4, "x", 9)], "doc string, idx int, kind string, size int")
    best = candidates.best_candidate(rows, ["doc"], "size", [candidates.priority(F.col("kind")), "idx"], F.col("kind") != "x").first()
    assert (best.kind, best.idx) == ("lossless", 2)


def test_decide(spark):
    rows = spark.createDataFrame(
        [("a", 0, "lossless", 5, "quality_rejected"), ("a", 1, "other", 4, "eligible"), ("b", 0, "other", 4, "eligible"), ("b", 1, "other", None, "processing_error"), ("c", 0, "other", 9, "candidate_not_smaller")],
        "doc string, idx int, kind string, size int, reason string",
    )
    docs = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False)], "doc string, lossy boolean")
    got = {r.doc: (r.status, r.kind, r.candidate_size, r.reason) for r in candidates.decide(rows, docs).collect()}
    assert got == {"a": ("ADOPTED_LOSSY", "other", 5, ""), "b": ("ERROR", None, 4, "processing_error"), "c": ("UNCHANGED", None, 9, "candidate_not_smaller"), "d": ("PRESERVED_ORIGINAL", None, None, "")}


def test_image_headers():
    assert binary.image_header(None) == binary.image_header(b"GIF89a") == binary.image_header(b"\xff\xd8\xff\xda\x00\x04ab") == (None, None, None)
    assert binary.image_header(b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x05\x00\x06\x01\x11\x00\x00") == ("jpeg", 6, 5)


def test_binary_functions(spark):
    assert one(spark, binary.nfc(F.lit("e\u0301"))) == "\u00e9"
    assert one(spark, binary.casefold(F.lit("Stra\u00dfe"))) == "strasse"
    assert bytes(one(spark, binary.bilevel(F.lit(bytearray([0, 255, 220, 219, 0, 0, 0, 230]))))) == bytes([0b01100001])
    assert one(spark, binary.glyph_map(F.lit("1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0062> endbfrange"))) == {1: 0x41, 2: 0x62, 3: 0x63, 4: 0x64}


def test_run_spec():
    assert RunSpec().config_hash() == RunSpec(preview_dpis=(200, 150), retry_errors=True).config_hash() != RunSpec(dry_run=True).config_hash()
    for bad in (dict(preset="x"), dict(photo_dpi=100, profiles={"photo": ("a",)}), dict(photo_dpi=200), dict(safe=True, preset="compact"), dict(preview_dpis=(1, 2, 3, 4, 5, 6))):
        with pytest.raises(ValueError):
            RunSpec(**bad)


def test_bench_times_the_operators_and_the_containment_query():
    import __spark_entry__
    import bench

    names = bench.headline(__spark_entry__.queries())
    assert "reference_overlap" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
