"""Names, markers, sizes and paths as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def human_size(n: Column) -> Column:
    """Bytes with two decimals (half to even) in the first unit in which they are less than 1024."""
    n = n.cast("double")
    out = F.when(F.abs(n) < 1024, F.format_string("%.2f B", n))
    for i, unit in enumerate(UNITS[1:], 1):
        value = F.format_string(f"%.2f {unit}", F.bround(n / 1024**i, 2))
        out = out.when(F.abs(n) < 1024 ** (i + 1), value) if unit != UNITS[-1] else out.otherwise(value)
    return out


def parse_size(value: Column, unit: Column) -> Column:
    """Bytes of a number and a unit; unknown units give null."""
    factor = None
    for i, u in enumerate(UNITS):
        factor = (F if factor is None else factor).when(F.upper(unit) == u, F.lit(1024**i))
    return F.floor(value.cast("double") * factor).cast("bigint")


def elapsed(seconds: Column) -> Column:
    """'12.3s' under a minute, else '2m 5s'."""
    whole = F.floor(seconds).cast("bigint")
    return F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).otherwise(F.format_string("%dm %ds", F.floor(whole / 60).cast("bigint"), whole % 60))


def output_name(relative: Column, suffix: str, same: tuple[str, ...]) -> Column:
    """The path itself if its suffix is one of same, else with suffix appended."""
    extension = F.lower(F.regexp_extract(F.regexp_extract(relative, r"([^/]*)$", 1), r"[^.](\.[^.]+)$", 1))
    return F.when(extension.isin(*same), relative).otherwise(F.concat(relative, F.lit(suffix)))


def hashed_name(output: Column, relative: Column) -> Column:
    """The output with ~ and eight digits of the source path's SHA-256 before its suffix."""
    digest = F.concat(F.lit("~"), F.substring(F.sha2(relative, 256), 1, 8))
    stem = F.regexp_extract(output, r"^(.*?[^/.][^/]*?)(\.[^./]*)?$", 1)
    suffix = F.regexp_extract(output, r"[^/.][^/]*?(\.[^./]*)$", 1)
    return F.concat(F.when(stem == "", output).otherwise(stem), digest, suffix)


def marker(name: str, recipe: Column, size: Column, mtime_ns: Column, sha256: Column) -> Column:
    """The line that says what a file was made from."""
    return F.format_string(f"{name};recipe=%s;src_size=%d;src_mtime_ns=%d;src_sha256=%s", recipe, size.cast("bigint"), mtime_ns.cast("bigint"), sha256)


def parse_marker(name: str, comment: Column) -> Column:
    """struct(recipe, size, mtime_ns, sha256) of the last marker in a comment, or null."""
    pattern = rf"(?i){name};recipe=([0-9a-f]{{64}});src_size=([0-9]+);src_mtime_ns=([0-9]+);src_sha256=([0-9a-f]{{64}})"
    last = lambda g: F.try_element_at(F.regexp_extract_all(comment, F.lit(pattern), F.lit(g)), F.lit(-1))
    return F.when(
        comment.rlike(pattern),
        F.struct(F.lower(last(1)).alias("recipe"), last(2).try_cast("bigint").alias("size"), last(3).try_cast("bigint").alias("mtime_ns"), F.lower(last(4)).alias("sha256")),
    )


def without_marker(name: str, comment: Column) -> Column:
    """A comment's other lines."""
    return F.array_join(F.filter(F.split(comment, "\n"), lambda line: ~F.contains(F.lower(line), F.lit(name.lower()))), "\n")


def without_space(text: Column) -> Column:
    """Text for a comparison that white space doesn't matter to."""
    return F.regexp_replace(text, r"[\s ]+", "")


def safe_json(text: Column) -> Column:
    """JSON text that can stand in a page."""
    for sign, code in (("<", "\\\\u003c"), (">", "\\\\u003e"), ("&", "\\\\u0026"), (" ", "\\\\u2028"), (" ", "\\\\u2029")):
        text = F.regexp_replace(text, sign, code)
    return text


def safe_relative(path: Column) -> Column:
    """Whether a path stays within its root: relative, with no empty, dot or climbing part, back slash, drive or control sign."""
    part = lambda s: s.isin("", ".", "..")
    return F.coalesce(~F.exists(F.split(path, "/"), part) & ~path.rlike(r"[\\\x00-\x1f:]"), F.lit(False))


def strict_number(text: Column, low: float, high: float) -> Column:
    """decimal(38,18) of plain decimal digits within bounds, else null."""
    value = F.when(text.rlike(r"^[+-]?([0-9]{1,18}(\.[0-9]{0,18})?|\.[0-9]{1,18})\z"), text.try_cast("decimal(38,18)"))
    return F.when((value >= low) & (value <= high), value)


def reasons_text(reason_counts: Column) -> Column:
    """'reason=count' in order of reasons, from an array of struct(reason, n)."""
    return F.array_join(F.transform(F.array_sort(reason_counts), lambda s: F.concat(s["reason"], F.lit("="), s["n"].cast("string"))), "; ")


def tail(text: Column, n: int) -> Column:
    """struct(text, truncated): the last n signs."""
    return F.struct(F.right(text, F.lit(n)).alias("text"), (F.length(text) > n).alias("truncated"))
