"""Reports and state as files: versioned folders, a pointer flipped last, read back before it counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, MapType, StructType


def csv_text(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """All columns as a CSV report has them: true and false, empty for null, nested values as JSON with their nulls."""

    def column(f) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, StructType, MapType)):
            c = F.to_json(c, {"ignoreNullFields": "false"})
        elif isinstance(f.dataType, BooleanType):
            c = F.when(c, "true").when(~c, "false")
        elif isinstance(f.dataType, DoubleType) and decimals is not None:
            c = F.format_string(f"%.{decimals}f", c)
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return df.select(*map(column, df.schema.fields))


def write_csv(df: DataFrame, path: str, order: str | None = None, decimals: int | None = None, parts: int | None = 1) -> None:
    """A report in order of its path. One file by default, as reports are handed on; parts=None leaves as many as there are tasks."""
    out = csv_text(df, decimals)
    if order:
        out = out.orderBy(F.lower(order), order)
    if parts:
        out = out.coalesce(parts)
    out.write.mode("errorifexists").option("header", "true").option("quote", '"').option("escape", '"').option("quoteAll", "true").option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def publish_csv(df: DataFrame, root: str, order: str, decimals: int | None = None) -> str:
    """Writes a new version below root, reads it back, compares row by row, and only then points to it."""
    from tessera.operators.reconcile import same_rows

    spark = df.sparkSession
    path = f"{root.rstrip('/')}/v={uuid.uuid4().hex}"
    write_csv(df, path, order, decimals)
    want = csv_text(df, decimals)
    back = spark.read.schema(want.schema).option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path).fillna("")
    if not same_rows(want, back).isEmpty():
        raise ValueError(f"{path} reads back otherwise than it was written")
    point(spark, root, path)
    return path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _replace(spark: SparkSession, source, target) -> None:
    """Renames a file over target in one step, so that target is there at every moment."""
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, how)


def point(spark: SparkSession, root: str, version: str) -> None:
    """Makes version the current one of root, by renaming a finished pointer file into place."""
    fs, target = _fs(spark, f"{root.rstrip('/')}/CURRENT")
    _, temp = _fs(spark, f"{root.rstrip('/')}/CURRENT.{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    out.write(bytearray(version.encode()))
    out.close()
    _replace(spark, temp, target)


def current(spark: SparkSession, root: str) -> str | None:
    """The version that root points to."""
    fs, target = _fs(spark, f"{root.rstrip('/')}/CURRENT")
    if not fs.exists(target):
        return None
    return spark.read.text(f"{root.rstrip('/')}/CURRENT").first()[0]


def publish_state(state: DataFrame, root: str) -> str:
    """Writes state to a new version below root and points to it; a reader of the old version isn't disturbed."""
    path = f"{root.rstrip('/')}/v={uuid.uuid4().hex}"
    state.write.parquet(path)
    point(state.sparkSession, root, path)
    return path


def read_state(spark: SparkSession, root: str, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """The current state, or an empty one; columns that an older version lacks get their defaults."""
    at = current(spark, root)
    empty = spark.createDataFrame([], schema)
    if at is None:
        return empty
    out = empty.unionByName(spark.read.parquet(at), allowMissingColumns=True)
    return out.fillna({k: v for k, v in (defaults or {}).items() if k in out.columns})


def demoted(results: DataFrame, changed: Column, nulled: list[str]) -> DataFrame:
    """Results whose files changed since are errors, without output columns."""
    out = results
    for c in nulled:
        out = out.withColumn(c, F.when(~changed, F.col(c)))
    return out.withColumn("action", F.when(changed, "ERROR").otherwise(F.col("action")))


def write_manifest(results: DataFrame, path: str, head: dict[str, str]) -> None:
    """A JSON manifest of one object: the head and all results. It is gathered into one row, so it is for runs of a size that one file holds; larger ones use publish_state."""
    rows = results.agg(F.sort_array(F.collect_list(F.struct(*results.columns))).alias("results"))
    rows.select(*(F.lit(v).alias(k) for k, v in head.items()), "results").coalesce(1).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def error_report(results: DataFrame) -> DataFrame:
    return results.where(F.coalesce("error", F.lit("")) != "").select(F.col("source_path").alias("source"), F.col("output_path").alias("planned_output"), "error")


def comparison_page(rows: DataFrame, title: str, limit: int = 500) -> str:
    """A small HTML page of the first rows in order, for a look; the data stands in it as escaped JSON."""
    data = [r.asDict(recursive=True) for r in rows.limit(limit).collect()]
    body = json.dumps(data, default=str, ensure_ascii=True).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    head = title.replace("&", "&amp;").replace("<", "&lt;")
    return f"<!doctype html><meta charset=utf-8><title>{head}</title><h1>{head}</h1><pre id=o></pre><script>o.textContent=JSON.stringify({body},null,1)</script>"


def publish_file(spark: SparkSession, source: str, target: str, sha256: str | None = None) -> str:
    """Copies one file: staged beside its target, read back, compared by digest, then renamed into place. Gives the digest."""
    digest = lambda p: spark.read.format("binaryFile").load(p).select(F.sha2("content", 256)).first()[0]
    want = digest(source)
    if sha256 is not None and want != sha256:
        raise ValueError(f"{source} isn't what was expected")
    staged = f"{target}.{uuid.uuid4().hex}.part"
    (from_fs, from_path), (to_fs, to_path), (_, final) = _fs(spark, source), _fs(spark, staged), _fs(spark, target)
    try:
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, from_path, to_fs, to_path, False, spark.sparkContext._jsc.hadoopConfiguration())
        if digest(staged) != want or digest(source) != want:
            raise ValueError(f"{source} changed while it was copied")
        _replace(spark, to_path, final)
    finally:
        if to_fs.exists(to_path):
            to_fs.delete(to_path, False)
    return want
