"""A run from files to a report: scan, codec, validation, choice, status, totals, with resumption."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import globs, sizes
from tessera.operators import candidates as choose
from tessera.operators import rules, state
from tessera.sources import plugins


@dataclass(frozen=True)
class RunSpec:
    """What a run does. Conflicting options are errors here, not later."""

    preset: str = "standard"
    dry_run: bool = False
    safe: bool = False
    retry_errors: bool = False
    preserve: tuple[str, ...] = ()
    profiles: dict[str, tuple[str, ...]] = field(default_factory=dict)
    photo_dpi: int | None = None
    preview_dpis: tuple[int, ...] = ()
    min_bytes: int | None = None

    def __post_init__(self):
        if self.preset not in ("standard", "compact"):
            raise ValueError(f"unknown preset {self.preset!r}")
        if self.photo_dpi is not None and not 150 <= self.photo_dpi <= 300:
            raise ValueError("photo_dpi is from 150 to 300")
        if (self.photo_dpi is not None) != bool(self.profiles.get("photo")):
            raise ValueError("photo_dpi and photo patterns go together")
        if self.safe and (self.preset == "compact" or set(self.profiles) & {"photo", "text_scan", "text_scan_bilevel", "font_replace"}):
            raise ValueError("safe allows lossless work only")
        if len(set(self.preview_dpis)) > 5:
            raise ValueError("at most five preview resolutions")

    def config_hash(self) -> str:
        """The same for the same work: previews don't count, and options that are off are left out."""
        on = {k: v for k, v in asdict(self).items() if v not in (None, False, (), {}) and k not in ("preview_dpis", "retry_errors")}
        return hashlib.sha256(json.dumps(on, sort_keys=True).encode()).hexdigest()


def run(files: DataFrame, previous: DataFrame, spec: RunSpec, codec: plugins.Codec = plugins.deflate) -> DataFrame:
    """A result for each of files (path, content) that needs work, in the columns of the state table.

    previous: the state so far. Files that are preserved or too small aren't given to the codec; nothing is written in a dry run.
    """
    config = spec.config_hash()
    snap = files.select("path", "content", F.col("path").alias("source_path"), F.octet_length("content").cast("bigint").alias("source_size"), F.sha2("content", 256).alias("source_sha256"), F.lit(True).alias("output_matches"))
    todo = state.resume(snap, previous, config, output_required=not spec.dry_run, retry_errors=spec.retry_errors).where("todo")
    lists = {k: globs.normalize_patterns(list(v)) for k, v in spec.profiles.items()}
    todo = todo.withColumn("profile", globs.profile(F.col("path"), globs.normalize_patterns(list(spec.preserve)), lists, spec.preset))
    least = spec.min_bytes if spec.min_bytes is not None else rules.LOSSLESS[0]
    small = (F.col("source_size") < least) & ~F.col("profile").isin(*rules.ANY_SAVING)
    work = todo.where((F.col("profile") != "preserve") & ~small)
    made = plugins.candidates(work, codec, keep_content=False)
    facts = made.join(work.select("path", "source_size", "profile"), "path")
    enough = sizes.enough_saved(F.col("source_size"), F.col("size"), least, rules.LOSSLESS[1])
    reason = choose.candidate_reason(F.col("valid"), F.col("failed"), F.col("images_changed"), F.col("source_size"), F.col("size"), enough)
    rows = facts.select(F.col("path").alias("doc"), "idx", "kind", "size", reason.alias("reason"), "sha256")
    decided = choose.decide(rows, work.select(F.col("path").alias("doc"), F.lit(False).alias("lossy")))
    chosen = decided.join(rows.select("doc", "kind", F.col("size").alias("out_size"), F.col("sha256").alias("out_sha")), ["doc", "kind"], "left").dropDuplicates(["doc"])
    out = todo.join(chosen.withColumnRenamed("doc", "path").withColumnRenamed("reason", "why"), "path", "left")
    status = F.when(F.col("profile") == "preserve", "PRESERVED_ORIGINAL").when(F.col("status").isNull(), "SKIPPED_SMALL").otherwise(F.col("status"))
    adopted = status.startswith("ADOPTED")
    if spec.dry_run:
        status = F.when(adopted, "DRY_RUN_LOSSLESS").otherwise("DRY_RUN_PRESERVED")
    size = F.lit(None).cast("bigint") if spec.dry_run else F.when(adopted, F.col("out_size")).otherwise(F.col("source_size"))
    sha = F.lit("") if spec.dry_run else F.when(adopted, F.col("out_sha")).otherwise(F.col("source_sha256"))
    return out.select(
        "source_path", "source_size", "source_sha256", size.alias("output_size"), sha.alias("output_sha256"), status.alias("status"), "profile", F.coalesce("why", F.lit("")).alias("decision_reason"),
        F.coalesce(F.col("source_size") - size, F.lit(0)).alias("saved_bytes"), F.lit(config).alias("config_hash"),
    )
