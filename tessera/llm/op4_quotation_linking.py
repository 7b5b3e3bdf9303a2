"""Chat formatting: quoted passages are linked to the messages they come from, and conversations are built in reply order without quotes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import spark as S

_MARK = re.compile(r"(?:[ \t]{0,3}>)+ ?")
_SAID = re.compile(r"(?:on|am|le|el)\b.*\b(?:wrote|schrieb|a écrit|escribió)\s?:", re.I)
_GAP = re.compile(r"\s+")
#: Turns of a conversation in one bucket of the search for the latest earlier message.
BUCKET = 1024


def normal(text: str) -> str:
    return _GAP.sub(" ", text).strip().casefold()


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def units(lines: list[str]) -> list[str]:
    """A passage as a whole, its paragraphs and its lines, normalised, without repeats and blanks."""
    paragraphs, held = [], []
    for line in [*lines, ""]:
        if line.strip():
            held.append(line)
        elif held:
            paragraphs.append(" ".join(held))
            held = []
    return [u for u in dict.fromkeys(map(normal, [" ".join(lines), *paragraphs, *lines])) if u]


def parse(text: str) -> tuple[str, list[str], list[tuple[int, str]]]:
    """Text without quotes; hashes of its own units; (level, hash) of the units of each quoted passage.

    A line's level is the number of marks before it; lines of one level in a row are a passage. A line saying who wrote what
    follows goes with the quote after it.
    """
    own, passages = [], []
    for line in text.split("\n"):
        m = _MARK.match(line)
        if not m:
            own.append(line)
            passages.append(None)
            continue
        level = m[0].count(">")
        while own and not passages[-1] and (not own[-1].strip() or _SAID.fullmatch(own[-1].strip())) and any(_SAID.fullmatch(x.strip()) for x in own[-2:]):
            own.pop()
        if passages and passages[-1] and passages[-1][0] == level:
            passages[-1][1].append(line[m.end() :])
        else:
            passages.append((level, [line[m.end() :]]))
    quoted = [(p[0], digest(u)) for p in passages if p for u in units(p[1])]
    return "\n".join(own).strip("\n"), [digest(u) for u in units(own)], list(dict.fromkeys(quoted))


def _parsed(messages: DataFrame) -> DataFrame:
    schema = [("mid", pa.int64()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("body", pa.string()), ("own", pa.list_(pa.string())), ("levels", pa.list_(pa.int32())), ("quotes", pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                out = []
                for mid, conv, turn, role, text in zip(*(c[a : a + 512].to_pylist() for c in b.columns), strict=True):
                    body, own, quoted = parse(text or "")
                    out.append((mid, conv, turn, role, body, own, [x for x, _ in quoted], [x for _, x in quoted]))
                yield S.batch(schema, out)

    return messages.select(
        F.monotonically_increasing_id().alias("mid"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    ).mapInArrow(run, "mid long, conv_id long, turn long, role string, body string, own array<string>, levels array<int>, quotes array<string>")


def quotation_links(parsed: DataFrame) -> DataFrame:
    """mid, level, parent_conv, parent_turn, units: the message that most units of a message's quotes at a level come from.

    A quoted unit belongs to the latest earlier message of its conversation that has it as text of its own, or else to the first
    message anywhere with a smaller conv_id that has it. Ties go to the own conversation, then to the later turn. A unit's
    originals are summed up before any join, by buckets of turns within a conversation, so a unit that is everywhere costs a row
    for each bucket.
    """
    quotes = parsed.where("size(quotes) > 0 and conv_id is not null and turn is not null").select("mid", "conv_id", "turn", F.explode(F.arrays_zip("levels", "quotes")).alias("q"))
    quotes = quotes.select("mid", "conv_id", "turn", F.col("q.levels").alias("level"), F.col("q.quotes").alias("unit"), F.floor(F.col("turn") / BUCKET).alias("bucket"))
    wanted = quotes.select("unit").distinct()
    own = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("own").alias("unit")).join(wanted, "unit", "left_semi")
    own = S.cut(own.withColumn("bucket", F.floor(F.col("turn") / BUCKET)))
    by_bucket = own.groupBy("conv_id", "unit", "bucket").agg(F.max("turn").alias("last"))
    earlier = Window.partitionBy("conv_id", "unit").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # in the own bucket: the latest original before the quote; else the last one of an earlier bucket
    tagged = own.select("conv_id", "unit", "bucket", "turn", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("mid"), F.lit(None).cast("int").alias("level")).distinct()
    tagged = tagged.unionByName(quotes.select("conv_id", "unit", "bucket", "turn", F.lit(-1).alias("kind"), "mid", "level"))
    near = Window.partitionBy("conv_id", "unit", "bucket").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, -1)
    inside = tagged.withColumn("near", F.last(F.when(F.col("kind") == 0, F.col("turn")), ignorenulls=True).over(near)).where("kind = -1")
    buckets = by_bucket.unionByName(quotes.select("conv_id", "unit", "bucket", F.lit(None).cast("long").alias("last")).distinct()).groupBy("conv_id", "unit", "bucket").agg(F.max("last").alias("last"))
    buckets = buckets.withColumn("before", F.max("last").over(earlier)).select("conv_id", "unit", "bucket", "before")
    local = inside.join(buckets, ["conv_id", "unit", "bucket"], "left").select("mid", "conv_id", "level", "unit", F.coalesce("near", "before").alias("at"))
    first = own.groupBy("unit").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    linked = local.join(first, "unit", "left").select(
        "mid", "level", "unit",
        F.when(F.col("at").isNotNull(), F.col("conv_id")).when(F.col("first.conv_id") < F.col("conv_id"), F.col("first.conv_id")).alias("parent_conv"),
        F.when(F.col("at").isNotNull(), F.col("at")).when(F.col("first.conv_id") < F.col("conv_id"), F.col("first.turn")).alias("parent_turn"),
        F.col("at").isNotNull().cast("int").alias("inner"),
    ).where("parent_conv is not null")
    votes = linked.groupBy("mid", "level", "parent_conv", "parent_turn", "inner").agg(F.count("*").alias("units"))
    best = F.row_number().over(Window.partitionBy("mid", "level").orderBy(F.desc("units"), F.desc("inner"), F.desc("parent_turn"), F.desc("parent_conv")))
    return votes.withColumn("best", best).where("best = 1").select("mid", "level", "parent_conv", "parent_turn", "units")


def quotation_linking(messages: DataFrame) -> DataFrame:
    """Messages without their quotes, in the reply order of threads.

    Columns: thread_id, hop, conv_id, turn, role, text, parent_conv, parent_turn, n_quotes, n_linked. Sorting by thread_id, hop,
    conv_id, turn gives each thread with every message after its parent. The parent is the message that the lowest level of quotes comes from,
    or else the turn before. A conversation whose first message quotes one with a smaller conv_id goes on in that one's thread,
    a hop later. Every input row gives one row: null conv_id or turn stay as they are and are linked with nothing; null and
    empty texts are empty messages; repeated rows stay repeated, and a parent's (conv_id, turn) names all of them. Empty tables give no rows.
    """
    parsed = S.cut(_parsed(messages))
    links = S.cut(quotation_links(parsed))
    parents = links.groupBy("mid").agg(F.min(F.struct("level", "parent_conv", "parent_turn")).alias("p"), F.sum("units").alias("n_linked"))
    turns = parsed.select("conv_id", "turn").where("conv_id is not null and turn is not null").distinct()
    bucketed = turns.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    ends = bucketed.groupBy("conv_id", "bucket").agg(F.max("turn").alias("last"))
    ends = ends.withColumn("carried", F.max("last").over(Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = bucketed.join(ends.select("conv_id", "bucket", "carried"), ["conv_id", "bucket"]).withColumn(
        "previous", F.coalesce(F.lag("turn").over(Window.partitionBy("conv_id", "bucket").orderBy("turn")), F.col("carried"))
    )
    rows = parsed.join(parents, "mid", "left").join(before.select("conv_id", "turn", "previous"), ["conv_id", "turn"], "left")
    rows = S.cut(
        rows.select(
            "conv_id", "turn", "role", F.col("body").alias("text"), F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("previous").isNull().alias("opens"),
            F.coalesce("p.parent_conv", F.when(F.col("previous").isNotNull(), F.col("conv_id"))).alias("parent_conv"),
            F.coalesce("p.parent_turn", "previous").alias("parent_turn"),
        )
    )
    up = rows.where("opens and parent_conv < conv_id").groupBy("conv_id").agg(F.max("parent_conv").alias("root")).withColumn("hop", F.lit(1).cast("long"))
    up = S.cut(up)
    while True:  # pointer jumping: the number of rounds is the logarithm of the longest chain
        above = up.select(F.col("conv_id").alias("root"), F.col("root").alias("higher"), F.col("hop").alias("more"))
        nxt = S.cut(up.join(above, "root", "left").select("conv_id", F.coalesce("higher", "root").alias("root"), (F.col("hop") + F.coalesce("more", F.lit(0))).alias("hop"), F.col("higher").isNotNull().alias("moved")))
        up = nxt.select("conv_id", "root", "hop")
        if nxt.where("moved").isEmpty():
            break
    return rows.join(up, "conv_id", "left").select(
        F.coalesce("root", "conv_id").alias("thread_id"), F.coalesce("hop", F.lit(0)).alias("hop"), "conv_id", "turn", "role", "text", "parent_conv", "parent_turn", "n_quotes", "n_linked"
    )


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation_linking(S.table(spark, sf_dir, "conversations"))


QUERIES = {"op4_quotation_linking": op4_quotation_linking}
SQL: dict[str, str] = {}
